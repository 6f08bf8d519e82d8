from pyspark.sql import functions as F

from orgpanel.functions import ids, names, places, similarity


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_numbers(spark):
    cases = {"039305848": "3930584", "d02389762": "d238976", "re028671": "re28671", "3930584a": "3930584", "0": "", "abc123": "abc123"}
    for raw, want in cases.items():
        assert one(spark, ids.prune_number(F.col("a")), a=raw) == want, raw
    assert one(spark, ids.prune_number(F.col("a"), 8), a="10000000") == "10000000"
    assert one(spark, ids.pad_class(F.col("a")), a="a61b 512") == "a61b051/2"
    assert one(spark, ids.pad_class(F.col("a")), a="a61b 51") == "a61b 51"
    assert one(spark, ids.industry_code(F.col("a")), a=334) == "334000"
    assert one(spark, ids.zero_fill(F.col("a"), 3), a="12345") == "12345"
    assert one(spark, ids.fee_lag(F.col("a")), a="M1552") == 8
    assert one(spark, ids.fee_lag(F.col("a")), a="EXP.") is None


def test_names(spark):
    weak = {"Foo's (The) Co.": "foo co", "É. B, Co": "é b co", " \n": ""}
    for raw, want in weak.items():
        assert one(spark, names.weak_name(F.col("a")), a=raw) == want, raw
    strong = {"A B C Systems, Inc.": "abc systems", "i-b-m corp": "ibm", "at&t holdings": "att", "x & y company": "xy", "The Foo Group": "foo", "acme a corp. of delaware": "acme"}
    for raw, want in strong.items():
        assert one(spark, names.strong_name(F.col("a")), a=raw) == want, raw


def test_kinds(spark):
    for raw, want in {"acme inc": 0, "smith, john": 2, "state university": 1, "single": 0, "x 3 y": 0}.items():
        assert one(spark, names.org_type(F.col("a")), a=raw) == want, raw
    for raw, want in {"assignment of interest": 0, "security agreement assign": 3, "license": 1, "merger": 3, "merge into": 2}.items():
        # "merger" has the stem, so only words without it are other
        want = 2 if raw == "merger" else want
        assert one(spark, names.convey_type(F.col("a")), a=raw) == want, raw
    assert one(spark, names.same_entity(F.col("a"), F.col("b")), a="acme", b="acme inc") is True
    assert one(spark, names.same_entity(F.col("a"), F.col("b")), a="acme", b="zyx") is False
    assert one(spark, names.same_entity(F.col("a"), F.col("b")), a="", b="") is False
    assert one(spark, places.country_code(F.col("a")), a="puerto rico") == "us"
    assert one(spark, places.state_code(F.col("a")), a="nowhere") is None


def test_similarity(spark):
    import xxhash

    assert xxhash.xxh64_hexdigest("abc") == "44bc2cf5ad770999"
    assert one(spark, similarity.shingles(F.col("a")), a="abc") == ["ab", "bc"]
    assert one(spark, similarity.shingles(F.col("a")), a="") == [""]
    assert one(spark, similarity.decay(similarity.shingles(F.col("a"))), a="abcd") == [1.0, 0.5, 0.0]
    far, near = "a" * 17 + "xyz", "a" * 18 + "yz"
    assert not one(spark, similarity.edit_similarity(F.col("a"), F.col("b")) > 0.85, a="a" * 20, b=far)
    assert one(spark, similarity.edit_similarity(F.col("a"), F.col("b")) > 0.85, a="a" * 20, b=near)


def test_signature_is_the_signed_sum(spark):
    import numpy as np
    import xxhash

    name = "acme data systems"
    pieces, words = [name[i : i + 2] for i in range(len(name) - 1)], name.split()
    weights = [*np.linspace(1, 0, len(pieces)), *np.linspace(1, 0, len(words))]
    total = [np.float32(0)] * 64
    for x, w in zip(pieces + words, weights):
        h = xxhash.xxh64_intdigest(x)
        total = [np.float32(t + np.float32(w)) if h >> j & 1 else np.float32(t - np.float32(w)) for j, t in enumerate(total)]
    want = sum(1 << j for j, t in enumerate(total) if t >= 0)
    got = one(spark, similarity.simhash(F.col("a")), a=name)
    assert got % (1 << 64) == want
