import random

from pyspark.sql import functions as F

from orgpanel.operators import clusters, panel, relational
from orgpanel.operators.cites import citation_stats
from orgpanel.operators.components import connected_components
from orgpanel.operators.maintenance import maintenance_rollup
from orgpanel.operators.transfers import prune_transfers, transfer_stats
from orgpanel.streaming.incremental import ingest_new_files


def groups(edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    cases = [[(i, i + 1) for i in range(40)], [(1, 2), (2, 1), (5, 5)], [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], [(0, i) for i in range(1, 50)]]
    for edges in cases:
        got = connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(3)).collect()
        assert len(got) == len({r.id for r in got})
        assert {r.id: r.component for r in got} == groups(edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_citations(spark):
    cites = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "a"), ("x", None)], "src string, dst string")
    firms = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "patnum string, firm_num long")
    got = {r.patnum: tuple(r)[1:] for r in citation_stats(cites, firms).collect()}
    assert got == {"a": (2, 1, 1, 0), "b": (0, 1, 0, 1), "c": (1, 1, 0, 0), "x": (1, 0, 0, 0)}


def test_transfers(spark):
    kind = "assignid string, patnum string, execdate string, assignor string, assignee string, assignee_state string, assignee_country string, pos int"
    rows = [("1", "7", "20010101", "acme inc", "zyx gmbh", "texas", "germany", 0), ("1", "8", "20020101", "acme inc", "zyx gmbh", "texas", "atlantis", 1), ("2", "8", "20000101", "acme", "acme inc", None, None, 2), ("3", None, "20000101", "a b", "q", None, None, 3)]
    kept = prune_transfers(spark.createDataFrame(rows, kind), ["pos"])
    assert [(r.assignid, r.patnum, r.assignee_state, r.assignee_country) for r in kept.collect()] == [("1", "8", "tx", None)]
    assert [tuple(r) for r in transfer_stats(kept).collect()] == [("8", "20020101", 1)]


def test_maintenance(spark):
    rows = [("1", "Y", "M1551"), ("1", "N", "M1552"), ("2", "Y", "M285"), ("3", None, "M170"), ("4", "Y", "EXP.")]
    got = {tuple(r) for r in maintenance_rollup(spark.createDataFrame(rows, "patnum string, is_small string, event_code string")).collect()}
    assert got == {("1", 8, True), ("2", 12, False)}


def test_panel(spark):
    years = spark.createDataFrame([(1, 2000, 2, 1), (1, 2003, 1, None)], "firm_num long, year int, n_apply long, n_grant long")
    info = spark.createDataFrame([(1, "b01d 1"), (1, "a01d 1"), (None, "z")], "firm_num long, ipc string")
    life = panel.firm_life(years, info)
    assert [tuple(r) for r in life.select("year_min", "year_max", "tot_pats", "life_span", "mode_ipc4", "mode_ipc4_frac").collect()] == [(2000, 2003, 1, 4, "a01d", 1.0)]
    dense = panel.firm_index(years, life).orderBy("year").collect()
    assert [(r.year, r.n_apply, r.age, r.stock) for r in dense] == [(2000, 2, 0, 2), (2001, 0, 1, 2), (2002, 0, 2, 2), (2003, 1, 3, 3)]
    a = spark.createDataFrame([(1, 2000, 5)], "firm_num long, year int, x long")
    b = spark.createDataFrame([(1, 2000, 6), (None, 2000, 1)], "firm_num long, year int, y long")
    assert [tuple(r) for r in relational.full_align([a, b], ["firm_num", "year"]).collect()] == [(1, 2000, 5, 6)]


def test_groups_are_numbered_by_size(spark):
    close = spark.createDataFrame([(3, 2), (4, 3), (11, 10), (21, 20)], "id1 long, id2 long")
    got = {r.id: r.firm_num for r in clusters.firm_groups(close).collect()}
    assert got == {2: 0, 3: 0, 4: 0, 10: 1, 11: 1, 20: 2, 21: 2}
    ids = clusters.firm_ids(spark.createDataFrame([(5, "x"), (2, "y")], "id long, name string"), clusters.firm_groups(close))
    assert {r.id: r.firm_num for r in ids.collect()} == {5: 1000005, 2: 0}


def test_wide_keys_lose_no_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    sigs = [b ^ sum(rng.getrandbits(8) << 8 * k for k in rng.sample(range(8), rng.randrange(6))) for b in base for _ in range(25)]
    signed = spark.createDataFrame([(i, s - (1 << 64) if s >> 63 else s) for i, s in enumerate(sigs)], "id long, sig long")
    got = {tuple(r) for r in clusters.lsh_pairs(signed).collect()}
    want = {(i, j) for i in range(len(sigs)) for j in range(i) if sum(sigs[i] >> 8 * k & 255 == sigs[j] >> 8 * k & 255 for k in range(8)) > 4}
    assert got == want


def test_dense_ids(spark):
    df = spark.range(1000).withColumn("r", F.xxhash64("id")).repartition(7)
    got = relational.dense_id(df, ["r"], "n").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.r)] == list(range(1000))


def test_new_files_only(spark, tmp_path):
    source, target, seen = (str(tmp_path / x) for x in ("in", "out", "seen"))
    spark.range(5).write.parquet(source)
    assert ingest_new_files(spark, source, target, seen, "id long") == 1
    assert ingest_new_files(spark, source, target, seen, "id long") == 0
    spark.range(5, 8).write.mode("append").parquet(source)
    ingest_new_files(spark, source, target, seen, "id long")
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(8))
