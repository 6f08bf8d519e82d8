"""Small made-up records of every format, parsed and carried through all verbs."""

from orgpanel import cli
from orgpanel.plans import pipeline, samples
from orgpanel.sources import flat, patents
from orgpanel.sources.fetch import fetch_file, manifest


def lay_out(root):
    for name, text in samples.FILES.items():
        (root / "raw" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "raw" / name).write_text(text, encoding="latin-1")


def test_all_verbs(spark, tmp_path):
    lay_out(tmp_path)
    for kind in pipeline.PARSERS:
        cli.main(["--datadir", str(tmp_path), "parse", kind], spark)
        assert pipeline.parse(spark, kind, f"{tmp_path}/raw/{kind}", f"{tmp_path}/tables") == []
    read = lambda n: pipeline.read_table(spark, f"{tmp_path}/tables", n)
    grants = {r.patnum: r for r in read("grant_grant").collect()}
    assert set(grants) == {"3930584", "d238976", "6167569", "10000001"}
    g = grants["3930584"]
    assert (g.title, g.owner, g.state, g.country, g.city, g.appnum, g.ipc, g.claims, g.abstract, g.pubdate) == ("widget andmaker", "second corp", "ca", "us", "paris", "05123456", "a61b051/2", 12, "one\ntwo", "19760106")
    assert grants["d238976"].appnum == "29765432"
    assert (grants["6167569"].title, grants["6167569"].ipc, grants["6167569"].abstract, grants["6167569"].owner) == ("coat — long", "a41d013/00", "first\nsecond", None)
    assert (grants["10000001"].title, grants["10000001"].ipc, grants["10000001"].abstract) == ("fast", "g06f009/44", "hello world")
    assert {tuple(r) for r in read("grant_cite").collect()} == {("3930584", "3000001"), ("3930584", "d200002"), ("6167569", "2761147"), ("10000001", "6167569")}
    assert read("grant_quarantine").count() == 1
    applies = {r.appnum: r for r in read("apply_apply").collect()}
    assert (applies["09500001"].ipcver, applies["09500001"].country, applies["15000001"].city) == ("7", "no", "ulm")
    assert {(r.assignid, r.patnum, r.assignee_country) for r in read("assign_assign").collect()} == {("1234007_0", "10000001", "united states"), ("1234007_1", "6167569", "united states")}
    mark = read("tmapply_tmapply").first()
    assert (mark.n_stat, mark.gs_codes, mark.us_class, mark.owners) == (1, "gs0011", "046; 047", "tea co")
    assert [tuple(r) for r in read("maint_maint").collect()] == [("6167569", 12, True)]
    account = read("compustat_compustat").collect()
    assert [(r.compid, r.name, r.mktval, r.naics, r.sic) for r in account] == [(0, "zyx gmbh", 6.0, "334000", "357000")]

    for verb in (["assign"], ["cluster", "--sources", "grant", "apply", "assign", "compustat"], ["cites"], ["merge", "--compustat"]):
        cli.main(["--datadir", str(tmp_path), "firms", *verb], spark)
    names = {r.name: r.id for r in read("name").collect()}
    assert set(names) == {"second corp", "second corporation", "zyx gmbh"}
    assert read("firmyear_index").where("stock is null or age < 0").count() == 0
    info = {r.patnum: r for r in read("grant_info").collect()}
    assert (info["6167569"].n_citing, info["6167569"].n_trans, info["6167569"].last_maint) == (1, 1, 12)
    before = sorted(map(str, read("firmyear_info").collect()))
    cli.main(["--datadir", str(tmp_path), "firms", "merge", "--compustat"], spark)
    assert sorted(map(str, read("firmyear_info").collect())) == before


def test_dry_run_writes_nothing(spark, tmp_path):
    lay_out(tmp_path)
    cli.main(["--datadir", str(tmp_path), "parse", "maint", "--dryrun"], spark)
    assert not (tmp_path / "tables").exists()
    assert patents.grant_gen1(b"HEADER\n", "x") is None
    assert flat.latest(["a/M_20200101.txt", "a/M_20210101.txt"]).endswith("20210101.txt")


def test_fetch(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.txt", "hi")
    (tmp_path / "list.txt").write_text(f"file://{tmp_path}/a.zip\n\n")
    (url,) = manifest(tmp_path / "list.txt")
    assert fetch_file(url, tmp_path / "out", dryrun=True) and not (tmp_path / "out").exists()
    assert fetch_file(url, tmp_path / "out") and (tmp_path / "out/x.txt").read_text() == "hi"
    assert not fetch_file(url, tmp_path / "out")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 1.23456), ("nan", None)], "t string, x double")
    pipeline.export_csv(df, str(tmp_path / "c"))
    got = pipeline.read_csv(spark, str(tmp_path / "c"), "t string, x double", na_tokens=True).collect()
    assert {(r.t, r.x) for r in got} == {("a\nb", 1.235), (None, None)}


def test_newest_snapshot_of_a_maintenance_folder(spark, tmp_path):
    line = "{:<13} {:<8} {} 20000101 20010101 20050101 M170 ".format
    data, out = tmp_path / "maint", tmp_path / "tables"
    data.mkdir()
    for name, number in (("MaintFeeEvents_20190101.txt", "1111111"), ("MaintFeeEvents_20200101.txt", "2222222"), ("readme.txt", "3333333")):
        (data / name).write_text(line(number, "09000001", "Y") + "\n")
    pipeline.parse(spark, "maint", str(data), str(out))
    both, one = spark.read.parquet(f"{out}/maint_maint").count(), flat.newest_snapshot(spark, str(data))
    assert both == 1 and one.endswith("MaintFeeEvents_20200101.txt")
    assert flat.newest_snapshot(spark, one) == one
