"""Queries over small files of every source format, written to the shared folder; their SQL is the rows that must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpanel.functions import registered, similarity
from orgpanel.functions.ids import prune_number
from orgpanel.operators import clusters, panel
from orgpanel.plans import pipeline, samples
from orgpanel.plans.source_rows import ROWS
from orgpanel.sources import fetch, flat, patents, records
from orgpanel.storage import materialize, new_path, put_file

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rows_sql(kind: str, rows: list[tuple]) -> str:
    """Literal rows as SQL; ``kind`` has the names and types of the columns."""
    columns = [c.split(" ") for c in kind.split(", ")]
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({', '.join(map(one, r))})" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in columns)} FROM (VALUES {values}) t({', '.join(n for n, _ in columns)})"


def query(f):
    QUERIES[f.__name__] = f
    if f.__name__ in ROWS:
        SQL[f.__name__] = rows_sql(*ROWS[f.__name__])
    return f


def _folder(spark: SparkSession, *files: str) -> str:
    """A data folder with these sample files under ``raw``."""
    top, known = new_path(spark, "samples"), samples.FILES | samples.MORE
    for name in files:
        put_file(spark, f"{top}/raw/{name}", known[name].encode("latin-1"))
    return top


GRANT = ["patnum", "pubdate", "appnum", "appdate", "ipc", "ipcver", "city", "state", "country", "owner", "claims", "title", "abstract", "gen", "file"]
GRANT_FILES = ("grant/a.dat", "grant/pgb1.xml", "grant/ipgb1.xml", "grant/ipgb2.xml", "grant/notes.txt")


def _grants(spark: SparkSession, gen: int) -> DataFrame:
    found = patents.grant_records(spark, f"{_folder(spark, *GRANT_FILES)}/raw/grant", (gen,))
    return patents.grant_tables(found)["grant_grant"].select(*GRANT)


@query
def parse_grant_gen1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged lines: two records, one with all fields."""
    return _grants(spark, 1)


@query
def parse_grant_gen2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenated documents with declarations and entities; one does not parse."""
    return _grants(spark, 2)


@query
def parse_grant_gen3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of classes, both places of citations."""
    return _grants(spark, 3)


@query
def parse_grant_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patents.grant_records(spark, f"{_folder(spark, *GRANT_FILES)}/raw/grant")
    return patents.grant_tables(found)["grant_ipc"]


@query
def parse_grant_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patents.grant_records(spark, f"{_folder(spark, *GRANT_FILES)}/raw/grant")
    return patents.grant_tables(found)["grant_cite"]


APPLY_FILES = ("apply/pab1.xml", "apply/pab2.xml", "apply/ipab1.xml", "apply/ipab2.xml")


@query
def parse_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.apply_tables(patents.apply_records(spark, f"{_folder(spark, *APPLY_FILES)}/raw/apply"))["apply_apply"]


@query
def parse_application_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.apply_tables(patents.apply_records(spark, f"{_folder(spark, *APPLY_FILES)}/raw/apply"))["apply_ipc"]


@query
def parse_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.transfer_tables(patents.transfer_records(spark, f"{_folder(spark, 'assign/ad.xml')}/raw/assign"))["assign_assign"].drop("pos")


@query
def parse_trademarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patents.mark_tables(patents.mark_records(spark, f"{_folder(spark, 'tmapply/apc1.xml', 'tmapply/apc2.xml')}/raw/tmapply"))["tmapply_tmapply"]


MAINT_FILES = ("maint/MaintFeeEvents_20190101.txt", "maint/MaintFeeEvents_20200101.txt", "maint/readme.txt")


@query
def scan_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by place, from all files of a folder."""
    return flat.maintenance_events(spark, f"{_folder(spark, *MAINT_FILES)}/raw/maint")


@query
def latest_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fees of the newest snapshot alone."""
    return flat.maintenance_table(spark, flat.newest_snapshot(spark, f"{_folder(spark, *MAINT_FILES)}/raw/maint"))


@query
def parse_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.accounts_table(spark, f"{_folder(spark, 'compustat/two.csv')}/raw/compustat")


@query
def files_by_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted files of a source, dispatched by name, with the records of each; other files are left alone."""
    folder = f"{_folder(spark, *GRANT_FILES)}/raw/grant"
    found = pipeline.source_files(spark, "grant", folder)
    order = spark.createDataFrame([(f.rsplit("/", 1)[-1], k) for k, f in enumerate(found)], "file string, place long")
    counts = records.file_counts(patents.grant_records(spark, found))
    return order.join(counts, "file", "left").select("file", "place", "n_records", "n_bad")


@query
def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that does not parse; the others of its file stay."""
    found = records.quarantine(patents.grant_records(spark, f"{_folder(spark, *GRANT_FILES)}/raw/grant"))
    return found.select("file", F.substring_index("error", ":", 1).alias("error"))


@query
def parse_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the grant table after each run: a first one, a repeat, one with a new file, a dry one, one that overwrites."""
    top = _folder(spark, "grant/a.dat", "grant/pgb1.xml")
    raw, tables, seen = f"{top}/raw/grant", f"{top}/tables", []

    def run(step: str, **options) -> None:
        ran = pipeline.parse(spark, "grant", raw, tables, **options)
        table = pipeline.read_table(spark, tables, "grant_grant")
        seen.append((step, len(ran), table.count(), table.select("patnum").distinct().count()))

    run("first")
    run("again")
    put_file(spark, f"{raw}/ipgb2.xml", samples.GEN3_OLD.encode("latin-1"))
    run("dry", dryrun=True)
    run("new")
    run("overwrite", overwrite=True)
    return spark.createDataFrame(seen, "step string, n_files long, n_rows long, n_patents long")


@query
def dispatch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source by its name in the registry: the tables that a parse leaves, with their rows."""
    top = _folder(spark, *samples.FILES)
    for kind in pipeline.PARSERS:
        pipeline.parse(spark, kind, f"{top}/raw/{kind}", f"{top}/tables")
    made = [(k, t, pipeline.read_table(spark, f"{top}/tables", t).count()) for k, names in pipeline.SOURCE_TABLES.items() for t in names]
    return spark.createDataFrame(made, "kind string, name string, n_rows long")


@query
def concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class tables of a source from two parts that were written one after the other."""
    top = _folder(spark, *GRANT_FILES)
    for gen in (1, 3):
        for name, df in patents.grant_tables(patents.grant_records(spark, f"{top}/raw/grant", (gen,))).items():
            pipeline.write(df, f"{top}/parts/{name}_{gen}")
    return pipeline.concat_source(spark, "grant", f"{top}/parts")["grant_ipc"]


@query
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV written with a header and rounded fractions, read by a given schema."""
    path = new_path(spark, "csv")
    df = spark.createDataFrame([(1, "a\nb", 1.23456), (2, "NaN", None), (3, 'say "x", y', -0.0004)], "k long, t string, x double")
    pipeline.export_csv(df, path)
    return pipeline.read_csv(spark, path, "k long, t string, x double", na_tokens=True)


@query
def element_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text before the first child, and all text, of elements with markup, entities, white space, or nothing."""
    texts = ["<r><a> Plain </a></r>", "<r><a>One <b>two</b> three</a></r>", "<r><a><b>In</b>ner</a></r>", "<r><a/></r>", "<r></r>", "<r><a>&eacute;&unknown;&amp;&mdash;</a></r>"]
    chunks = spark.createDataFrame([("f", {"block": 0, "n": k}, bytearray(t[: -len("</r>")].encode())) for k, t in enumerate(texts)], "file string, pos struct<block:bigint,n:bigint>, chunk binary")

    def build(chunk: bytes, file: str) -> dict | None:
        root = records.xml_record(chunk, "r")
        node = root.find("a")
        return {"own": records.text_at(root, "a", "none"), "whole": None if node is None else records.all_text(node, "|")}

    return records.parse_records(chunks, build, "own string, whole string").select(F.col("pos.n").alias("k"), "own", "whole")


@query
def simhash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The xxHash64 signature in 32-bit sums, as the clustering takes it, of fixed names."""
    found = ["abc", "a", "", "acme widgets", "acme widget", "zyx gmbh", "société générale", "acme widgets incorporated of boise"]
    return spark.createDataFrame([(n,) for n in found], "name string").select("name", similarity.simhash(F.col("name")).alias("sig"))


@query
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The string functions by their SQL names."""
    registered.register(spark)
    return spark.sql("""select raw, prune_number(raw) as number, pad_class(raw) as class, industry_code(try_cast(raw as bigint)) as industry, fee_lag(raw) as lag, weak_name(raw) as weak, strong_name(raw) as strong,
        org_type(raw) as kind, convey_type(raw) as conveyance, state_code(raw) as state, country_code(raw) as country, same_entity(raw, 'acme corp') as same
        from values ('D0123456789'), ('a61b 512'), ('334'), ('M170'), ('texas'), ('germany'), ('acme co., the'), ('assignment'), ('john smith'), ('state university') as t(raw)""")


@query
def long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of eight digits, and those of maintenance files."""
    raw = spark.createDataFrame([("0010000001",), ("RE0350001",), ("10000001",), ("x1234567890",), ("",), (None,)], "raw string")
    return raw.select("raw", prune_number(F.col("raw"), 8).alias("eight"), prune_number(F.lower("raw"), 13).alias("maint"))


@query
def chosen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the name sources that a request stands for, in order of the registry."""
    asked = {"default": None, "one": "compustat", "both parties": ["assign"], "mixed": ["grant", "assignee", "apply"], "all": list(clusters.NAME_SOURCES)}
    rows = [(k, place, t) for k, v in asked.items() for place, t in enumerate(clusters.choose_sources(v))]
    return spark.createDataFrame(rows, "asked string, place long, tag string")


@query
def fetch_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of archives fetched and unpacked: a dry run, a first one, a repeat, and one that overwrites; one address fails."""
    from io import BytesIO
    from pathlib import Path
    from urllib.parse import urlparse
    from zipfile import ZipFile

    top, packed, seen = new_path(spark, "fetch"), BytesIO(), []
    with ZipFile(packed, "w") as z:
        z.writestr("inner.txt", "hello")
    put_file(spark, f"{top}/from/one.zip", packed.getvalue())
    here = Path(urlparse(top).path)
    put_file(spark, f"{top}/list.txt", f"{here.as_uri()}/from/one.zip\n\n  {here.as_uri()}/from/none.zip \n".encode())
    urls = fetch.manifest(here / "list.txt")
    for step, options in {"dry": {"dryrun": True}, "first": {}, "again": {}, "overwrite": {"overwrite": True}}.items():
        tried = fetch.fetch_many(urls, here / "to", delay=0, **options)
        files = sorted(f.name for f in (here / "to").iterdir()) if (here / "to").exists() else []
        seen.append((step, len(urls), tried, ",".join(f for f in files if not f.startswith("."))))
    return spark.createDataFrame(seen, "step string, listed long, tried long, files string")


@query
def panel_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From sample files to the panel by all verbs, and again after a file was added: global stages are done anew."""
    top, out = _folder(spark, *samples.FILES), None
    for late in ((), ("grant/ipgb2.xml", "apply/pab2.xml")):
        for name in late:
            put_file(spark, f"{top}/raw/{name}", samples.MORE[name].encode("latin-1"))
        for kind in pipeline.PARSERS:
            pipeline.parse(spark, kind, f"{top}/raw/{kind}", f"{top}/tables")
        pipeline.assign(spark, f"{top}/tables")
        pipeline.cluster(spark, f"{top}/tables", ["grant", "apply", "assign", "compustat"])
        pipeline.cites(spark, f"{top}/tables")
        pipeline.merge(spark, f"{top}/tables", compustat=True)
        names = pipeline.read_table(spark, f"{top}/tables", "name").join(pipeline.read_table(spark, f"{top}/tables", "firm"), "id")
        rows = pipeline.read_table(spark, f"{top}/tables", "firmyear_index").join(names.groupBy("firm_num").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("names")), "firm_num")
        made = rows.select(F.lit(len(late)).alias("late"), "names", "year", "age", "stock", *panel.COUNTS, "assets", "mktval", "naics")
        # years in which nothing happened stand in the table, not here
        made = materialize(made.where(" + ".join(panel.COUNTS) + " > 0 or assets is not null"), "panel")
        out = made if out is None else out.unionByName(made)
    return out
