"""The verbs: parse sources into tables; prune transfers, cluster names, count citations, merge the panel."""

from __future__ import annotations

from fnmatch import fnmatch
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orgpanel.operators import clusters, panel
from orgpanel.operators.cites import citation_stats
from orgpanel.operators.transfers import prune_transfers, transfer_stats
from orgpanel.sources import flat, patents
from orgpanel.sources.records import file_counts, quarantine
from orgpanel.storage import discard, exists, list_files, materialize, remove

#: kind -> (file names, readers by format)
GRANT_FORMATS, APPLY_FORMATS = tuple(patents.GRANTS), tuple(patents.APPLIES)
PARSERS = {
    "grant": (patents.grant_records, patents.grant_tables, {g: patents.GRANTS[g][0] for g in GRANT_FORMATS}),
    "apply": (patents.apply_records, patents.apply_tables, {g: patents.APPLIES[g][0] for g in APPLY_FORMATS}),
    "assign": (patents.transfer_records, patents.transfer_tables, {3: "*.xml"}),
    "tmapply": (patents.mark_records, patents.mark_tables, {1: "apc*.xml"}),
    "maint": (flat.maintenance_table, None, {}),
    "compustat": (flat.accounts_table, None, {}),
}
#: kind -> the tables of a source
SOURCE_TABLES = {"grant": ["grant_grant", "grant_ipc", "grant_cite"], "apply": ["apply_apply", "apply_ipc"], "assign": ["assign_assign"], "tmapply": ["tmapply_tmapply"], "maint": ["maint_maint"], "compustat": ["compustat_compustat"]}


def write(df: DataFrame, path: str, dryrun: bool = False, mode: str = "overwrite") -> None:
    """Parquet, or nothing at all but the work in a dry run."""
    if dryrun:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    """A table of all batches."""
    return spark.read.parquet(f"{tables}/{name}").drop("batch")


def source_files(spark: SparkSession, kind: str, path: str | list[str], formats: tuple[int, ...] | None = None) -> list[str]:
    """The files of a source, sorted by name; a chosen file that no format knows is an error."""
    globs = {g: p for g, p in PARSERS[kind][2].items() if formats is None or g in formats}
    if kind == "maint":
        return [flat.newest_snapshot(spark, path)] if isinstance(path, str) else [flat.latest(path)]
    if kind == "compustat":
        return list_files(spark, path, ("*.csv",)) if isinstance(path, str) else list(path)
    if isinstance(path, str):
        found = list_files(spark, path, tuple(globs.values()))
    else:
        found = sorted(path, key=lambda f: f.rsplit("/", 1)[-1])
    if unknown := [f for f in found if not any(fnmatch(f.rsplit("/", 1)[-1], g) for g in globs.values())]:
        raise ValueError(f"no format of {kind} has files named like {unknown[0]}")
    return found


def parse(spark: SparkSession, kind: str, path: str | list[str], tables: str, dryrun: bool = False, overwrite: bool = False, formats: tuple[int, ...] | None = None) -> list[tuple[str, int, int]]:
    """Parse the files of one source that no earlier run has parsed; (file, records, bad records) of each that was.

    Each run writes a batch of its own, named in a table of finished files when all of it is there, so a run that
    broke off is done again and leaves nothing twice. ``overwrite`` parses all files anew. A maintenance folder counts as its newest snapshot and
    accounts as one table; both are replaced when there is something new. A record that does not parse goes to the quarantine and the others of its file stay.
    """
    if kind not in PARSERS:
        raise ValueError(f"unknown data source: {kind}")
    ledger = f"{tables}/{kind}_files"
    done = {r.file: r.batch for r in spark.read.parquet(ledger).collect()} if exists(spark, ledger) and not overwrite else {}
    files = source_files(spark, kind, path, formats)
    name_of = lambda f: f.rsplit("/", 1)[-1]
    todo = [f for f in files if name_of(f) not in done]
    if not todo:
        return []
    read, split, _ = PARSERS[kind]
    batch = max(done.values(), default=-1) + 1
    if split is None:
        made = read(spark, files[0] if len(files) == 1 else files)
        write(made, f"{tables}/{SOURCE_TABLES[kind][0]}", dryrun)
        counts = [(name_of(f), 0, 0) for f in todo]
    else:
        records = read(spark, todo) if formats is None or kind not in ("grant", "apply") else read(spark, todo, tuple(formats))
        # one parse serves all tables; the count of each file goes along
        seen = Observation()
        records = records.observe(seen, F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"))
        if dryrun:
            write(records, "", True)
            return [("", seen.get["n"] - seen.get["bad"], seen.get["bad"])]
        records = materialize(records, f"{kind}-records")
        if not done:
            for name in [*SOURCE_TABLES[kind], f"{kind}_quarantine"]:
                remove(spark, f"{tables}/{name}")
        for name, df in split(records).items():
            write(df, f"{tables}/{name}/batch={batch}")
        write(quarantine(records), f"{tables}/{kind}_quarantine/batch={batch}")
        by = {r.file: r for r in file_counts(records).collect()}  # one row for each file of the run
        counts = [(name_of(f), by[name_of(f)].n_records if name_of(f) in by else 0, by[name_of(f)].n_bad if name_of(f) in by else 0) for f in todo]
        discard(records)
        print(f"{kind}: {seen.get['n']} records of {len(todo)} files, {seen.get['bad']} bad")
    if not dryrun:
        rows = spark.createDataFrame([(f, batch, n, bad) for f, n, bad in counts], "file string, batch int, n_records long, n_bad long")
        write(rows.coalesce(1), ledger, mode="append" if done else "overwrite")
    for f, n, bad in counts:
        print(f"{f}: {n} records, {bad} bad")
    return counts


def assign(spark: SparkSession, tables: str) -> None:
    records = read_table(spark, tables, "assign_assign")
    order = ["file", "pos"] if "pos" in records.columns else ["recdate", "file", F.xxhash64(*records.columns)]
    write(prune_transfers(records, order).drop("pos"), f"{tables}/assign_use")
    write(transfer_stats(spark.read.parquet(f"{tables}/assign_use")), f"{tables}/assign_stats")


def cluster(spark: SparkSession, tables: str, sources: list[str] | str | None = None) -> None:
    read = lambda name: read_table(spark, tables, name)
    tags = {t: clusters.NAME_SOURCES[t] for t in clusters.choose_sources(sources)}
    write(clusters.name_ids([read(t).where(F.col(i).isNotNull()).select(F.col(n).alias("name")) for t, i, n in tags.values()]), f"{tables}/name")
    names = read("name")
    write(clusters.candidate_pairs(names), f"{tables}/pair")
    close = clusters.close_pairs(read("pair"))
    write(close, f"{tables}/close")
    write(clusters.firm_groups(read("close")), f"{tables}/match")
    write(clusters.firm_ids(names, read("match")), f"{tables}/firm")
    for tag, (table, id_col, name_col) in tags.items():
        matches = clusters.name_matches(read(table), id_col, name_col, names)
        write(matches, f"{tables}/{tag}_match")
        write(clusters.record_firms(read(f"{tag}_match"), read("firm"), id_col), f"{tables}/{tag}_firm")


def cites(spark: SparkSession, tables: str) -> None:
    read = lambda name: read_table(spark, tables, name)
    write(citation_stats(read("grant_cite"), read("grant_firm")), f"{tables}/cite_stats")


def merge(spark: SparkSession, tables: str, compustat: bool = False) -> None:
    read = lambda name: read_table(spark, tables, name)
    write(panel.grant_info(read("grant_grant"), read("grant_firm"), read("cite_stats"), read("assign_stats"), read("maint_maint")), f"{tables}/grant_info")
    write(panel.grant_text(read("grant_grant")), f"{tables}/grant_text")
    accounts = (read("compustat_compustat"), read("compustat_firm")) if compustat else ()
    years = panel.firm_years(read("apply_apply"), read("apply_firm"), read("grant_info"), read("grant_firm"), read("assign_use"), read("assignor_firm"), read("assignee_firm"), *accounts)
    write(years, f"{tables}/firmyear_info")
    write(panel.firm_life(read("firmyear_info"), read("grant_info")), f"{tables}/firm_life")
    write(panel.firm_index(read("firmyear_info"), read("firm_life")), f"{tables}/firmyear_index")


FIRMS = {"assign": assign, "cluster": cluster, "cites": cites, "merge": merge}


def export_csv(df: DataFrame, path: str, digits: int = 3) -> None:
    """CSV with a header; fractions rounded."""
    rounded = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(rounded).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, na_tokens: bool = False) -> DataFrame:
    """CSV by a given schema; fields may hold line ends; with ``na_tokens`` the usual marks of missing values are null."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    marks = ["null", "NULL", "nan", "NaN", "NA", "N/A", "n/a", "#N/A", "<NA>"]
    return df.select([F.when(~F.col(c).isin(marks), F.col(c)).alias(c) if na_tokens and t == "string" else F.col(c) for c, t in df.dtypes])


def concat_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parts under one header, whatever their order of columns; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in sorted(paths)])


def concat_source(spark: SparkSession, kind: str, parts: str) -> dict[str, DataFrame]:
    """The tables of one source, each from all its parts ``parts/<table>_*``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(parts)
    names = [str(f.getPath().toString()) for f in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)]
    return {t: concat_tables(spark, [n for n in names if n.rsplit("/", 1)[-1].startswith(f"{t}_")]) for t in SOURCE_TABLES[kind]}
