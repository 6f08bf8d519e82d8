"""Organisation names to organisations: normal forms, SimHash bands, edit similarity, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgpanel.functions.names import strong_name, weak_name
from orgpanel.functions.similarity import band, edit_similarity, simhash
from orgpanel.operators.components import connected_components
from orgpanel.operators.relational import dense_id

#: tag -> (table, id column, name column)
NAME_SOURCES = {
    "apply": ("apply_apply", "appnum", "appname"),
    "grant": ("grant_grant", "patnum", "owner"),
    "assignor": ("assign_use", "assignid", "assignor"),
    "assignee": ("assign_use", "assignid", "assignee"),
    "compustat": ("compustat_compustat", "compid", "name"),
}
DEFAULT_SOURCES = ["apply", "grant", "assignee", "assignor"]
SINGLE_BASE = 1_000_000


def choose_sources(sources: list[str] | str | None = None) -> list[str]:
    """Tags in registry order; ``assign`` stands for both parties of transfers."""
    asked = [sources] if isinstance(sources, str) else list(sources or DEFAULT_SOURCES)
    asked = [t for s in asked for t in (["assignor", "assignee"] if s == "assign" else [s])]
    if unknown := set(asked) - set(NAME_SOURCES):
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    return [t for t in NAME_SOURCES if t in asked]


def name_ids(frames: list[DataFrame]) -> DataFrame:
    """(id, name): distinct weak names of (name) frames, numbered from 0 in order of source and name."""
    stacked = None
    for k, f in enumerate(frames):
        one = f.select(weak_name(F.col("name")).alias("name"), F.lit(k).alias("source"))
        stacked = one if stacked is None else stacked.unionByName(one)
    seen = stacked.where("name is not null and name != ''").groupBy("name").agg(F.min("source").alias("source"))
    return dense_id(seen, ["source", "name"]).select("id", "name")


def name_matches(records: DataFrame, id_col: str, name_col: str, names: DataFrame) -> DataFrame:
    """(id_col, id) by the weak form of the name."""
    keyed = records.dropna(subset=[id_col, name_col]).select(id_col, weak_name(F.col(name_col)).alias("name"))
    return keyed.join(names, "name", "left").select(id_col, "id")


def equal_bands(a: Column, b: Column, k: int = 8) -> Column:
    return sum((F.when(band(a, i, 64 // k) == band(b, i, 64 // k), 1).otherwise(0) for i in range(k)), F.lit(0))


def lsh_pairs(signed: DataFrame, thresh: int = 4) -> DataFrame:
    """(id1, id2), id1 > id2, of (id, sig) that agree in more than ``thresh`` = 4 of 8 bands.

    Of five equal bands of eight, three lie within one half of four. So some half agrees but for one band: joining on the
    eight 24-bit keys (a half without one of its bands) loses nothing, and meets 2**21 times fewer pairs than there are.
    """
    if thresh < 4:
        raise ValueError("the 24-bit keys are exact from thresh = 4 on")
    halves = [band(F.col("sig"), i, 32) for i in range(2)]
    keys = [half.bitwiseAND(F.lit(0xFFFFFFFF ^ (0xFF << 8 * k)).cast("long")) for half in halves for k in range(4)]
    keyed = signed.select("id", "sig", F.posexplode(F.array(*keys)).alias("slot", "key"))
    a, b = keyed.alias("a"), keyed.alias("b")
    met = a.join(b, (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") > F.col("b.id")))
    good = met.where(equal_bands(F.col("a.sig"), F.col("b.sig")) > thresh)
    return good.select(F.col("a.id").alias("id1"), F.col("b.id").alias("id2")).distinct()


def candidate_pairs(names: DataFrame, signature=simhash) -> DataFrame:
    """(id1, id2, name1, name2) of names whose signatures are near."""
    pairs = lsh_pairs(names.select("id", signature(F.col("name")).alias("sig")))
    one, two = names.toDF("id1", "name1"), names.toDF("id2", "name2")
    return pairs.join(one, "id1").join(two, "id2").select("id1", "id2", "name1", "name2")


def close_pairs(pairs: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """(id1, id2) whose strong names are more alike than the cutoff."""
    return pairs.where(edit_similarity(strong_name(F.col("name1")), strong_name(F.col("name2"))) > cutoff).select("id1", "id2")


def firm_groups(close: DataFrame) -> DataFrame:
    """(firm_num, id): components by size, largest first, ties by their smallest id1; numbered from 0."""
    comp = connected_components(close, "id1", "id2")
    heads = close.groupBy("id1").agg(F.lit(1).alias("_")).select(F.col("id1").alias("id"))
    size = comp.groupBy("component").agg(F.count("*").alias("size"))
    first = comp.join(heads, "id").groupBy("component").agg(F.min("id").alias("head"))
    ranked = dense_id(size.join(first, "component"), [F.desc("size"), F.asc("head")], "firm_num")
    return comp.join(ranked, "component").select("firm_num", "id")


def firm_ids(names: DataFrame, groups: DataFrame, base: int = SINGLE_BASE) -> DataFrame:
    """(firm_num, id) of every name; names without a group count from ``base``. More groups than that is an error."""
    top = groups.agg(F.max("firm_num")).first()[0]
    if top is not None and top >= base:
        raise ValueError("more groups than the base of single names")
    return names.select("id").join(groups, "id", "left").select(F.coalesce("firm_num", F.col("id") + base).alias("firm_num"), "id")


def record_firms(matches: DataFrame, firms: DataFrame, id_col: str) -> DataFrame:
    """(id_col, firm_num)."""
    return matches.join(firms, "id").select(id_col, "firm_num")
