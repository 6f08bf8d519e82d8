"""From grants, applications, transfers and accounts to the organisation-by-year panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgpanel.functions.ids import year_of
from orgpanel.operators.relational import full_align, group_mode, prefixed

MEASURES = ["assets", "capx", "cash", "cogs", "deprec", "income", "employ", "intan", "debt", "revenue", "sales", "rnd", "fcost", "mktval"]
COUNTS = ["n_apply", "n_grant", "n_cited", "n_citing", "n_self_cited", "n_source", "n_dest"]


def grant_info(grants: DataFrame, firms: DataFrame, cites: DataFrame, transfers: DataFrame, fees: DataFrame) -> DataFrame:
    """Each grant with its organisation, citations, transfers and fees; missing counts are 0. All joins share one key."""
    out = grants
    for side in (firms, cites, transfers, fees):
        out = out.join(side, "patnum", "left")
    filled = ["n_cited", "n_citing", "n_self_cited", "n_self_citing", "n_trans", "claims"]
    return out.fillna(0, filled).drop("abstract")


def grant_text(grants: DataFrame) -> DataFrame:
    return grants.select("patnum", "title", "abstract")


def firm_years(applies: DataFrame, apply_firm: DataFrame, info: DataFrame, grant_firm: DataFrame, transfers: DataFrame, source_firm: DataFrame, dest_firm: DataFrame, accounts: DataFrame | None = None, account_firm: DataFrame | None = None) -> DataFrame:
    """Counts and sums by organisation and year, aligned over all sources."""
    keys = ["firm_num", "year"]

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(name))

    applied = applies.select("appnum", year_of(F.col("appdate")).alias("year")).join(apply_firm, "appnum")
    granted = info.where("pubdate is not null").select("patnum", year_of(F.col("pubdate")).alias("year"), "n_cited", "n_citing", "n_self_cited").join(grant_firm, "patnum")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_cited", "n_citing", "n_self_cited")]
    granted = granted.dropna(subset=keys).groupBy(*keys).agg(*sums, F.count("*").alias("n_grant"))
    moved = transfers.select("assignid", year_of(F.col("execdate")).alias("year"))
    moved = moved.join(prefixed(source_firm, "source_"), F.col("assignid") == F.col("source_assignid")).join(prefixed(dest_firm, "dest_"), F.col("assignid") == F.col("dest_assignid"))
    frames = [count(applied, "n_apply"), granted, count(moved.select(F.col("source_firm_num").alias("firm_num"), "year"), "n_source"), count(moved.select(F.col("dest_firm_num").alias("firm_num"), "year"), "n_dest")]
    if accounts is not None:
        booked = accounts.join(account_firm, "compid").dropna(subset=keys)
        first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("compid"))).alias(c) for c in ("naics", "sic")]
        frames.append(booked.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in MEASURES], *first))
    return full_align(frames, keys)


def firm_life(years: DataFrame, info: DataFrame) -> DataFrame:
    """First and last year, patents in all, and the most frequent class of each organisation."""
    life = years.where("firm_num is not null").groupBy("firm_num").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.coalesce(F.sum("n_grant"), F.lit(0)).alias("tot_pats"))
    life = life.withColumn("life_span", F.col("year_max") - F.col("year_min") + 1)
    mode = group_mode(info.select("firm_num", F.substring("ipc", 1, 4).alias("ipc4")), "firm_num", "ipc4")
    life = life.join(mode.select("firm_num", F.col("mode").alias("mode_ipc4"), "n"), "firm_num", "left")
    return life.withColumn("mode_ipc4_frac", F.try_divide(F.col("n"), F.col("tot_pats"))).drop("n")


def firm_index(years: DataFrame, life: DataFrame) -> DataFrame:
    """A row for every year from the first to the last of each organisation, with age and the stock of applications."""
    span = life.select("firm_num", "year_min", F.explode(F.sequence("year_min", "year_max")).alias("year"))
    dense = span.join(years, ["firm_num", "year"], "left").fillna(0, [c for c in COUNTS if c in years.columns])
    so_far = Window.partitionBy("firm_num").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn("age", F.col("year") - F.col("year_min")).drop("year_min").withColumn("stock", F.sum("n_apply").over(so_far))
