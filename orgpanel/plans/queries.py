"""Queries over the driver's tables that stand in for patents, each with its SQL.

Organisation = customer, patent = order, citation = (order, part key read as an order), transfers from line items, accounts from
orders, names from customers, suppliers, parts and titles of pages. Files of the source formats are in ``source_queries``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgpanel.functions import ids, names, places, similarity
from orgpanel.operators import clusters, components, panel, relational, transfers
from orgpanel.operators.cites import citation_stats
from orgpanel.operators.maintenance import maintenance_rollup
from orgpanel.operators.transfers import transfer_stats
from orgpanel.storage import materialize, new_path
from orgpanel.streaming.incremental import ingest_new_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patnum"), F.col("o_custkey").alias("firm_num"))


def _cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem")
    return items.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).unionAll(items.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst")))


FIRM_SQL = "SELECT o_orderkey AS patnum, o_custkey AS firm_num FROM orders"
CITE_SQL = "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem"
STATS_SQL = f"""
    WITH firm AS ({FIRM_SQL}), cite AS ({CITE_SQL}),
    ends AS (SELECT c.src, c.dst, CASE WHEN a.firm_num = b.firm_num THEN 1 ELSE 0 END AS own
             FROM cite c LEFT JOIN firm a ON c.src = a.patnum LEFT JOIN firm b ON c.dst = b.patnum),
    s AS (SELECT src AS patnum, 1 AS made, own FROM ends UNION ALL SELECT dst, 0, own FROM ends)
    SELECT patnum, count(*) FILTER (made = 1) AS n_cited, count(*) FILTER (made = 0) AS n_citing,
           CAST(sum(made * own) AS BIGINT) AS n_self_cited, CAST(sum((1 - made) * own) AS BIGINT) AS n_self_citing
    FROM s WHERE patnum IS NOT NULL GROUP BY patnum"""


@query(STATS_SQL)
def cite_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citation_stats(_cites(spark, sf_dir), _firms(spark, sf_dir))


ITEM_ORDER = ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in ITEM_ORDER)}) AS n FROM lineitem) WHERE n = 1""")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_last(_read(spark, sf_dir, "lineitem"), ["l_orderkey"], ITEM_ORDER).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT l_partkey AS patnum, min(strftime(l_shipdate, '%Y%m%d')) AS first_trans, count(*) AS n_trans
    FROM lineitem GROUP BY l_partkey""")
def transfer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "lineitem")
    return transfer_stats(items.select(F.col("l_partkey").alias("patnum"), F.date_format("l_shipdate", "yyyyMMdd").alias("execdate")))


@query("""SELECT user_id AS patnum, CAST(max(lag) AS INTEGER) AS last_maint, NOT bool_and(small) AS ever_large FROM (
        SELECT user_id, CASE event_type WHEN 'view' THEN 4 WHEN 'purchase' THEN 8 WHEN 'signup' THEN 12 END AS lag, value < 50 AS small FROM events)
    WHERE lag IS NOT NULL AND small IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id""")
def maint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_type") == "view", "M170").when(F.col("event_type") == "purchase", "M1552").when(F.col("event_type") == "signup", "M285").otherwise("EXP.")
    events = _read(spark, sf_dir, "events").select(F.col("user_id").alias("patnum"), F.when(F.col("value") < 50, "Y").when(F.col("value").isNotNull(), "N").alias("is_small"), code.alias("event_code"))
    return maintenance_rollup(events)


def _grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("patnum"), F.date_format("o_orderdate", "yyyyMMdd").alias("pubdate"), F.nullif(F.length("o_orderpriority"), F.lit(5)).cast("long").alias("claims"), F.lower("o_orderpriority").alias("ipc"), F.lit("x").alias("abstract"))


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    fees = maint_rollup(spark, sf_dir)
    return panel.grant_info(_grants(spark, sf_dir), _firms(spark, sf_dir), cite_stats(spark, sf_dir), transfer_counts(spark, sf_dir), fees)


INFO_SQL = f"""
    WITH g AS (SELECT o_orderkey AS patnum, strftime(o_orderdate, '%Y%m%d') AS pubdate, nullif(length(o_orderpriority), 5) AS claims, lower(o_orderpriority) AS ipc FROM orders)
    SELECT g.patnum, g.pubdate, CAST(coalesce(g.claims, 0) AS BIGINT) AS claims, g.ipc, f.firm_num,
        coalesce(c.n_cited, 0) AS n_cited, coalesce(c.n_citing, 0) AS n_citing, coalesce(c.n_self_cited, 0) AS n_self_cited, coalesce(c.n_self_citing, 0) AS n_self_citing,
        t.first_trans, coalesce(t.n_trans, 0) AS n_trans, m.last_maint, m.ever_large
    FROM g LEFT JOIN ({FIRM_SQL}) f USING (patnum) LEFT JOIN ({STATS_SQL}) c USING (patnum) LEFT JOIN ({SQL['transfer_counts']}) t USING (patnum) LEFT JOIN ({SQL['maint_rollup']}) m USING (patnum)"""


@query(INFO_SQL)
def star_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _info(spark, sf_dir)


def _years(spark: SparkSession, sf_dir: str, info: DataFrame | None = None, *accounts: DataFrame) -> DataFrame:
    info = info if info is not None else _info(spark, sf_dir)
    o = _read(spark, sf_dir, "orders")
    applies = o.select(F.col("o_orderkey").alias("appnum"), F.date_format("o_orderdate", "yyyyMMdd").alias("appdate"))
    firm = _firms(spark, sf_dir).dropna()
    items = _read(spark, sf_dir, "lineitem").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("assignid"), F.date_format("l_shipdate", "yyyyMMdd").alias("execdate"), "l_orderkey", "l_suppkey")
    moves = items.groupBy("assignid").agg(F.min("execdate").alias("execdate"), F.min("l_orderkey").alias("k"), F.min("l_suppkey").alias("s"))
    source = moves.select("assignid", F.col("k").alias("patnum")).join(firm, "patnum").select("assignid", "firm_num")
    dest = moves.select("assignid", F.col("s").alias("firm_num"))
    return panel.firm_years(applies, firm.withColumnRenamed("patnum", "appnum"), info.drop("firm_num"), firm, moves.select("assignid", "execdate"), source, dest, *accounts)


YEARS_SQL = f"""
    WITH info AS ({INFO_SQL}), firm AS (SELECT * FROM ({FIRM_SQL}) WHERE firm_num IS NOT NULL),
    ap AS (SELECT firm_num, year(o_orderdate) AS year, count(*) AS n_apply FROM orders JOIN firm ON o_orderkey = patnum GROUP BY ALL),
    gr AS (SELECT f.firm_num, CAST(substr(pubdate, 1, 4) AS INTEGER) AS year, CAST(sum(n_cited) AS BIGINT) AS n_cited, CAST(sum(n_citing) AS BIGINT) AS n_citing, CAST(sum(n_self_cited) AS BIGINT) AS n_self_cited, count(*) AS n_grant FROM info i JOIN firm f ON i.patnum = f.patnum GROUP BY ALL),
    mv AS (SELECT l_orderkey || '_' || l_linenumber AS assignid, min(l_shipdate) AS d, min(l_orderkey) AS k, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
    mo AS (SELECT f.firm_num AS a, s AS b, year(d) AS year FROM mv JOIN firm f ON k = f.patnum),
    so AS (SELECT a AS firm_num, year, count(*) AS n_source FROM mo GROUP BY ALL),
    de AS (SELECT b AS firm_num, year, count(*) AS n_dest FROM mo GROUP BY ALL)
    SELECT firm_num, CAST(year AS INTEGER) AS year, n_apply, n_cited, n_citing, n_self_cited, n_grant, n_source, n_dest
    FROM ap FULL JOIN gr USING (firm_num, year) FULL JOIN so USING (firm_num, year) FULL JOIN de USING (firm_num, year)"""


@query(YEARS_SQL)
def firm_year_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _years(spark, sf_dir)


LIFE_SQL = f"""
    WITH info AS ({INFO_SQL}), y AS ({YEARS_SQL}),
    life AS (SELECT firm_num, min(year) AS year_min, max(year) AS year_max, CAST(coalesce(sum(n_grant), 0) AS BIGINT) AS tot_pats FROM y GROUP BY firm_num),
    c AS (SELECT firm_num, substr(ipc, 1, 4) AS ipc4, count(*) AS n FROM info WHERE firm_num IS NOT NULL GROUP BY ALL),
    m AS (SELECT firm_num, ipc4, n, row_number() OVER (PARTITION BY firm_num ORDER BY n DESC, ipc4) AS r FROM c)
    SELECT l.firm_num, year_min, year_max, tot_pats, year_max - year_min + 1 AS life_span, ipc4 AS mode_ipc4, n / nullif(tot_pats, 0) AS mode_ipc4_frac
    FROM life l LEFT JOIN m ON l.firm_num = m.firm_num AND r = 1"""


@query(LIFE_SQL)
def firm_life_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = materialize(_info(spark, sf_dir), "info")
    return panel.firm_life(materialize(_years(spark, sf_dir, info), "years"), info)


@query(f"""
    WITH y AS ({YEARS_SQL}), l AS (SELECT firm_num, min(year) AS a, max(year) AS b FROM y GROUP BY firm_num),
    d AS (SELECT firm_num, a, CAST(unnest(generate_series(a, b)) AS INTEGER) AS year FROM l),
    z AS (SELECT d.firm_num, d.year, d.a, coalesce(n_apply, 0) AS n_apply, coalesce(n_cited, 0) AS n_cited, coalesce(n_citing, 0) AS n_citing, coalesce(n_self_cited, 0) AS n_self_cited,
        coalesce(n_grant, 0) AS n_grant, coalesce(n_source, 0) AS n_source, coalesce(n_dest, 0) AS n_dest FROM d LEFT JOIN y ON d.firm_num = y.firm_num AND d.year = y.year)
    SELECT firm_num, year, n_apply, n_cited, n_citing, n_self_cited, n_grant, n_source, n_dest, year - a AS age,
        CAST(sum(n_apply) OVER (PARTITION BY firm_num ORDER BY year) AS BIGINT) AS stock FROM z""")
def panel_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = materialize(_info(spark, sf_dir), "info")
    years = materialize(_years(spark, sf_dir, info), "years")
    return panel.firm_index(years, panel.firm_life(years, info))


WEAK_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '''s|\(.*\)|\.', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[ ]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {WEAK_SQL.format('text')} AS name FROM documents WHERE text IS NOT NULL")
def weak_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").where("text is not null").select("doc_id", names.weak_name(F.col("text")).alias("name"))


def _strong_sql(column: str) -> str:
    """On ASCII text alone ``\\b`` of RE2 has the meaning of the pattern's edges."""
    out = f"lower({column})"
    for pattern, to in names.STRONG:
        pattern = pattern.replace(names.EDGE, r"\b").replace("'", "''")
        to = to.replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT p_partkey, {_strong_sql('name')} AS name FROM (SELECT p_partkey, p_name || ' a & b c-d co., the ' || p_type || ' inc.' AS name FROM part UNION ALL SELECT p_partkey, p_name || ' x y z holdings ltd' FROM part)")
def strong_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    both = p.select("p_partkey", F.concat("p_name", F.lit(" a & b c-d co., the "), "p_type", F.lit(" inc.")).alias("name")).unionAll(p.select("p_partkey", F.concat("p_name", F.lit(" x y z holdings ltd"))))
    return both.select("p_partkey", names.strong_name(F.col("name")).alias("name"))


TITLE_SQL = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
#: All name columns: table -> (column of the driver's table, the same in Spark)
NAMED = {"customer": ("c_name", "c_name"), "supplier": ("s_name", "s_name"), "part": ("p_name", "p_name"), "pages": (TITLE_SQL, r"regexp_extract(html, r'(?s)<title>(.*?)</title>', 1)")}


def _named(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> DataFrame:
    """Distinct (source, name) of whole name columns."""
    found = [_read(spark, sf_dir, t).select(F.lit(t).alias("source"), F.expr(NAMED[t][1]).alias("name")) for t in tables]
    return reduce(DataFrame.unionAll, found).where("name is not null").distinct()


def _named_sql(tables: tuple[str, ...]) -> str:
    return " UNION ".join(f"SELECT '{t}' AS source, {NAMED[t][0]} AS name FROM {t} WHERE {NAMED[t][0]} IS NOT NULL" for t in tables)


def _type_sql(column: str) -> str:
    """org_type; the edges of words are written out, as ``\\b`` is of ASCII there."""
    n, edge = f"translate({column}, './', '')", r"(^|$|[^\p{L}\p{N}_])"
    word = lambda words: f"regexp_matches({n}, '{edge}({'|'.join(words.split())}){edge}')"
    return f"CASE WHEN {word(names.COMPANY)} OR regexp_matches({n}, '[0-9&()]') OR NOT regexp_matches({n}, '[ ,]') OR length({n}) > 30 THEN 0 WHEN {word(names.INSTITUTION)} THEN 1 ELSE 2 END"


ALL_NAMES, SHORT_NAMES = ("customer", "supplier", "part", "pages"), ("part", "pages")
#: Words behind a name, so that all kinds of parties occur.
ENDINGS = ["", " inc", " university", " gmbh", " association", " co ltd", " holdings plc"]
ENDING_SQL = "(VALUES " + ", ".join(f"({k}, '{e}')" for k, e in enumerate(ENDINGS)) + ")"


def _with_endings(column: str) -> Column:
    return F.explode(F.array(*[F.concat(column, F.lit(e)) for e in ENDINGS])).alias("name")


@query(f"SELECT source, name || ending AS name, {_type_sql('lower(name || ending)')} AS org_type FROM ({_named_sql(ALL_NAMES)}), {ENDING_SQL} e(k, ending)")
def org_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole names of customers, suppliers, parts and pages, with each ending."""
    ended = _named(spark, sf_dir, ALL_NAMES).select("source", _with_endings("name"))
    return ended.select("source", "name", names.org_type(F.lower("name")).alias("org_type"))


# Transfers: a line item passes from the party named by its part to the one named by its supplier's number.
DEAL_SQL = f"""
    SELECT l_orderkey || '_' || (l_linenumber // 2) AS assignid, l_partkey AS patnum, strftime(l_shipdate, '%Y%m%d') AS execdate,
        CASE l_returnflag WHEN 'A' THEN 'assignment of assignors interest' WHEN 'R' THEN 'security agreement' ELSE 'merger' END AS conveyance,
        p.p_name || e.ending AS assignor, q.p_name || ' corp' AS assignee, l_linenumber, l_suppkey, l_quantity, l_extendedprice
    FROM lineitem JOIN part p ON l_partkey = p.p_partkey JOIN part q ON l_suppkey = q.p_partkey JOIN {ENDING_SQL} e(k, ending) ON l_linenumber - 1 = e.k"""


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, part = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part")
    flag = F.when(F.col("l_returnflag") == "A", "assignment of assignors interest").when(F.col("l_returnflag") == "R", "security agreement").otherwise("merger")
    ends = F.element_at(F.array(*map(F.lit, ENDINGS)), F.col("l_linenumber"))
    joined = items.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("giver")), "l_partkey").join(part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_name").alias("taker")), "l_suppkey")
    return joined.select(
        F.concat_ws("_", "l_orderkey", F.floor(F.col("l_linenumber") / 2)).alias("assignid"), F.col("l_partkey").alias("patnum"), F.date_format("l_shipdate", "yyyyMMdd").alias("execdate"), flag.alias("conveyance"),
        F.concat("giver", ends).alias("assignor"), F.concat("taker", F.lit(" corp")).alias("assignee"), "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
        F.lower(F.lit("Texas")).alias("assignee_state"), F.lit("germany").alias("assignee_country"),
    )


CONVEY_SQL = "CASE WHEN regexp_matches({0}, 'change|secur|correct|release|lien|update|nunc|collat') THEN 3 WHEN contains({0}, 'assign') THEN 0 WHEN contains({0}, 'license') THEN 1 WHEN contains({0}, 'merge') THEN 2 ELSE 3 END"
REAL_SQL = f"SELECT * FROM ({DEAL_SQL}) WHERE {_type_sql('assignor')} <> 2 AND {_type_sql('assignee')} <> 2 AND {CONVEY_SQL.format('conveyance')} <> 3"


@query(f"SELECT assignid, patnum, assignor, assignee, conveyance, l_linenumber, l_suppkey FROM ({REAL_SQL})")
def real_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers.real_transfers(_deals(spark, sf_dir)).select("assignid", "patnum", "assignor", "assignee", "conveyance", "l_linenumber", "l_suppkey")


def _same_sql(a: str, b: str) -> str:
    return f"(length({a}) - length(translate({a}, {b}, ''))) / greatest(1.0, 0.5 * (length({a}) + length({b}))) > 0.5"


DEAL_ORDER = ["l_linenumber", "execdate", "patnum", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY assignid ORDER BY {', '.join(c + ' DESC' for c in DEAL_ORDER)}) AS r FROM ({REAL_SQL})) WHERE r = 1),
    s AS (SELECT *, {_strong_sql('assignor')} AS a, {_strong_sql('assignee')} AS b FROM last)
    SELECT assignid, patnum, execdate, assignor, assignee, 'tx' AS assignee_state, 'de' AS assignee_country FROM s WHERE NOT ({_same_sql('a', 'b')})""")
def used_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfers in use: the last record of each id, between different entities, with codes of places."""
    kept = transfers.prune_transfers(transfers.real_transfers(_deals(spark, sf_dir)), DEAL_ORDER)
    return kept.select("assignid", "patnum", "execdate", "assignor", "assignee", "assignee_state", "assignee_country")


@query(f"""WITH n AS (SELECT DISTINCT assignor AS a, assignee AS b FROM ({DEAL_SQL})), s AS (SELECT *, {_strong_sql('a')} AS x, {_strong_sql('b')} AS y FROM n)
    SELECT a, b, {_same_sql('x', 'y')} AS same FROM s""")
def same_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _deals(spark, sf_dir).select(F.col("assignor").alias("a"), F.col("assignee").alias("b")).distinct()
    return pairs.select("a", "b", names.same_entity(F.col("a"), F.col("b")).alias("same"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, 'change|secur|correct|release|lien|update|nunc|collat') THEN 3
        WHEN contains(t, 'assign') THEN 0 WHEN contains(t, 'license') THEN 1 WHEN contains(t, 'merge') THEN 2 ELSE 3 END AS convey_type
    FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)""")
def convey_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", names.convey_type(F.lower("text")).alias("convey_type"))


@query(r"""WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 'D0' || o_orderkey WHEN 1 THEN '0' || o_orderkey || '12345' WHEN 2 THEN 're00' || o_orderkey || 'x' WHEN 3 THEN 'abc' || o_orderkey ELSE '000' || o_orderkey END AS raw FROM orders),
    m AS (SELECT k, raw, regexp_extract(raw, '^([a-zA-Z]{1,2}|0)?([0-9]+)', 1) AS p, regexp_extract(raw, '^([a-zA-Z]{1,2}|0)?([0-9]+)', 2) AS d FROM r)
    SELECT k, CASE WHEN p = '0' OR d = '' THEN '' ELSE p END || ltrim(substr(CASE WHEN d = '' THEN raw ELSE d END, 1, 7), '0') AS patnum FROM m""")
def id_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    forms = {0: F.concat(F.lit("D0"), k), 1: F.concat(F.lit("0"), k, F.lit("12345")), 2: F.concat(F.lit("re00"), k, F.lit("x")), 3: F.concat(F.lit("abc"), k)}
    raw = F.concat(F.lit("000"), k)
    for m, form in forms.items():
        raw = F.when(F.col("o_orderkey") % 5 == m, form).otherwise(raw)
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), ids.prune_number(raw).alias("patnum"))


@query("""SELECT p_partkey AS k, CASE WHEN length(c) >= 8 THEN substr(c, 1, 4) || replace(substr(c, 5, 3), ' ', '0') || '/' || substr(c, 8) ELSE c END AS ipc,
        rpad(CAST(p_size AS VARCHAR), 6, '0') AS naics, lpad(CAST(p_size AS VARCHAR), 3, '0') AS filled FROM (SELECT *, substr(lower(p_type), 1, 4 + p_partkey % 8) AS c FROM part)""")
def code_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.substring(F.lower("p_type"), F.lit(1), (4 + F.col("p_partkey") % 8).cast("int"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), ids.pad_class(c).alias("ipc"), ids.industry_code(F.col("p_size")).alias("naics"), ids.zero_fill(F.col("p_size").cast("string"), 3).alias("filled"))


def _place_sql(table: dict[str, str]) -> str:
    values = ", ".join("('" + k.replace("'", "''") + f"', '{v}')" for k, v in table.items())
    return f"(VALUES {values})"


#: All names of both tables as they are, with a capital, and some that no table has.
PLACES = sorted({n for t in (places.STATES, places.COUNTRIES) for n in t})
PLACE_NAMES = PLACES + [n.title() for n in PLACES] + ["atlantis", "", " texas"]
LISTED_SQL = "SELECT unnest([" + ", ".join("'" + n.replace("'", "''") + "'" for n in PLACE_NAMES) + "]) AS name"


@query(f"""SELECT n.name, s.code AS state, c.code AS country, l.code AS low_state FROM ({LISTED_SQL}) n LEFT JOIN {_place_sql(places.STATES)} s(name, code) ON s.name = n.name
    LEFT JOIN {_place_sql(places.COUNTRIES)} c(name, code) ON c.name = n.name LEFT JOIN {_place_sql(places.STATES)} l(name, code) ON l.name = lower(n.name)""")
def place_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.createDataFrame([(x,) for x in PLACE_NAMES], "name string")
    return n.select("name", places.state_code(F.col("name")).alias("state"), places.country_code(F.col("name")).alias("country"), places.state_code(F.lower("name")).alias("low_state"))


def _weak_sql(tables: tuple[str, ...]) -> str:
    return f"SELECT DISTINCT {WEAK_SQL.format('name')} AS name FROM ({_named_sql(tables)})"


SHINGLE_SQL = "CASE WHEN length(name) >= 2 THEN [substr(name, i, 2) for i in range(1, length(name))] ELSE [name] END"


def _names(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> DataFrame:
    """Distinct weak names of whole name columns."""
    return _named(spark, sf_dir, tables).select(names.weak_name(F.col("name")).alias("name")).distinct()


@query(f"SELECT name, len(s) AS n, array_to_string(s, '|') AS shingles, round(list_sum([CASE WHEN len(s) = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - i / (len(s) - 1) END for i in range(0, len(s))]), 6) AS weight FROM (SELECT name, {SHINGLE_SQL} AS s FROM ({_weak_sql(ALL_NAMES)}))")
def name_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shingled(_names(spark, sf_dir, ALL_NAMES))


def _shingled(found: DataFrame) -> DataFrame:
    s = found.select("name", similarity.shingles(F.col("name")).alias("s"))
    return s.select("name", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("shingles"), F.round(F.aggregate(similarity.decay(F.col("s")), F.lit(0.0), lambda a, x: a + x), 6).alias("weight"))


def md5_signature(name) -> Column:
    """The signature with md5 for its hash, which SQL has too; the xxHash64 one is in ``simhash_vectors``."""
    s, w = similarity.shingles(name), similarity.words(name)
    return similarity.simhash_native(F.concat(s, w), F.concat(similarity.decay(s), similarity.decay(w)))


def _signed(spark: SparkSession, sf_dir: str, tables: tuple[str, ...]) -> DataFrame:
    return _names(spark, sf_dir, tables).where("name != ''").select("name", md5_signature(F.col("name")).alias("sig"))


def _sign_sql(names_sql: str) -> str:
    return SIGN_SQL.replace("{names}", names_sql)


SIGN_SQL = rf"""
    WITH n AS ({{names}}), f AS (
        SELECT name, unnest(s) AS g, unnest(range(0, len(s))) AS i, len(s) AS c FROM (SELECT name, {SHINGLE_SQL} AS s FROM n WHERE name <> '')
        UNION ALL SELECT name, unnest(w), unnest(range(0, len(w))), len(w) FROM (SELECT name, regexp_extract_all(name, '\S+') AS w FROM n WHERE name <> '')),
    h AS (SELECT name, ('0x' || substr(md5(g), 1, 16))::UBIGINT AS h, CAST(round((CASE WHEN c = 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - i / (c - 1) END) * 1000000) AS BIGINT) AS w FROM f),
    b AS (SELECT name, j, sum(CASE WHEN (h >> j) & 1 = 1 THEN w ELSE -w END) AS v FROM h, range(0, 64) r(j) GROUP BY name, j),
    sig AS (SELECT name, CAST(sum(CASE WHEN v >= 0 THEN (1::UBIGINT << j)::HUGEINT ELSE 0 END) AS HUGEINT) AS u FROM b GROUP BY name)
    SELECT name, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS sig, u FROM sig"""


@query(f"SELECT name, sig FROM ({_sign_sql(_weak_sql(ALL_NAMES))})")
def simhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir, ALL_NAMES)


def _pair_sql(names_sql: str) -> str:
    equal = " + ".join(f"CASE WHEN (a.x >> {8 * k}) & 255 = (b.x >> {8 * k}) & 255 THEN 1 ELSE 0 END" for k in range(8))
    return f"""
    WITH s AS (SELECT *, u::UBIGINT AS x FROM ({_sign_sql(names_sql)})), p AS (SELECT a.name AS name1, b.name AS name2, {equal} AS e FROM s a JOIN s b ON a.name > b.name)
    SELECT name1, name2 FROM p WHERE e > 4"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = materialize(relational.dense_id(_signed(spark, sf_dir, SHORT_NAMES), ["name"]), "signed")
    pairs = clusters.lsh_pairs(n.select("id", "sig"))
    named = n.select("id", "name")
    return pairs.join(named.toDF("id1", "name1"), "id1").join(named.toDF("id2", "name2"), "id2")


# Pairs are of names of parts and pages: those of customers differ in their numbers alone, so nearly all of them are pairs.
@query(_pair_sql(_weak_sql(SHORT_NAMES)))
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("name1", "name2")


def _letters_sql(column: str) -> str:
    """levenshtein counts bytes there: letters beyond ASCII become characters that no normal form has."""
    return f"translate({column}, 'áàâäãåæçéèêëíìîïñóòôöõøœßúùûüýÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&')"


def _alike_sql(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0 ELSE 1.0::DOUBLE - levenshtein({_letters_sql(a)}, {_letters_sql(b)})::DOUBLE / greatest(length({a}), length({b})) END > 0.85::DOUBLE"


CLOSE_SQL = f"SELECT name1, name2 FROM ({_pair_sql(_weak_sql(SHORT_NAMES))}) WHERE {_alike_sql('name1', 'name2')}"


def _close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where(similarity.edit_similarity(F.col("name1"), F.col("name2")) > 0.85)


@query(CLOSE_SQL)
def close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _close(spark, sf_dir).select("name1", "name2")


def _component_sql(close: str) -> str:
    """(a, head): each end of the pairs (name1, name2) and the least name that it reaches."""
    return f"""WITH RECURSIVE e AS (SELECT name1 AS a, name2 AS b FROM ({close}) UNION ALL SELECT name2, name1 FROM ({close})),
    r AS (SELECT a, a AS m FROM e UNION SELECT e.a, r.m FROM r JOIN e ON e.b = r.a)
    SELECT a, min(m) AS head FROM r GROUP BY a"""


@query(f"SELECT a AS name, head, count(*) OVER (PARTITION BY head) AS size FROM ({_component_sql(CLOSE_SQL)})")
def name_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = materialize(_close(spark, sf_dir), "close")
    c = components.connected_components(close, "id1", "id2")
    named = close.select(F.col("id1").alias("id"), F.col("name1").alias("name")).unionAll(close.select("id2", "name2")).distinct()
    # ids follow the order of names, so the smallest id is the smallest name
    heads = named.toDF("component", "head")
    sizes = c.groupBy("component").agg(F.count("*").alias("size"))
    return c.join(sizes, "component").join(named, "id").join(heads, "component").select("name", "head", "size")


# The verbs of clustering as they are, over the parties of transfers; names of parts with each ending are near each other and alike.
PARTY_SQL = f"SELECT DISTINCT {WEAK_SQL.format('p_name || ending')} AS name FROM part, {ENDING_SQL} e(k, ending)"
ID_SQL = f"SELECT row_number() OVER (ORDER BY name) - 1 AS id, name FROM ({PARTY_SQL})"
FIRM_PAIR_SQL = f"SELECT a.id AS id1, b.id AS id2, name1, name2 FROM ({_pair_sql(PARTY_SQL)}) JOIN ({ID_SQL}) a ON a.name = name1 JOIN ({ID_SQL}) b ON b.name = name2"
ALIKE_SQL = f"SELECT id1, id2 FROM (SELECT *, {_strong_sql('name1')} AS s1, {_strong_sql('name2')} AS s2 FROM ({FIRM_PAIR_SQL})) WHERE {_alike_sql('s1', 's2')}"
GROUP_SQL = f"""
    WITH alike AS MATERIALIZED ({ALIKE_SQL}), c AS ({_component_sql('SELECT id1 AS name1, id2 AS name2 FROM alike')}), h AS (SELECT head, min(a) AS first, any_value(size) AS size FROM
        (SELECT *, count(*) OVER (PARTITION BY head) AS size FROM c) WHERE a IN (SELECT id1 FROM alike) GROUP BY head),
    k AS (SELECT head, row_number() OVER (ORDER BY size DESC, first) - 1 AS firm_num FROM h)
    SELECT firm_num, a AS id FROM c JOIN k USING (head)"""


def _party_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parties = _read(spark, sf_dir, "part").select(_with_endings("p_name"))
    return materialize(clusters.name_ids([parties]), "names")


def _firm_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = _party_names(spark, sf_dir)
    return found, materialize(clusters.close_pairs(clusters.candidate_pairs(found, md5_signature)), "alike")


@query(FIRM_PAIR_SQL)
def firm_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.candidate_pairs(_party_names(spark, sf_dir), md5_signature)


@query(ALIKE_SQL)
def firm_close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _firm_pairs(spark, sf_dir)[1]


@query(GROUP_SQL)
def firm_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.firm_groups(_firm_pairs(spark, sf_dir)[1])


NUMBER_SQL = f"SELECT coalesce(firm_num, id + 1000000) AS firm_num, id FROM ({ID_SQL}) LEFT JOIN ({GROUP_SQL}) USING (id)"


@query(NUMBER_SQL)
def firm_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, close = _firm_pairs(spark, sf_dir)
    return clusters.firm_ids(found, clusters.firm_groups(close))


@query(f"""SELECT DISTINCT assignid, l_linenumber, firm_num FROM (SELECT *, {WEAK_SQL.format('assignor')} AS name FROM ({DEAL_SQL})) d JOIN ({ID_SQL}) n USING (name) JOIN ({NUMBER_SQL}) f ON f.id = n.id""")
def record_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transfer with the number of its assignor's organisation."""
    found, close = _firm_pairs(spark, sf_dir)
    deals = _deals(spark, sf_dir).select(F.struct("assignid", "l_linenumber").alias("key"), "assignor")
    matches = clusters.name_matches(deals, "key", "assignor", found)
    return clusters.record_firms(matches, clusters.firm_ids(found, clusters.firm_groups(close)), "key").select("key.*", "firm_num").distinct()


# Accounts: every order is a row of its customer's accounts in its year.
BOOK_SQL = """SELECT o_orderkey AS compid, CAST(year(o_orderdate) AS INTEGER) AS year, floor(o_totalprice) AS price, nullif(substr(o_orderpriority, 1, 1), '1') AS naics, o_orderstatus AS sic, o_custkey AS firm_num FROM orders"""


@query(f"""WITH b AS ({BOOK_SQL}), s AS (SELECT firm_num, year, {', '.join(f'sum(price * {k + 1}) AS {m}' for k, m in enumerate(panel.MEASURES))},
        min_by(naics, compid) FILTER (naics IS NOT NULL) AS naics, min_by(sic, compid) FILTER (sic IS NOT NULL) AS sic FROM b GROUP BY ALL)
    SELECT * FROM ({YEARS_SQL}) FULL JOIN s USING (firm_num, year)""")
def firm_year_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with accounts: sums of all measures, and the first industry codes."""
    o = _read(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("double")
    accounts = o.select(F.col("o_orderkey").alias("compid"), F.year("o_orderdate").alias("year"), *[(price * (k + 1)).alias(m) for k, m in enumerate(panel.MEASURES)], F.nullif(F.substring("o_orderpriority", 1, 1), F.lit("1")).alias("naics"), F.col("o_orderstatus").alias("sic"))
    return _years(spark, sf_dir, None, accounts, o.select(F.col("o_orderkey").alias("compid"), F.col("o_custkey").alias("firm_num")))


@query("""WITH s AS (SELECT lower(c_name) AS raw, 0 AS src FROM customer UNION ALL SELECT lower(s_name), 1 FROM supplier),
    n AS (SELECT trim(replace(raw, '#', ' ')) AS name, min(src) AS src FROM s GROUP BY 1)
    SELECT row_number() OVER (ORDER BY src, name) - 1 AS id, name FROM n""")
def name_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "supplier")
    return clusters.name_ids([c.select(F.col("c_name").alias("name")), s.select(F.col("s_name").alias("name"))])


@query(r"SELECT page_id, lower(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ')) AS title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n_links FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.lower(F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)))
    links = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long")
    return _read(spark, sf_dir, "pages").select("page_id", title.alias("title"), links.alias("n_links"))


@query("""SELECT conv_id, array_to_string(list(role ORDER BY first), '; ') AS roles, CAST(sum(n) AS BIGINT) AS n_turns FROM (
    SELECT conv_id, role, min(turn) AS first, count(*) AS n FROM conversations GROUP BY ALL) GROUP BY conv_id""")
def owners_distinct_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), "; ").alias("roles"), F.size("t").cast("long").alias("n_turns"))


@query("SELECT count(*) AS n_rows, sum(o_orderkey) AS key_sum FROM orders")
def noop_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    orders.write.format("noop").mode("overwrite").save()
    return orders.agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").cast("decimal(38,0)").alias("key_sum"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the file stream: a folder is drained twice, the second run finds nothing new."""
    source, target, seen = (new_path(spark, x) for x in ("incoming", "ingested", "seen"))
    events = _read(spark, sf_dir, "events")
    events.write.parquet(source)
    kind = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    for _ in range(2):
        ingest_new_files(spark, source, target, seen, kind)
    return spark.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"))
