"""Registry-shaped tables derived from the given star schema, and their SQL twins.

Every table is a plain DataFrame over the parquet files; the SQL text beside it builds the
same rows in an ANSI engine so that each query can be checked against it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.constants import SEGMENTS
from rollbook.functions.calendar import quarter_of
from rollbook.functions.keys import suffix_text as wide_suffix
from rollbook.operators.diff import period_index
from rollbook.operators.directory import latest_version
from rollbook.operators.rules import adjust_snapshot, gap_fill
from rollbook.session import materialise
from rollbook.sources.lines import parse_adjust_line

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is inferred once: each inference is a job of its own."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def plain_types(df: DataFrame) -> DataFrame:
    """Integers as bigint, decimals as double, dates and timestamps as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL twin when there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain_types(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


# --- snapshot -------------------------------------------------------------------------


def _segment(size: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (size % 7) + 1)


def _newest(lines: DataFrame, *group: str) -> DataFrame:
    """The newest line of every group.

    Spark keeps one line per group and task before the shuffle (a window group limit), so
    a group with a third of all lines costs one row per task.
    """
    order = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return lines.withColumn("n", F.row_number().over(w)).where(F.col("n") == 1).drop("n")


def snapshot(spark: SparkSession, sf_dir: str, owner: str = "N", segment: bool = False) -> DataFrame:
    """One row per (key, period): the last line of a part in a quarter."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"),
        (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("quarter"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_returnflag",
    )
    last = _newest(lines, "key", "quarter")
    nation = table(spark, sf_dir, "nation")  # 25 rows by definition of the schema
    region = table(spark, sf_dir, "region")  # 5 rows by definition of the schema
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    code = F.lpad(F.col("s_nationkey").cast("string"), 2, "0")
    rows = last.join(supplier, "l_suppkey")
    if owner == "R":
        names = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("s_nationkey"), "r_name"
        )
        rows = rows.join(F.broadcast(names), "s_nationkey")
        holder = F.col("r_name")
    else:
        holder = code
    cols = [
        "key",
        quarter_of(F.col("l_shipdate")).alias("period"),
        F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("status"),
        holder.alias("owner"),
        F.concat(code, F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0")).alias("sub_owner"),
        F.col("l_shipdate").cast("date").alias("changed_at"),
    ]
    if segment:
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), _segment(F.col("p_size")).alias("segment"))
        rows = rows.join(part, "key")
        cols.append("segment")
    return rows.select(*cols)


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period, idx, n_periods), from the one column of the lines that holds the time."""
    return period_index(table(spark, sf_dir, "lineitem").select(quarter_of(F.col("l_shipdate")).alias("period")))


def dated(spark: SparkSession, sf_dir: str, owner: str = "N", segment: bool = False) -> tuple[DataFrame, DataFrame]:
    """The snapshot table and its periods. These are read from the lines once and written: a
    plan uses them more than once."""
    return snapshot(spark, sf_dir, owner, segment), materialise(periods(spark, sf_dir), "periods")


_SNAP = """
last_line AS (
  SELECT * FROM (
    SELECT l_partkey AS key, year(l_shipdate) || '-Q' || quarter(l_shipdate) AS period, l_suppkey, l_returnflag, l_shipdate,
           row_number() OVER (PARTITION BY l_partkey, year(l_shipdate), quarter(l_shipdate)
             ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_returnflag DESC) AS rn
    FROM lineitem) WHERE rn = 1),
snap AS (
  SELECT l.key, l.period, dense_rank() OVER (ORDER BY l.period) AS idx,
         CAST(CASE l.l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS BIGINT) AS status,
         {owner} AS owner,
         lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') || lpad(CAST(l.l_suppkey % 1000 AS VARCHAR), 3, '0') AS sub_owner,
         CAST(l.l_shipdate AS DATE) AS changed_at{segment}
  FROM last_line l JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey{part})"""

_SEG_SQL = ",\n         CAST([800,833,844,855,866,877,888][p.p_size % 7 + 1] AS BIGINT) AS segment"


def snap_sql(owner: str = "N", segment: bool = False) -> str:
    return _SNAP.format(
        owner="r.r_name" if owner == "R" else "lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0')",
        segment=_SEG_SQL if segment else "",
        part=" JOIN part p ON p.p_partkey = l.key" if segment else "",
    )


# All pairs of consecutive periods as full outer joins.
CHANGES_SQL = """
chg AS (
  SELECT coalesce(b.key, a.key) AS key, coalesce(b.idx, a.idx + 1) AS idx,
         a.owner AS a_owner, a.status AS a_st, a.sub_owner AS a_sub,
         b.owner AS b_owner, b.status AS b_st, b.sub_owner AS b_sub
  FROM snap a FULL OUTER JOIN snap b ON a.key = b.key AND a.idx + 1 = b.idx
  WHERE coalesce(b.idx, a.idx + 1) BETWEEN 2 AND (SELECT max(idx) FROM snap)),
per AS (SELECT DISTINCT period, idx, CAST(substr(period, 1, 4) AS BIGINT) * 12 + CAST(substr(period, 7, 1) AS BIGINT) * 3 AS mno FROM snap)"""

ROLLUP_SQL = CHANGES_SQL + """,
got AS (
  SELECT b_owner AS owner, idx, count(*) AS inventory,
         count(*) FILTER (WHERE a_owner IS NULL) AS appeared,
         count(*) FILTER (WHERE a_owner <> b_owner) AS t_in,
         count(*) FILTER (WHERE a_owner <> b_owner AND a_st = 3) AS harv,
         count(*) FILTER (WHERE a_owner = b_owner AND a_st = 3 AND b_st = 1) AS reac
  FROM chg WHERE b_owner IS NOT NULL GROUP BY 1, 2),
gave AS (
  SELECT a_owner AS owner, idx, count(*) FILTER (WHERE b_owner IS NULL) AS gone,
         count(*) FILTER (WHERE a_owner <> b_owner) AS t_out
  FROM chg WHERE a_owner IS NOT NULL GROUP BY 1, 2),
roll AS (
  SELECT owner, p.period, p.mno - q.mno AS months_covered, coalesce(inventory, 0) AS inventory,
         coalesce(appeared, 0) + coalesce(t_in, 0) AS acquired, coalesce(gone, 0) + coalesce(t_out, 0) AS lost,
         coalesce(t_in, 0) AS transfers_in, coalesce(t_out, 0) AS transfers_out,
         coalesce(harv, 0) AS harvested_cross_owner, coalesce(reac, 0) AS harvested_own_reactivation,
         coalesce(appeared, 0) AS appeared_from_spare, coalesce(gone, 0) AS disappeared_to_spare
  FROM got FULL OUTER JOIN gave USING (owner, idx) JOIN per p USING (idx) JOIN per q ON q.idx = p.idx - 1
  UNION ALL
  SELECT owner, period, 0, count(*), 0, 0, 0, 0, 0, 0, 0, 0 FROM snap WHERE idx = 1 GROUP BY owner, period)"""

EDGES_SQL = CHANGES_SQL + """,
edges AS (
  SELECT p.period AS curr_period,
    CASE WHEN a_owner IS NULL THEN 'SPARE' WHEN kind IN ('REACTIVATE', 'HARVEST') THEN 'DISC' ELSE a_owner END AS from_node,
    CASE WHEN b_owner IS NULL THEN 'SPARE' WHEN kind = 'DISCONNECT' THEN 'DISC' ELSE b_owner END AS to_node,
    kind AS edge_type, CASE WHEN kind = 'HARVEST' THEN a_owner END AS former_owner, count(*) AS n
  FROM (SELECT *, CASE WHEN a_owner IS NULL THEN 'FIRST_ASSIGN' WHEN b_owner IS NULL THEN 'TO_SPARE'
          WHEN a_owner = b_owner AND a_st = 3 AND b_st = 1 THEN 'REACTIVATE'
          WHEN a_owner = b_owner AND a_st <> 3 AND b_st = 3 THEN 'DISCONNECT'
          WHEN a_owner <> b_owner AND a_st = 3 THEN 'HARVEST'
          WHEN a_owner <> b_owner THEN 'TRANSFER' END AS kind FROM chg) JOIN per p USING (idx)
  WHERE kind IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def with_snap(body: str, select: str, owner: str = "N", segment: bool = False) -> str:
    body = f",{body}" if body else ""
    return f"WITH{snap_sql(owner, segment)}{body}\n{select}"


# --- current keys, dictionary, ages ---------------------------------------------------


def current_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest line of every key: owner, codes, status, segment, suffix."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "key")
    last = _newest(lines, "key")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), _segment(F.col("p_size")).alias("segment"))
    code = F.lpad(F.col("s_nationkey").cast("string"), 2, "0")
    digits = wide_suffix(F.col("key"))
    return (
        last.join(part, "key")
        .join(supplier, "l_suppkey")
        .select(
            "key",
            "segment",
            digits.alias("digits"),
            F.concat(F.col("segment").cast("string"), digits).alias("phone"),
            F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("status"),
            code.alias("owner"),
            F.concat(code, F.lpad((F.col("l_suppkey") % 1000).cast("string"), 3, "0")).alias("sub_owner"),
            F.col("l_shipdate").cast("date").alias("changed_at"),
        )
    )


CURRENT_SQL = """
cur AS (
  SELECT l.key, CAST([800,833,844,855,866,877,888][p.p_size % 7 + 1] AS BIGINT) AS segment,
         format('{:07d}', l.key) AS digits,
         CAST([800,833,844,855,866,877,888][p.p_size % 7 + 1] AS VARCHAR) || format('{:07d}', l.key) AS phone,
         CAST(CASE l.l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS BIGINT) AS status,
         lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') AS owner,
         lpad(CAST(s.s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(l.l_suppkey % 1000 AS VARCHAR), 3, '0') AS sub_owner,
         CAST(l.l_shipdate AS DATE) AS changed_at
  FROM (SELECT l_partkey AS key, *, row_number() OVER (PARTITION BY l_partkey
          ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_returnflag DESC) AS rn FROM lineitem) l
  JOIN part p ON p.p_partkey = l.key JOIN supplier s ON s.s_suppkey = l.l_suppkey WHERE rn = 1)"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per suffix: the name of each part up to size 40, and its brand when the size is even."""
    part = table(spark, sf_dir, "part").where(F.col("p_size") <= 40)
    digits = wide_suffix(F.col("p_partkey"))
    names = part.select(
        digits.alias("digits"),
        F.upper("p_name").alias("word"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("Kind "), F.col("p_type")).alias("label"),
        F.when(F.col("p_size") != 7, F.col("p_retailprice")).alias("score"),
        F.when(F.col("p_size") != 9, F.col("p_size").cast("long")).alias("word_rank"),
    )
    brands = part.where(F.col("p_size") % 2 == 0).select(
        digits.alias("digits"),
        F.upper("p_brand").alias("word"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_brand")).alias("category"),
        F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("Brand "), F.col("p_brand"))).alias("label"),
        (F.col("p_retailprice") / 2).alias("score"),
        (F.col("p_size") + 50).cast("long").alias("word_rank"),
    )
    return names.unionByName(brands)


DICTIONARY_SQL = """
dict AS (
  SELECT format('{:07d}', p_partkey) AS digits, upper(p_name) AS word, p_type AS category,
         'Kind ' || p_type AS label, CASE WHEN p_size <> 7 THEN p_retailprice END AS score,
         CAST(CASE WHEN p_size <> 9 THEN p_size END AS BIGINT) AS word_rank FROM part WHERE p_size <= 40
  UNION ALL
  SELECT format('{:07d}', p_partkey), upper(p_brand), CASE WHEN p_size % 10 <> 0 THEN p_brand END,
         CASE WHEN p_size % 10 <> 0 THEN 'Brand ' || p_brand END, p_retailprice / 2, CAST(p_size + 50 AS BIGINT)
  FROM part WHERE p_size <= 40 AND p_size % 2 = 0)"""


def key_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a key of the supplier's nation: suffix, status and age in months.

    Lines of the oldest year stand for entries without a readable date: their age is NULL.
    """
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
    newest = table(spark, sf_dir, "lineitem").agg(
        F.max(F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("now"), F.min(F.year("l_shipdate")).alias("oldest")
    )
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    ends = newest.select(F.struct("now", "oldest").alias("e")).scalar()
    return line.join(supplier, "l_suppkey").select(
        F.col("l_partkey").alias("key"),
        wide_suffix(F.col("l_partkey")).alias("digits"),
        F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("owner"),
        F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("status"),
        F.when(
            F.year("l_shipdate") > ends.getField("oldest"),
            ends.getField("now") - (F.year("l_shipdate") * 12 + F.month("l_shipdate")),
        ).alias("age_months"),
    )


AGES_SQL = """
ages AS (
  SELECT l_partkey AS key, format('{:07d}', l_partkey) AS digits,
         lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS owner, CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS status,
         CASE WHEN year(l_shipdate) > (SELECT min(year(l_shipdate)) FROM lineitem) THEN
           (SELECT max(year(l_shipdate) * 12 + month(l_shipdate)) FROM lineitem) - (year(l_shipdate) * 12 + month(l_shipdate)) END AS age_months
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)"""


# --- memberships ----------------------------------------------------------------------


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, category): market segments in which a nation has more customers than on average."""
    counts = (
        table(spark, sf_dir, "customer")
        .groupBy("c_nationkey", F.col("c_mktsegment").alias("category"))
        .agg(F.count("*").alias("n"))
    )
    mean = counts.groupBy("c_nationkey").agg(F.avg("n").alias("mean"))
    return (
        counts.join(mean, "c_nationkey")
        .where(F.col("n") > F.col("mean"))
        .select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("owner"), "category")
    )


MEMBERSHIP_SQL = """
mcount AS (SELECT c_nationkey, c_mktsegment AS category, count(*) AS n FROM customer GROUP BY 1, 2),
member AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS owner, category FROM mcount
  WHERE n > (SELECT avg(n) FROM mcount m WHERE m.c_nationkey = mcount.c_nationkey))"""

# Literal override list: owners that belong to a group although no document says so.
GROUP_OVERRIDES = {"EUROPE": ["00", "01"], "ASIA": ["24"]}


def group_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group, owner): the region of a nation that has suppliers, and the overrides."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    supplied = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    declared = (
        nation.join(supplied, "n_nationkey", "left_semi")
        .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("group"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("owner"))
    )
    extra = spark.createDataFrame(
        [(g, o) for g, owners in GROUP_OVERRIDES.items() for o in owners], "`group` string, owner string"
    )
    return declared.unionByName(extra).distinct()


GROUPS_SQL = """
gmember AS (SELECT DISTINCT r_name AS "group", lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS owner
  FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)
  UNION SELECT * FROM (VALUES ('EUROPE', '00'), ('EUROPE', '01'), ('ASIA', '24')) AS t(g, o))"""


# --- directory documents --------------------------------------------------------------

# Literal curated lists: categories as (id, slug, title).
CATEGORIES = [
    ("cat-0", "carrier", "Carrier"),
    ("cat-1", "reseller", "Reseller"),
    ("cat-2", "broker", "Broker"),
    ("cat-3", "wireless", "Wireless"),
    ("cat-4", "cable", "Cable"),
    ("cat-unknown", "unknown", "Unknown"),
    ("cat-hidden", "hidden", "Hidden"),
    ("cat-dead", "dead", "Dormant"),
]


def category_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "id string, slug string, title string")


def group_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("grp-"), F.col("r_regionkey").cast("string")).alias("id"),
        F.lower("r_name").alias("slug"),
        F.col("r_name").alias("title"),
    )


def _refs(*refs: Column) -> Column:
    structs = [F.when(r.isNotNull(), F.struct(r.alias("_ref"))) for r in refs]
    return F.filter(F.array(*structs), lambda x: x.isNotNull())


def doc_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents about owners, one or two versions per supplier (published and draft)."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    places = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    ks = k.cast("string")
    website = (
        F.when(k % 6 == 1, F.concat(F.lit("https://www.site"), ks, F.lit(".example.com/about")))
        .when(k % 6 == 2, F.concat(F.lit("Site"), ks, F.lit(".example.org")))
        .when(k % 6 == 3, F.concat(F.lit("HTTP://WWW.Registry.Example/"), ks))
        .when(k % 6 == 4, F.lit("no site"))
        .when(k % 6 == 5, F.concat(F.lit("http://user@shop"), (k % 50).cast("string"), F.lit(".example.net:8080/x?y=1")))
    )
    street = (
        F.when(k % 9 == 0, F.concat(F.lit("The UPS Store #"), ks))
        .when(k % 9 == 1, F.concat(F.lit("12 Main St PMB #"), ks))
        .when(k % 9 == 2, F.concat(F.lit("P.O. Box "), ks))
        .when(k % 9 != 3, F.concat((k % 12 + 100).cast("string"), F.lit("  Main Street.")))
    )
    body = [
        k.alias("doc_no"),
        F.when(k % 7 == 0, F.col("r_name")).otherwise(F.col("s_name")).alias("title"),
        F.when(k % 4 == 0, F.concat(F.lit("Alias "), ks)).alias("alias"),
        F.concat(
            F.lpad(F.col("s_nationkey").cast("string"), 2, "0"),
            F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k % 26 + 1).cast("int"), F.lit(1)),
            F.lpad((k % 100).cast("string"), 2, "0"),
        ).alias("code"),
        F.struct(F.lower(F.regexp_replace("s_name", "#", "-")).alias("current")).alias("slug"),
        website.alias("website"),
        F.struct(
            street.alias("street1"),
            F.when(k % 20 != 19, F.col("r_name")).alias("city"),
            F.substring("r_name", 1, 2).alias("state"),
            F.lit("USA").alias("country"),
        ).alias("address"),
        _refs(
            F.concat(F.lit("cat-"), (k % 5).cast("string")),
            F.when(k % 8 == 0, F.lit("cat-unknown")),
            F.when(k % 25 == 0, F.lit("cat-hidden")),
            F.when(k % 13 == 0, F.lit("cat-dead")),
            F.when(k % 17 == 0, F.lit("cat-gone")),
        ).alias("categories"),
        _refs(F.when(k % 2 == 0, F.concat(F.lit("grp-"), F.col("r_regionkey").cast("string")))).alias("groups"),
        F.array(
            F.struct(
                F.lit("block").alias("_type"),
                F.array(F.struct(F.col("s_name").alias("text")), F.struct(F.concat(F.lit(" of "), F.col("n_name")).alias("text"))).alias("children"),
            ),
            F.struct(F.lit("image").alias("_type"), F.array(F.struct(F.lit("x").alias("text"))).alias("children")),
            F.struct(
                F.lit("block").alias("_type"),
                F.array(F.struct(F.concat(F.lit("No "), ks).alias("text"))).alias("children"),
            ),
        ).alias("summary"),
        F.when(
            k % 10 == 0,
            F.array(
                F.struct(
                    F.concat(F.lit("2024-0"), (k % 9 + 1).cast("string"), F.lit("-15")).alias("date"),
                    F.concat(F.lit(" News "), ks).alias("title"),
                    F.lit("text").alias("snippet"),
                    F.lit(" d.example").alias("sourceDomain"),
                    F.concat(F.lit("https://d.example/"), ks).alias("sourceUrl"),
                ),
                F.struct(
                    F.lit(None).cast("string").alias("date"), F.concat(F.lit("Old "), ks).alias("title"), F.lit("").alias("snippet"),
                    F.lit(None).cast("string").alias("sourceDomain"), F.lit(None).cast("string").alias("sourceUrl"),
                ),
            ),
        ).alias("recentNews"),
    ]
    version = F.array_compact(
        F.array(
            F.when(k % 3 != 0, F.lit("org-")),
            F.when((k % 3 == 0) | (k % 5 == 0), F.lit("drafts.org-")),
        )
    )
    return rows.select(F.explode(version).alias("v"), *body).withColumn("_id", F.concat("v", F.col("doc_no").cast("string"))).drop("v")


def owner_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current version of every document."""
    return latest_version(doc_versions(spark, sf_dir))


DOCS_SQL = """
cats AS (SELECT * FROM (VALUES ('cat-0','carrier','Carrier'),('cat-1','reseller','Reseller'),('cat-2','broker','Broker'),('cat-3','wireless','Wireless'),
  ('cat-4','cable','Cable'),('cat-unknown','unknown','Unknown'),('cat-hidden','hidden','Hidden'),('cat-dead','dead','Dormant')) AS t(id, slug, title)),
grps AS (SELECT 'grp-' || r_regionkey AS id, lower(r_name) AS slug, r_name AS title FROM region),
docs AS (
  SELECT k AS doc_no, CASE WHEN k % 3 <> 0 THEN 'org-' ELSE 'drafts.org-' END || k AS _id,
    CASE WHEN k % 7 = 0 THEN r_name ELSE s_name END AS title, CASE WHEN k % 4 = 0 THEN 'Alias ' || k END AS alias,
    lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', k % 26 + 1, 1) || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS code,
    lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS owner, lower(replace(s_name, '#', '-')) AS slug,
    CASE k % 6 WHEN 1 THEN 'https://www.site' || k || '.example.com/about' WHEN 2 THEN 'Site' || k || '.example.org'
      WHEN 3 THEN 'HTTP://WWW.Registry.Example/' || k WHEN 4 THEN 'no site' WHEN 5 THEN 'http://user@shop' || (k % 50) || '.example.net:8080/x?y=1' END AS website,
    CASE WHEN k % 9 = 0 THEN 'The UPS Store #' || k WHEN k % 9 = 1 THEN '12 Main St PMB #' || k WHEN k % 9 = 2 THEN 'P.O. Box ' || k
      WHEN k % 9 <> 3 THEN (k % 12 + 100) || '  Main Street.' END AS street1,
    CASE WHEN k % 20 <> 19 THEN r_name END AS city, substr(r_name, 1, 2) AS state, s_name, n_name, r_name,
    [x FOR x IN ['cat-' || (k % 5), CASE WHEN k % 8 = 0 THEN 'cat-unknown' END, CASE WHEN k % 25 = 0 THEN 'cat-hidden' END,
      CASE WHEN k % 13 = 0 THEN 'cat-dead' END, CASE WHEN k % 17 = 0 THEN 'cat-gone' END] IF x IS NOT NULL] AS categories,
    [x FOR x IN [CASE WHEN k % 2 = 0 THEN 'grp-' || r_regionkey END] IF x IS NOT NULL] AS groups
  FROM (SELECT *, s_suppkey AS k FROM supplier) JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
catref AS (SELECT doc_no, owner, unnest(categories) AS ref FROM docs),
grpref AS (SELECT doc_no, owner, unnest(groups) AS ref FROM docs),
hid AS (SELECT DISTINCT owner FROM docs WHERE owner LIKE '1%' UNION SELECT owner FROM catref WHERE ref = 'cat-hidden' UNION SELECT '24'),
fdoc AS (SELECT * FROM docs WHERE doc_no IN (SELECT min(doc_no) FROM docs GROUP BY owner))"""

HIDDEN_OVERRIDE = ["24"]


# --- raw text, rules and the adjusted month -------------------------------------------


def _status_text() -> Column:
    return F.when(F.col("status") == 1, "WORKING").when(F.col("status") == 2, "TRANSIT").otherwise("DISCONN")


def raw_lines(rows: DataFrame) -> DataFrame:
    """Text lines of keys, with the faults real files have: short lines, unknown statuses,
    bad dates, missing codes, bad numbers, numbers without dashes or of foreign segments."""
    fault = F.col("key") % 50
    suffix = wide_suffix(F.col("key"))
    seg = F.col("segment").cast("string")
    tail = F.concat_ws("-", F.substring(suffix, 1, 3), F.substring(suffix, F.lit(4), F.length(suffix)))
    number = (
        F.when(fault == 4, F.concat(seg, F.lit("-X"), tail))
        .when(fault == 6, F.concat(seg, suffix))
        .when(fault == 7, F.concat(F.lit("212-"), tail))
        .otherwise(F.concat(seg, F.lit("-"), tail))
    )
    status = F.when(fault == 1, "BOGUS").when(fault == 5, "SPARE").otherwise(_status_text())
    date = F.when(fault == 2, "26/13").otherwise(F.date_format("changed_at", "yy/MM/dd"))
    code = F.when(fault == 3, F.lit("")).otherwise(F.col("sub_owner"))
    value = F.concat(
        number,
        F.lit("  ,"),
        F.rpad(status, 8, " "),
        F.lit(","),
        date,
        F.lit(","),
        F.lpad((F.col("key") % 100).cast("string"), 2, "0"),
        F.when(fault == 0, "").otherwise(F.concat(F.lit(","), code)),
    )
    return rows.withColumn("value", value)


_RAW = """
{name} AS (
  SELECT key, {cols}, CASE key % 50 WHEN 4 THEN segment || '-X' || substr(suffix, 1, 3) || '-' || substr(suffix, 4) WHEN 6 THEN segment || suffix
      WHEN 7 THEN '212-' || substr(suffix, 1, 3) || '-' || substr(suffix, 4) ELSE segment || '-' || substr(suffix, 1, 3) || '-' || substr(suffix, 4) END
    || '  ,' || rpad(CASE WHEN key % 50 = 1 THEN 'BOGUS' WHEN key % 50 = 5 THEN 'SPARE' WHEN status = 1 THEN 'WORKING' WHEN status = 2 THEN 'TRANSIT' ELSE 'DISCONN' END, 8, ' ')
    || ',' || CASE WHEN key % 50 = 2 THEN '26/13' ELSE strftime(changed_at, '%y/%m/%d') END || ',' || lpad(CAST(key % 100 AS VARCHAR), 2, '0')
    || CASE key % 50 WHEN 0 THEN '' WHEN 3 THEN ',' ELSE ',' || sub_owner END AS value
  FROM (SELECT *, format('{{:07d}}', key) AS suffix FROM {source}))"""
RAW_SQL = _RAW.format(name="raw", cols="period, segment", source="snap")
RAW_CURRENT_SQL = _RAW.format(name="rawc", cols="segment", source="cur")

# Literal rules: (pattern, status, date, template, code); None keeps, '' clears.
PHONE_RULES = [
    ("800******0", "UNAVAIL", None, None, None),
    ("833*****1*", None, "", "XX", "ZZZ99"),
    ("800*******", "RESERVED", None, "", None),
    ("8**0000**7", "TRANSIT", "01/01/01", None, ""),
]
RENAME_RULES = [("07***", "77R01"), ("1*0*5", "88R02"), ("07**1", "99999"), ("ZZZ99", "ZZZ98")]
STATUS_RULES = [("77R01", "*", "SUSPEND"), ("2****", "WORKING", "ASSIGNED"), ("2*0**", "*", "RESERVED")]


def adjust_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed lines of the current keys."""
    return parse_adjust_line(raw_lines(current_keys(spark, sf_dir)).select("key", "value"), None)


ADJUST_INPUT_SQL = """
inp AS (SELECT key, replace(trim(f[1]), '-', '') AS phone, trim(f[2]) AS status, trim(f[3]) AS date, trim(f[4]) AS template, trim(f[5]) AS sub_owner
  FROM (SELECT key, string_split(value, ',') AS f FROM rawc) WHERE len(f) >= 5 AND regexp_full_match(replace(trim(f[1]), '-', ''), '[0-9]{10,}'))"""


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact overrides for the parts of size 13, and empty targets for those of size 14."""
    part = table(spark, sf_dir, "part").where(F.col("p_size").isin(13, 14))
    return part.select(
        F.concat(_segment(F.col("p_size")).cast("string"), wide_suffix(F.col("p_partkey"))).alias("phone"),
        F.when(F.col("p_size") == 13, F.concat(F.lit("OV"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")))
        .otherwise("")
        .alias("code"),
    ).dropDuplicates(["phone"])


def top_suffix(spark: SparkSession, sf_dir: str) -> int:
    """Upper end of the key space: one number from an aggregate."""
    return int(table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0)


def adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjusted month: gap-filled key space after all four passes."""
    full = gap_fill(adjust_input(spark, sf_dir), 0, top_suffix(spark, sf_dir), "key")
    return adjust_snapshot(full, PHONE_RULES, RENAME_RULES, STATUS_RULES, overrides(spark, sf_dir))


OVERRIDES_SQL = """
ovr AS (SELECT CAST([800,833,844,855,866,877,888][p_size % 7 + 1] AS VARCHAR) || format('{:07d}', p_partkey) AS phone,
  CASE p_size WHEN 13 THEN 'OV' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') ELSE '' END AS code FROM part WHERE p_size IN (13, 14))"""

GAP_SQL = """
filled AS (SELECT s.phone, coalesce(i.status, 'AVAIL') AS status, coalesce(i.date, '') AS date, coalesce(i.template, '') AS template,
    coalesce(i.sub_owner, '') AS sub_owner
  FROM (SELECT CAST(g.seg AS VARCHAR) || format('{:07d}', r.n) AS phone
        FROM (SELECT unnest([800,833,844,855,866,877,888]) AS seg) g CROSS JOIN (SELECT range AS n FROM range(0, (SELECT max(p_partkey) + 1 FROM part))) r) s
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY key) AS rn FROM inp) WHERE rn = 1) i USING (phone))"""


def cascade_sql(source: str) -> str:
    """The four passes over a table with phone, status, date, template and sub_owner."""
    return f"""
p1 AS (SELECT *, CASE WHEN phone LIKE '800______0' THEN 1 WHEN phone LIKE '833_____1_' THEN 2 WHEN phone LIKE '800_______' THEN 3
    WHEN phone LIKE '8__0000__7' THEN 4 END AS h FROM {source}),
p1b AS (SELECT * EXCLUDE (status, date, template, sub_owner), CASE h WHEN 1 THEN 'UNAVAIL' WHEN 3 THEN 'RESERVED' WHEN 4 THEN 'TRANSIT' ELSE status END AS status,
  CASE h WHEN 2 THEN '' WHEN 4 THEN '01/01/01' ELSE date END AS date, CASE h WHEN 2 THEN 'XX' WHEN 3 THEN '' ELSE template END AS template,
  CASE h WHEN 2 THEN 'ZZZ99' WHEN 4 THEN '' ELSE sub_owner END AS sub_owner FROM p1),
p2 AS (SELECT * EXCLUDE (sub_owner), CASE WHEN sub_owner LIKE '07___' THEN '77R01' WHEN sub_owner LIKE '1_0_5' THEN '88R02'
  WHEN sub_owner = 'ZZZ99' THEN 'ZZZ98' ELSE sub_owner END AS sub_owner FROM p1b),
p3 AS (SELECT * EXCLUDE (status), CASE WHEN sub_owner = '77R01' THEN 'SUSPEND' WHEN sub_owner LIKE '2____' AND trim(status) = 'WORKING' THEN 'ASSIGNED'
  WHEN sub_owner LIKE '2_0__' THEN 'RESERVED' ELSE status END AS status FROM p2),
p4 AS (SELECT p.* EXCLUDE (sub_owner), coalesce(o.code, p.sub_owner) AS sub_owner FROM p3 p LEFT JOIN (SELECT * FROM ovr WHERE code <> '') o USING (phone)),
adj AS (SELECT phone, status, date, template, sub_owner, CASE WHEN length(sub_owner) >= 2 THEN substr(sub_owner, 1, 2) ELSE '' END AS owner FROM p4)"""


ADJ_INPUT_CTES = f"{CURRENT_SQL},{RAW_CURRENT_SQL},{ADJUST_INPUT_SQL},{OVERRIDES_SQL}"
ADJUSTED_CTES = f"{ADJ_INPUT_CTES},{GAP_SQL},{cascade_sql('filled')}"
