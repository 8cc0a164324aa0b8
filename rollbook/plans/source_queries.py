"""Raw text, file names, sources of a month, and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.constants import SEGMENTS
from rollbook.functions import keys
from rollbook.functions.calendar import month_of
from rollbook.plans.base import (
    CURRENT_SQL,
    RAW_SQL,
    current_keys,
    query,
    raw_lines,
    snapshot,
    table,
    wide_suffix,
    with_snap,
)
from rollbook.session import scratch_path
from rollbook.sources import files, lines, sinks


def _raw(spark, d):
    return raw_lines(snapshot(spark, d, segment=True)).select("period", "segment", "value")


PARSED_SQL = RAW_SQL + """,
fld AS (SELECT period, segment, string_split(value, ',') AS f FROM raw),
prs AS (SELECT period, segment, trim(f[1]) AS number, trim(f[2]) AS status, trim(f[3]) AS date, trim(f[5]) AS code FROM fld
  WHERE len(f) >= 5 AND trim(f[1]) <> '' AND trim(f[5]) <> ''),
enc AS (SELECT period, TRY_CAST(replace(number, '-', '') AS BIGINT) AS key, segment,
  CAST(CASE status WHEN 'WORKING' THEN 1 WHEN 'TRANSIT' THEN 2 WHEN 'DISCONN' THEN 3 ELSE 0 END AS BIGINT) AS status, code AS sub_owner, substr(code, 1, 2) AS owner,
  CAST(CASE WHEN len(string_split(date, '/')) = 3 THEN string_split(date, '/')[1] ELSE '0' END AS BIGINT) AS yy,
  CAST(CASE WHEN len(string_split(date, '/')) = 3 THEN string_split(date, '/')[2] ELSE '0' END AS BIGINT) AS mm,
  CAST(CASE WHEN len(string_split(date, '/')) = 3 THEN string_split(date, '/')[3] ELSE '0' END AS BIGINT) AS dd FROM prs)"""


@query("parse_snapshot_lines", with_snap(PARSED_SQL, "SELECT * FROM prs", segment=True))
def _(spark, d):
    return lines.parse_snapshot_lines(_raw(spark, d))


@query(
    "parse_combined_lines",
    with_snap(
        PARSED_SQL,
        """SELECT period, number, status, date, code, CAST(substr(replace(number, '-', ''), 1, 3) AS BIGINT) AS segment FROM prs
        WHERE substr(replace(number, '-', ''), 1, 3) IN ('800','833','844','855','866','877','888') AND status IN ('WORKING', 'TRANSIT', 'DISCONN')""",
        segment=True,
    ),
)
def _(spark, d):
    return lines.parse_combined_lines(_raw(spark, d).drop("segment"), drop_spares=True)


@query("encode_snapshot", with_snap(PARSED_SQL, "SELECT * FROM enc WHERE key IS NOT NULL", segment=True))
def _(spark, d):
    return lines.encode_snapshot(lines.parse_snapshot_lines(_raw(spark, d)))


@query(
    "segments_union",
    with_snap(PARSED_SQL, "SELECT segment, count(*) AS n, count(DISTINCT number) AS n_numbers FROM prs GROUP BY 1", segment=True),
)
def _(spark, d):
    """One text file set per segment, read back as one snapshot."""
    path = scratch_path(spark, "segments")
    raw = _raw(spark, d)
    raw.select("segment", "value").write.partitionBy("segment").text(path)
    read = lines.read_lines(spark, path)
    tagged = read.withColumn("segment", F.regexp_extract("path", r"segment=(\d+)", 1).cast("int")).drop("path")
    parsed = lines.parse_snapshot_lines(tagged)
    return parsed.groupBy("segment").agg(F.count("*").alias("n"), F.countDistinct("number").alias("n_numbers"))


# Completeness of every code's holdings in every period.
@query(
    "missing_segments",
    with_snap(
        "r AS (SELECT DISTINCT period || '/' || sub_owner AS period, segment FROM snap)",
        """SELECT p.period, coalesce(string_agg(CAST(g.segment AS VARCHAR), '|' ORDER BY g.segment) FILTER (WHERE r.segment IS NULL), '') AS missing,
        count(*) FILTER (WHERE r.segment IS NULL) = 0 AS complete FROM (SELECT DISTINCT period FROM r) p CROSS JOIN (SELECT unnest([800,833,844,855,866,877,888]) AS segment) g
        LEFT JOIN r ON r.period = p.period AND r.segment = g.segment GROUP BY 1""",
        segment=True,
    ),
)
def _(spark, d):
    rows = snapshot(spark, d, segment=True)
    return lines.missing_segments(rows.withColumn("period", F.concat_ws("/", "period", "sub_owner")))


# --- file names -----------------------------------------------------------------------

NAMED_SQL = """
ln AS (SELECT l_linenumber + l_orderkey * 10 AS n, year(l_shipdate) AS y, month(l_shipdate) AS m, strftime(l_shipdate, '%B') AS mon FROM lineitem),
nm AS (SELECT CASE n % 12 WHEN 0 THEN mon || y || '.zip' WHEN 1 THEN y || ' ' || substr(mon, 1, 3) || ' all.txt' WHEN 2 THEN y || '-' || m || '-ALL.txt'
    WHEN 3 THEN strftime(make_date(y, m, 1), '%y %m') || ' Data.zip' WHEN 4 THEN strftime(make_date(y, m, 1), '%y-%m') || '.zip' WHEN 5 THEN 'bq' || strftime(make_date(y, m, 1), '%y%m') || '07'
    WHEN 6 THEN 'Registry' || substr(mon, 1, 3) || y WHEN 7 THEN strftime(make_date(y, m, 1), '%y') || mon WHEN 8 THEN substr(mon, 1, 3) || '  ' || y
    WHEN 9 THEN mon || '-1 ' || y WHEN 10 THEN 'readme' || y ELSE y || '-13' END AS name,
  CASE WHEN n % 12 < 3 OR n % 12 IN (6, 8, 9) THEN strftime(make_date(y, m, 1), '%Y-%m') WHEN n % 12 IN (3, 4, 5, 7) THEN '20' || strftime(make_date(y, m, 1), '%y-%m') END AS month FROM ln)"""


def _file_names(spark, d):
    day = F.col("l_shipdate")
    y, m = F.year(day).cast("string"), F.month(day).cast("string")
    mon, short = F.date_format(day, "MMMM"), F.date_format(day, "MMM")
    style = (F.col("l_linenumber") + F.col("l_orderkey") * 10) % 12
    name = (
        F.when(style == 0, F.concat(mon, y, F.lit(".zip")))
        .when(style == 1, F.concat(y, F.lit(" "), short, F.lit(" all.txt")))
        .when(style == 2, F.concat(y, F.lit("-"), m, F.lit("-ALL.txt")))
        .when(style == 3, F.concat(F.date_format(day, "yy MM"), F.lit(" Data.zip")))
        .when(style == 4, F.concat(F.date_format(day, "yy-MM"), F.lit(".zip")))
        .when(style == 5, F.concat(F.lit("bq"), F.date_format(day, "yyMM"), F.lit("07")))
        .when(style == 6, F.concat(F.lit("Registry"), short, y))
        .when(style == 7, F.concat(F.date_format(day, "yy"), mon))
        .when(style == 8, F.concat(short, F.lit("  "), y))
        .when(style == 9, F.concat(mon, F.lit("-1 "), y))
        .when(style == 10, F.concat(F.lit("readme"), y))
        .otherwise(F.concat(y, F.lit("-13")))
    )
    return table(spark, d, "lineitem").select(name.alias("name"))


@query("filename_to_month", f"WITH{NAMED_SQL}\nSELECT name, month, count(*) AS n FROM nm GROUP BY 1, 2")
def _(spark, d):
    """The rules run once per name, not once per row."""
    names = _file_names(spark, d).groupBy("name").agg(F.count("*").alias("n"))
    return names.withColumn("month", files.month_from_name(F.col("name")))


@query(
    "filename_to_segment",
    """SELECT name, segment, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'SMS' || s || '.D20180301.txt' WHEN 1 THEN 'CD-ROM_TFN_Report_' || s || '_' || (20250000 + p_size) || '.txt'
      WHEN 2 THEN 'number-status-npa-' || s || '.TXT' WHEN 3 THEN 'Report_' || s || '.txt' ELSE 'SMS' || (s + 1) || '.txt' END AS name,
      CASE WHEN p_partkey % 5 < 3 THEN CAST(s AS BIGINT) END AS segment
      FROM (SELECT *, [800,833,844,855,866,877,888][p_size % 7 + 1] AS s FROM part)) GROUP BY 1, 2""",
)
def _(spark, d):
    from rollbook.plans.base import _segment

    style, code = F.col("p_partkey") % 5, _segment(F.col("p_size"))
    s = code.cast("string")
    name = (
        F.when(style == 0, F.concat(F.lit("SMS"), s, F.lit(".D20180301.txt")))
        .when(style == 1, F.concat(F.lit("CD-ROM_TFN_Report_"), s, F.lit("_"), (F.col("p_size") + 20250000).cast("string"), F.lit(".txt")))
        .when(style == 2, F.concat(F.lit("number-status-npa-"), s, F.lit(".TXT")))
        .when(style == 3, F.concat(F.lit("Report_"), s, F.lit(".txt")))
        .otherwise(F.concat(F.lit("SMS"), (code + 1).cast("string"), F.lit(".txt")))
    )
    names = table(spark, d, "part").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    return names.withColumn("segment", files.segment_from_name(F.col("name")))


SOURCES_SQL = """
src AS (SELECT period, segment, source, source_no FROM (SELECT *, CAST(substr(period, 7, 1) AS BIGINT) AS q FROM snap), LATERAL (
  SELECT period || '.zip' AS source, 1 AS source_no WHERE NOT (segment = 888 AND q = 1)
  UNION ALL SELECT period || ' folder', 2 WHERE NOT (segment = 833 AND q = 2)
  UNION ALL SELECT period || ' all.txt', 3 WHERE q >= 3)),
sc AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY CASE WHEN n_segments = 7 THEN 1 ELSE 0 END DESC, n_segments DESC,
    CASE kind WHEN 'folder' THEN 2 WHEN 'zip' THEN 1 ELSE 0 END DESC, source_no) AS place FROM (
  SELECT period, source, count(DISTINCT segment) AS n_segments, min(source_no) AS source_no,
    CASE WHEN source LIKE '%.zip' THEN 'zip' WHEN source LIKE '%.txt' THEN 'text' ELSE 'folder' END AS kind FROM src GROUP BY 1, 2))"""


def _sources(spark, d):
    """Up to three overlapping copies of every period; some lack a segment."""
    q = F.substring("period", 7, 1)
    s = F.col("segment")

    def copy(name, no, condition):
        return F.when(condition, F.struct(F.concat("period", F.lit(name)).alias("source"), F.lit(no).alias("source_no")))

    copies = F.array_compact(
        F.array(
            copy(".zip", 1, ~((s == 888) & (q == "1"))),
            copy(" folder", 2, ~((s == 833) & (q == "2"))),
            copy(" all.txt", 3, q >= "3"),
        )
    )
    return snapshot(spark, d, segment=True).select("period", "segment", "key", F.inline(copies))


@query("best_source_per_month", with_snap(SOURCES_SQL, "SELECT * FROM sc", segment=True))
def _(spark, d):
    return files.source_scores(_sources(spark, d))


@query(
    "best_source_rows",
    with_snap(SOURCES_SQL, "SELECT s.period, s.source, s.segment, count(*) AS n FROM src s JOIN sc USING (period, source) WHERE place = 1 GROUP BY 1, 2, 3", segment=True),
)
def _(spark, d):
    rows = files.best_source_rows(_sources(spark, d))
    return rows.groupBy("period", "source", "segment").agg(F.count("*").alias("n"))


# --- keys -----------------------------------------------------------------------------


@query("key_split", f"WITH{CURRENT_SQL}\nSELECT CAST(phone AS BIGINT) AS number, digits AS suffix, segment, substr(phone, 1, 3) || '-' || substr(phone, 4, 3) || '-' || substr(phone, 7) AS dashed FROM cur")
def _(spark, d):
    number = F.col("phone").cast("long")
    return current_keys(spark, d).select(
        number.alias("number"),
        keys.suffix_of(number).alias("suffix"),
        keys.segment_of(number).alias("segment"),
        keys.dashed(number).alias("dashed"),
    )


TEXT_SQL = """
txt AS (SELECT p_partkey AS request_id, s, suffix, CASE p_size % 5 WHEN 0 THEN '1-' || s || '-' || substr(replace(p_name, ' ', ''), 1, 7)
    WHEN 1 THEN '+1 (' || s || ') ' || substr(suffix, 1, 3) || '-' || substr(suffix, 4) WHEN 2 THEN '212-555-1212' WHEN 3 THEN s || suffix ELSE s || '-12' END AS text, p_name, p_size
  FROM (SELECT *, CAST([800,833,844,855,866,877,888][p_size % 7 + 1] AS VARCHAR) AS s, format('{:07d}', p_partkey) AS suffix FROM part)),
nrm AS (SELECT request_id, text, p_size, CASE WHEN p_size % 5 = 0 AND length(replace(p_name, ' ', '')) >= 7 THEN s || translate(upper(substr(replace(p_name, ' ', ''), 1, 7)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '22233344455566677778889999')
    WHEN p_size % 5 IN (1, 3) THEN s || suffix END AS phone FROM txt)"""


def key_texts(spark, d):
    from rollbook.plans.base import _segment

    s = _segment(F.col("p_size")).cast("string")
    suffix = wide_suffix(F.col("p_partkey"))
    style = F.col("p_size") % 5
    text = (
        F.when(style == 0, F.concat(F.lit("1-"), s, F.lit("-"), F.substring(F.replace("p_name", F.lit(" "), F.lit("")), 1, 7)))
        .when(style == 1, F.concat(F.lit("+1 ("), s, F.lit(") "), F.substring(suffix, 1, 3), F.lit("-"), F.substring(suffix, F.lit(4), F.length(suffix))))
        .when(style == 2, "212-555-1212")
        .when(style == 3, F.concat(s, suffix))
        .otherwise(F.concat(s, F.lit("-12")))
    )
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("request_id"), text.alias("text"), F.lpad((F.col("p_size") % 25).cast("string"), 2, "0").alias("owner")
    )


@query("normalize_key", f"WITH{TEXT_SQL}\nSELECT request_id, text, phone FROM nrm")
def _(spark, d):
    return key_texts(spark, d).select("request_id", "text", keys.normalize_key(F.col("text"), None).alias("phone"))


# --- sinks ----------------------------------------------------------------------------


@query(
    "sink_parquet",
    with_snap("", "SELECT period, owner, count(*) AS n, count(DISTINCT key) AS n_keys, CAST(max(changed_at) AS VARCHAR) AS newest FROM snap GROUP BY 1, 2"),
)
def _(spark, d):
    """Written as one folder per period and read back."""
    path = scratch_path(spark, "snapshots")
    sinks.write_snapshots(snapshot(spark, d), path)
    read = spark.read.parquet(path)
    return read.groupBy("period", "owner").agg(
        F.count("*").alias("n"), F.countDistinct("key").alias("n_keys"), F.max("changed_at").alias("newest")
    )


@query("month_from_filename", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    """Month read from the path of each file of a written table."""
    path = scratch_path(spark, "months")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), month_of(F.col("l_shipdate")).alias("period"))
    sinks.write_snapshots(rows, path)
    read = spark.read.parquet(path).select(files.month_tag(F.col("_metadata.file_path")).alias("month"))
    return read.groupBy("month").agg(F.count("*").alias("n"))


@query("skip_existing", with_snap("", "SELECT period, count(*) AS n FROM snap GROUP BY 1 HAVING count(DISTINCT segment) = 7", segment=True))
def _(spark, d):
    """A first load of the early periods with one of them incomplete, then a load of all:
    nothing is written twice, and an incomplete period is refused until it is whole."""
    path = scratch_path(spark, "skip")
    rows = snapshot(spark, d, segment=True)
    early = rows.where("period <= '1995-Q4' and not (period = '1995-Q4' and segment = 888)")
    sinks.append_missing(early, path, SEGMENTS)
    sinks.append_missing(rows, path, SEGMENTS)
    return spark.read.parquet(path).groupBy("period").agg(F.count("*").alias("n"))
