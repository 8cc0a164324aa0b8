"""Weekly pool tables. The days of the event stream stand for weeks, its types for segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.operators import pool
from rollbook.plans.base import query, table

POOL_SQL = """
pool AS (SELECT *, total_in_use + spare AS total_pool, total_in_use / (total_in_use + spare) * 100 AS pct_in_use FROM (
  SELECT CAST(ts AS DATE) AS week_ending, CAST(CASE event_type WHEN 'click' THEN 800 WHEN 'view' THEN 833 WHEN 'signup' THEN 844 WHEN 'error' THEN 855 ELSE 866 END AS BIGINT) AS segment,
    count(*) FILTER (WHERE user_id % 7 = 0) AS working, count(*) FILTER (WHERE user_id % 7 = 1) AS assigned, count(*) FILTER (WHERE user_id % 7 = 2) AS reserved,
    count(*) FILTER (WHERE user_id % 7 = 3) AS disconnect, count(*) FILTER (WHERE user_id % 7 = 4) AS transit, count(*) FILTER (WHERE user_id % 7 = 5) AS unavail,
    count(*) FILTER (WHERE user_id % 7 = 6 AND event_type <> 'click') AS suspend, count(*) AS total_in_use, count(*) FILTER (WHERE value < 10) * 3 AS spare
  FROM events GROUP BY 1, 2)),
flow AS (SELECT week_ending, total_in_use, spare, CASE WHEN day(week_ending) % 6 <> 0 THEN total_in_use - lag(total_in_use) OVER (ORDER BY week_ending) END AS growth_week,
  reserved_during_week, total_spared_week FROM (SELECT CAST(ts AS DATE) AS week_ending, count(*) AS total_in_use, count(*) FILTER (WHERE value < 10) * 3 AS spare,
    count(*) FILTER (WHERE user_id % 7 = 2) AS reserved_during_week, count(*) FILTER (WHERE user_id % 7 = 3) AS total_spared_week FROM events GROUP BY 1)),
fore AS (SELECT CAST(ts AS DATE) AS week_ending, CAST(CASE event_type WHEN 'click' THEN 12 WHEN 'view' THEN 24 WHEN 'signup' THEN 36 WHEN 'error' THEN 60 ELSE 84 END AS BIGINT) AS horizon_months,
  CASE WHEN count(*) % 4 <> 0 THEN CAST(ts AS DATE) + CAST(count(*) % 90 - 45 AS INTEGER) END AS predicted_exhaust_date FROM events GROUP BY CAST(ts AS DATE), event_type)"""


def _events(spark, d):
    return table(spark, d, "events").withColumn("week_ending", F.col("ts").cast("date"))


def _code(values):
    kinds = ("click", "view", "signup", "error")
    out = F.lit(values[4])
    for kind, v in zip(kinds, values, strict=False):
        out = F.when(F.col("event_type") == kind, v).otherwise(out)
    return out


def _pool(spark, d):
    user = F.col("user_id") % 7
    counts = [F.count_if(user == i).alias(s) for i, s in enumerate(pool.STATUSES[:6])]
    counts.append(F.count_if((user == 6) & (F.col("event_type") != "click")).alias("suspend"))
    rows = _events(spark, d).groupBy("week_ending", _code((800, 833, 844, 855, 866)).alias("segment")).agg(
        *counts, F.count("*").alias("total_in_use"), (F.count_if(F.col("value") < 10) * 3).alias("spare")
    )
    total = F.col("total_in_use") + F.col("spare")
    return rows.withColumn("total_pool", total).withColumn("pct_in_use", F.col("total_in_use") / total * 100)


def _flow(spark, d):
    rows = _events(spark, d).groupBy("week_ending").agg(
        F.count("*").alias("total_in_use"),
        (F.count_if(F.col("value") < 10) * 3).alias("spare"),
        F.count_if(F.col("user_id") % 7 == 2).alias("reserved_during_week"),
        F.count_if(F.col("user_id") % 7 == 3).alias("total_spared_week"),
    )
    growth = F.col("total_in_use") - F.lag("total_in_use").over(Window.orderBy("week_ending"))
    return rows.withColumn("growth_week", F.when(F.day("week_ending") % 6 != 0, growth))


def _forecasts(spark, d):
    counts = _events(spark, d).groupBy("week_ending", _code((12, 24, 36, 60, 84)).alias("horizon_months")).agg(F.count("*").alias("n"))
    day = F.date_add("week_ending", (F.col("n") % 90 - 45).cast("int"))
    return counts.withColumn("predicted_exhaust_date", F.when(F.col("n") % 4 != 0, day))


@query("latest_week", f"WITH{POOL_SQL}\nSELECT * REPLACE (CAST(week_ending AS VARCHAR) AS week_ending) FROM pool WHERE week_ending = (SELECT max(week_ending) FROM pool)")
def _(spark, d):
    return pool.latest_week(_pool(spark, d))


@query(
    "last_n_weeks",
    f"WITH{POOL_SQL}\nSELECT CAST(week_ending AS VARCHAR) AS week_ending, growth_week FROM (SELECT * FROM flow WHERE growth_week IS NOT NULL ORDER BY week_ending DESC LIMIT 12)",
)
def _(spark, d):
    return pool.last_n_weeks(_flow(spark, d), 12).select("week_ending", "growth_week")


@query(
    "weeks_since_growth",
    f"""WITH{POOL_SQL}
SELECT count(*) AS weeks_since_growth FROM flow WHERE growth_week IS NOT NULL AND week_ending > coalesce((SELECT max(week_ending) FROM flow WHERE growth_week < 0), DATE '1900-01-01')""",
)
def _(spark, d):
    return pool.weeks_since_growth(_flow(spark, d))


@query(
    "pool_summary",
    f"""WITH{POOL_SQL}
SELECT CAST(week_ending AS VARCHAR) AS week_ending, total_in_use, spare, growth_week, reserved_during_week, total_spared_week, total_in_use + spare AS pool_total,
total_in_use / (total_in_use + spare) * 100 AS pct_in_use FROM flow WHERE week_ending = (SELECT max(week_ending) FROM flow)""",
)
def _(spark, d):
    return pool.pool_summary(_flow(spark, d))


@query(
    "missed_forecasts",
    f"WITH{POOL_SQL}\nSELECT CAST(week_ending AS VARCHAR) AS week_ending, horizon_months, CAST(predicted_exhaust_date AS VARCHAR) AS predicted_exhaust_date FROM fore WHERE predicted_exhaust_date < DATE '2024-01-20'",
)
def _(spark, d):
    return pool.missed_forecasts(_forecasts(spark, d), F.lit("2024-01-20").cast("date"))


@query(
    "latest_forecasts",
    f"""WITH{POOL_SQL}
SELECT CAST(week_ending AS VARCHAR) AS week_ending, horizon_months, CAST(predicted_exhaust_date AS VARCHAR) AS predicted_exhaust_date FROM fore
WHERE week_ending = (SELECT max(week_ending) FROM fore)""",
)
def _(spark, d):
    return pool.latest_forecasts(_forecasts(spark, d))


@query(
    "forecast_fan",
    f"WITH{POOL_SQL}\nSELECT CAST(week_ending AS VARCHAR) AS week_ending, horizon_months, CAST(predicted_exhaust_date AS VARCHAR) AS predicted_exhaust_date FROM fore WHERE predicted_exhaust_date IS NOT NULL",
)
def _(spark, d):
    return pool.forecast_fan(_forecasts(spark, d))


LONG_SQL = "long AS (SELECT * FROM (SELECT segment, week_ending, pct_in_use, working, assigned, reserved, disconnect, transit, unavail, suspend FROM pool) UNPIVOT (value FOR status IN (working, assigned, reserved, disconnect, transit, unavail, suspend)))"


@query("segment_history", f"WITH{POOL_SQL},\n{LONG_SQL}\nSELECT segment, CAST(week_ending AS VARCHAR) AS week_ending, pct_in_use, status, value FROM long")
def _(spark, d):
    return pool.segment_history(_pool(spark, d))


@query(
    "melt_statuses",
    f"""WITH{POOL_SQL},\n{LONG_SQL}
SELECT segment, CAST(week_ending AS VARCHAR) AS week_ending, pct_in_use, status, value FROM long WHERE (segment, status) IN (SELECT (segment, status) FROM long WHERE value <> 0)""",
)
def _(spark, d):
    return pool.melt_statuses(_pool(spark, d))


@query(
    "stacked_pool",
    f"""WITH{POOL_SQL}
SELECT CAST(w.week_ending AS VARCHAR) AS period, CAST(l.segment AS VARCHAR) AS label, coalesce(p.spare, 0) AS value,
  CAST(sum(coalesce(p.spare, 0)) OVER (PARTITION BY w.week_ending ORDER BY l.pos) AS BIGINT) AS top
FROM (SELECT DISTINCT week_ending FROM pool) w CROSS JOIN (SELECT * FROM (VALUES (800, 1), (888, 2), (866, 3), (855, 4), (844, 5), (833, 6)) AS t(segment, pos)) l
LEFT JOIN pool p ON p.week_ending = w.week_ending AND p.segment = l.segment""",
)
def _(spark, d):
    from rollbook.operators.ranks import stacked_series

    series = _pool(spark, d).select(
        F.col("segment").cast("string").alias("label"), F.col("week_ending").alias("period"), F.col("spare").alias("value")
    )
    return stacked_series(series, ["800", "888", "866", "855", "844", "833"])


# --- report rows ----------------------------------------------------------------------


def _thousands(c):
    return F.when(c == 0, "N/A").otherwise(F.concat(F.lit(" "), F.format_number(c * 1000, 0)))


@query(
    "report_lines_segments",
    f"""WITH{POOL_SQL}
SELECT CAST(week_ending AS VARCHAR) AS week_ending, segment, nullif(working, 0) * 1000 AS working, nullif(assigned, 0) * 1000 AS assigned, nullif(reserved, 0) * 1000 AS reserved,
  nullif(disconnect, 0) * 1000 AS disconnect, nullif(transit, 0) * 1000 AS transit, nullif(unavail, 0) * 1000 AS unavail, nullif(suspend, 0) * 1000 AS suspend,
  nullif(total_in_use, 0) * 1000 AS total_in_use, CASE WHEN spare > 0 THEN CAST(total_in_use AS DOUBLE) END AS pct_in_use, nullif(spare, 0) * 1000 AS spare, nullif(total_pool, 0) * 1000 AS total_pool FROM pool""",
)
def _(spark, d):
    """Cells as they stand in a report: thousands separators, N/A and percent signs."""
    rows = _pool(spark, d)
    pct = F.when(F.col("spare") > 0, F.concat(F.col("total_in_use").cast("string"), F.lit(".0%"))).otherwise("n/a")
    cells = F.array(
        F.concat(F.lit("npa: "), F.col("segment").cast("string")),
        *[_thousands(F.col(s)) for s in pool.STATUSES],
        _thousands(F.col("total_in_use")),
        pct,
        _thousands(F.col("spare")),
        _thousands(F.col("total_pool")),
    )
    return pool.segment_rows(rows.select("week_ending", cells.alias("cells")))


@query(
    "report_lines_flow",
    f"""WITH{POOL_SQL}
SELECT CAST(week_ending AS VARCHAR) AS week_ending, total_in_use, spare, growth_week, reserved_during_week, CAST(1 AS BIGINT) AS spared_from_disconnect,
  CAST(NULL AS BIGINT) AS spared_from_reserved, CAST(3 AS BIGINT) AS spared_from_unavail, total_spared_week FROM flow""",
)
def _(spark, d):
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    blank = F.when(F.day("week_ending") % 2 == 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    cells = F.concat(
        F.array(F.date_format("week_ending", "M/d/yyyy"), text("total_in_use"), text("spare"), text("growth_week")),
        blank,
        F.array(text("reserved_during_week"), F.lit("1"), F.lit("N/A"), F.lit("3"), text("total_spared_week")),
    )
    return pool.flow_rows(_flow(spark, d).select(cells.alias("cells")))


@query(
    "report_lines_forecast",
    f"""WITH{POOL_SQL}
SELECT CAST(week_ending AS VARCHAR) AS week_ending, horizon_months, 'Jan 2020' AS start_label, CAST(-1200 AS BIGINT) AS monthly_rate_of_change, CAST(NULL AS BIGINT) AS months_to_exhaust,
  CAST(date_trunc('month', predicted_exhaust_date)::DATE AS VARCHAR) AS predicted_exhaust_date FROM fore""",
)
def _(spark, d):
    rows = _forecasts(spark, d)
    cells = F.array(
        F.concat(F.lit("Jan 2020 ("), F.col("horizon_months").cast("string"), F.lit(")")),
        F.lit("-1,200"),
        F.lit("unknown"),
        F.coalesce(F.date_format("predicted_exhaust_date", "MMM yyyy"), F.lit("N/A")),
    )
    return pool.forecast_rows(rows.select("week_ending", cells.alias("cells")))


@query(
    "report_lines",
    """SELECT report, CASE WHEN day(d) % 4 <> 3 THEN 'NUM-24-' || day(d) ELSE report END AS report_no, CASE WHEN day(d) % 7 <> 0 THEN CAST(d AS VARCHAR) END AS report_date,
    CASE WHEN day(d) % 4 < 2 THEN CAST(CAST(d - INTERVAL 2 DAY AS DATE) AS VARCHAR) WHEN day(d) % 7 <> 0 THEN CAST(d - CAST((dayofweek(d) + 1) % 7 AS INTEGER) AS VARCHAR) END AS week_ending
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS d, 'r' || strftime(ts, '%m%d') AS report FROM events)""",
)
def _(spark, d):
    """Report texts by day: subject plain, doubled or missing; number or date missing."""
    days = _events(spark, d).select("week_ending").distinct()
    kind = F.day("week_ending") % 4
    number = F.when(kind != 3, F.concat(F.lit("Notification No: NUM-24-"), F.day("week_ending").cast("string"), F.lit("\n"))).otherwise("")
    date = F.when(F.day("week_ending") % 7 != 0, F.concat(F.lit("Date: "), F.date_format("week_ending", "M/d/yyyy"), F.lit("\n"))).otherwise("")
    subject = F.concat(F.lit("Subject: Report for Saturday, "), F.date_format(F.date_sub("week_ending", 2), "MM/dd/yyyy"))
    doubled = F.regexp_replace(subject, "(.)", "$1$1")
    line = F.when(kind == 0, subject).when(kind == 1, doubled).otherwise("Subject: Report")
    texts = days.select(F.concat(F.lit("r"), F.date_format("week_ending", "MMdd")).alias("report"), F.concat(number, date, line).alias("text"))
    return pool.report_header(texts)


@query(
    "dedupe_first_seen_week",
    """SELECT CAST(week_ending AS VARCHAR) AS week_ending, report, total_in_use FROM (SELECT *, row_number() OVER (PARTITION BY week_ending ORDER BY report) AS rn FROM (
      SELECT CAST(d - CAST(k AS INTEGER) AS DATE) AS week_ending, 'r' || strftime(d, '%m%d') AS report, n * 10 + k AS total_in_use
      FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k))) WHERE rn = 1""",
)
def _(spark, d):
    """Every report repeats the five weeks before its own."""
    reports = _events(spark, d).groupBy(F.col("week_ending").alias("day")).agg(F.count("*").alias("n"))
    back = reports.select("day", "n", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    flows = back.select(
        F.date_sub("day", F.col("k")).alias("week_ending"),
        F.concat(F.lit("r"), F.date_format("day", "MMdd")).alias("report"),
        (F.col("n") * 10 + F.col("k")).alias("total_in_use"),
    )
    return pool.first_seen_week(flows, "report")
