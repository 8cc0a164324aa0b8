"""Weekly number pool: report rows to tables, and the series read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.calendar import last_saturday, month_year_date, us_date

STATUSES = ("working", "assigned", "reserved", "disconnect", "transit", "unavail", "suspend")


# --- report rows ----------------------------------------------------------------------


def clean_int(cell: Column) -> Column:
    """'1,234' to 1234; empty, N/A and other text to NULL."""
    body = F.trim(F.regexp_replace(cell, ",", ""))
    return F.when(body.rlike(r"^[+-]?\d+$"), body.cast("long"))


def clean_pct(cell: Column) -> Column:
    body = F.trim(F.regexp_replace(cell, "%", ""))
    return F.when(body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), body.cast("double"))


def _week_of(text: Column) -> Column:
    return us_date(F.regexp_extract(text, r"for\s+\w+,\s*(\d{1,2}/\d{1,2}/\d{4})", 1))


def report_header(reports: DataFrame) -> DataFrame:
    """Number, date and week of each report text.

    The week is named in the subject line, in some files with every character doubled; else
    it is the Saturday on or before the report date.
    """
    t = F.col("text")
    number = F.regexp_extract(t, r"Notification No:\s*(NUM-\d{2}-\d+)", 1)
    day = us_date(F.regexp_extract(t, r"Date:\s*(\d{1,2}/\d{1,2}/\d{4})", 1))
    undoubled = F.regexp_replace(t, r"(.)\1", "$1")
    return (
        reports.withColumn("report_no", F.when(number != "", number).otherwise(F.col("report")))
        .withColumn("report_date", day)
        .withColumn("week_ending", F.coalesce(_week_of(t), _week_of(undoubled), last_saturday(F.col("report_date"))))
        .drop("text")
    )


def _cell(i: int) -> Column:
    return F.get("cells", F.lit(i))


def segment_rows(rows: DataFrame) -> DataFrame:
    """Status counts per segment from rows of twelve cells that start with 'NPA: nnn'."""
    code = F.regexp_extract(F.coalesce(_cell(0), F.lit("")), r"(?i)NPA:\s*(\d{3})", 1)
    others = [c for c in rows.columns if c != "cells"]
    return rows.where(code != "").select(
        *others,
        code.cast("int").alias("segment"),
        *[clean_int(_cell(i)).alias(s) for i, s in enumerate(STATUSES, start=1)],
        clean_int(_cell(8)).alias("total_in_use"),
        clean_pct(_cell(9)).alias("pct_in_use"),
        clean_int(_cell(10)).alias("spare"),
        clean_int(_cell(11)).alias("total_pool"),
    )


def flow_rows(rows: DataFrame) -> DataFrame:
    """Weekly flow from rows of nine cells, or of ten with a blank fifth one."""
    shift = F.when(F.size("cells") >= 10, 1).otherwise(0)
    late = ("reserved_during_week", "spared_from_disconnect", "spared_from_reserved", "spared_from_unavail", "total_spared_week")
    others = [c for c in rows.columns if c != "cells"]
    out = rows.select(
        *others,
        us_date(_cell(0)).alias("week_ending"),
        clean_int(_cell(1)).alias("total_in_use"),
        clean_int(_cell(2)).alias("spare"),
        clean_int(_cell(3)).alias("growth_week"),
        *[clean_int(F.get("cells", shift + i)).alias(n) for i, n in enumerate(late, start=4)],
    )
    return out.where(F.col("week_ending").isNotNull())


def forecast_rows(rows: DataFrame) -> DataFrame:
    """Forecasts from rows of four cells that start with 'label (observations)'."""
    label = F.coalesce(_cell(0), F.lit(""))
    count = F.regexp_extract(label, r"\((\d+)\)", 1)
    others = [c for c in rows.columns if c != "cells"]
    return rows.where(count != "").select(
        *others,
        count.cast("int").alias("horizon_months"),
        F.trim(F.substring_index(label, "(", 1)).alias("start_label"),
        clean_int(_cell(1)).alias("monthly_rate_of_change"),
        clean_int(_cell(2)).alias("months_to_exhaust"),
        month_year_date(_cell(3)).alias("predicted_exhaust_date"),
    )


def first_seen_week(flows: DataFrame, order: str) -> DataFrame:
    """One row per week: the one of the first report in name order."""
    w = Window.partitionBy("week_ending").orderBy(order)
    return flows.withColumn("n", F.row_number().over(w)).where(F.col("n") == 1).drop("n")


# --- series. One row per week: windows over the whole table are small -----------------


def latest_week(rows: DataFrame, week: str = "week_ending") -> DataFrame:
    """All rows of the newest week."""
    newest = rows.select(F.max(week).alias(week))
    return rows.join(F.broadcast(newest), week, "left_semi")


def last_n_weeks(flows: DataFrame, n: int = 104) -> DataFrame:
    """The newest n weeks with a known growth, oldest first."""
    known = flows.where(F.col("growth_week").isNotNull())
    return known.orderBy(F.desc("week_ending")).limit(n).orderBy("week_ending")


def weeks_since_growth(flows: DataFrame) -> DataFrame:
    """Number of newest weeks in a row in which the spare pool did not grow; gaps are skipped."""
    known = flows.where(F.col("growth_week").isNotNull())
    last_fall = F.max(F.when(F.col("growth_week") < 0, F.col("week_ending"))).over(Window.partitionBy())
    after = known.withColumn("last_fall", last_fall)
    return after.agg(
        F.count_if(F.col("last_fall").isNull() | (F.col("week_ending") > F.col("last_fall"))).alias("weeks_since_growth")
    )


def pool_summary(flows: DataFrame) -> DataFrame:
    """The newest week with the pool total and the share in use."""
    used, spare = F.coalesce("total_in_use", F.lit(0)), F.coalesce("spare", F.lit(0))
    return latest_week(flows).select(
        "week_ending",
        "total_in_use",
        "spare",
        "growth_week",
        "reserved_during_week",
        "total_spared_week",
        (used + spare).alias("pool_total"),
        F.coalesce(used / F.nullif(used + spare, F.lit(0)) * 100, F.lit(0.0)).alias("pct_in_use"),
    )


def missed_forecasts(forecasts: DataFrame, as_of: Column) -> DataFrame:
    """Forecasts whose day has passed."""
    return forecasts.where(F.col("predicted_exhaust_date") < as_of).select(
        "week_ending", "horizon_months", "predicted_exhaust_date"
    )


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    """The forecasts of the newest week, by horizon; dated or not."""
    known = forecasts.where(F.col("week_ending").isNotNull())
    return latest_week(known).select("week_ending", "horizon_months", "predicted_exhaust_date").orderBy("horizon_months")


def forecast_fan(forecasts: DataFrame) -> DataFrame:
    """Dated forecasts by horizon and week."""
    dated = forecasts.where(F.col("week_ending").isNotNull() & F.col("predicted_exhaust_date").isNotNull())
    return dated.select("horizon_months", "week_ending", "predicted_exhaust_date").orderBy(
        "horizon_months", "week_ending"
    )


def segment_history(pool: DataFrame) -> DataFrame:
    """Status counts of each segment and week as (segment, week, status, value) with the fill."""
    return pool.unpivot(
        ["segment", "week_ending", "pct_in_use"], list(STATUSES), "status", "value"
    ).withColumn("value", F.coalesce("value", F.lit(0)))


def melt_statuses(pool: DataFrame) -> DataFrame:
    """The same without the series of a segment that are zero in every week."""
    long = segment_history(pool)
    live = F.max(F.col("value") != 0).over(Window.partitionBy("segment", "status"))
    return long.withColumn("live", live).where(F.col("live")).drop("live")
