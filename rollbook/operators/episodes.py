"""Runs of equal state over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.constants import ABBREVIATED_MAX_PERIODS, DISCONN
from rollbook.functions.calendar import period_ordinal
from rollbook.functions.keys import status_name


def disconnect_runs(snapshot: DataFrame) -> DataFrame:
    """Uninterrupted stays of a key in DISCONN under one owner.

    The calendar number counts, so a missing snapshot ends a run.
    """
    fallen = snapshot.where(F.col("status") == DISCONN).select(
        "key", "owner", period_ordinal(F.col("period")).alias("p")
    )
    w = Window.partitionBy("key", "owner").orderBy("p")
    marked = fallen.withColumn("run", F.col("p") - F.row_number().over(w))
    return marked.groupBy("key", "owner", "run").agg(
        F.count("*").alias("duration"), F.min("p").alias("start")
    ).drop("run")


def episode_histogram(runs: DataFrame) -> DataFrame:
    return runs.groupBy("owner", "duration").agg(F.count("*").alias("n_events"))


def episode_summary(runs: DataFrame, short: int = ABBREVIATED_MAX_PERIODS) -> DataFrame:
    """Short and long stays per owner, and what the share of short ones says."""
    sums = runs.groupBy("owner").agg(
        F.count_if(F.col("duration") <= short).alias("n_abbreviated"),
        F.count_if(F.col("duration") > short).alias("n_standard"),
        F.count("*").alias("n_total"),
    )
    rate = F.col("n_abbreviated") / F.col("n_total")
    # The limits of the two labels.
    label = F.when(rate > 0.6, "early").when(rate < 0.3, "normal")
    return sums.withColumn("abbrev_rate", rate).withColumn("label", label)


def history_timeline(snapshot: DataFrame) -> DataFrame:
    """Stretches of equal owner and status per key over the snapshots in which it occurs.

    Only neighbouring rows count: a missing period does not end a stretch.
    """
    w = Window.partitionBy("key").orderBy("period")
    same = (F.lag("owner").over(w) == F.col("owner")) & (F.lag("status").over(w) == F.col("status"))
    marked = snapshot.withColumn("starts", (~F.coalesce(same, F.lit(False))).cast("int"))
    # only the first and the last row of a stretch go on; all windows share one order
    borders = marked.select(
        "*",
        F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("part"),
        (F.coalesce(F.lead("starts").over(w), F.lit(1)) == 1).alias("ends"),
        F.lead("period").over(w).isNull().alias("newest"),
    ).where((F.col("starts") == 1) | F.col("ends"))
    closed = borders.select("*", F.lead("period").over(w).alias("next_period"), F.lead("newest").over(w).alias("next_newest"))
    stretches = closed.where(F.col("starts") == 1).select(
        "key",
        "part",
        F.col("period").alias("start_period"),
        F.when(F.col("ends"), F.col("period")).otherwise(F.col("next_period")).alias("end_period"),
        "owner",
        "status",
        "sub_owner",
        F.col("changed_at").alias("last_change"),
        F.when(F.col("ends"), F.col("newest")).otherwise(F.col("next_newest")).alias("is_current"),
    )
    return stretches.select(
        "key",
        "part",
        "start_period",
        "end_period",
        "owner",
        "sub_owner",
        status_name(F.col("status")).alias("status"),
        "last_change",
        "is_current",
    )
