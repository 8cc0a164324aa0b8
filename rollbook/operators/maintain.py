"""Upkeep of derived tables: a load recomputes only the pairs of periods that it touched.

A derived row belongs to the later period of its pair. A period that is new, late or replaced
touches its own pair and that of the period after it; a late one also changes whom the period
after it is compared with. So of the snapshot table, the touched periods and those before them
are read, and of the derived table, the partitions of the touched periods are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.operators.diff import period_index
from rollbook.sources.sinks import drop_partitions, existing_periods

#: Derives rows with a column of the later period from (snapshot, periods).
Build = Callable[[DataFrame, DataFrame], DataFrame]


def touched_periods(held: DataFrame, changed: list[str]) -> DataFrame:
    """(period, prev_period) of the pairs to recompute. `held` has the periods that exist, one
    row each, `changed` those that were added, replaced or removed."""
    named = held.sparkSession.createDataFrame([(p, True) for p in sorted(set(changed))], "period string, changed boolean")
    # a removed period is not held any more, but still stands before the one it touches
    line = held.select("period", F.lit(True).alias("held")).join(named, "period", "full")
    w = Window.orderBy("period")  # a row per period of the calendar
    since = w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.struct("period", "changed", "held")
    near = line.select("*", F.max(F.when(F.col("held"), F.struct("period"))).over(since).alias("last"), F.lag(before).over(w).alias("before"))
    # all removed periods in a row touch the held one behind them
    touched = F.col("changed") | F.col("before.changed")
    return near.where(F.col("held") & F.coalesce(touched, F.lit(False))).select("period", F.col("last.period").alias("prev_period"))


def refresh(spark: SparkSession, snapshots: str, target: str, build: Build, changed: list[str], period_col: str = "period") -> list[str]:
    """Brings the table at `target`, which is partitioned by `period_col`, up to the snapshots.

    Returns the periods whose rows were computed anew. A failed run is repaired by running it
    again: the partitions to replace are the same.
    """
    held = existing_periods(spark, snapshots)
    # one row for each touched period of the calendar
    pairs = [(r["period"], r["prev_period"]) for r in touched_periods(held, changed).collect()]
    current = sorted(p for p, _ in pairs)
    gone = set(changed) - {r["period"] for r in held.collect()}
    needed = sorted({p for pair in pairs for p in pair if p is not None})
    snapshot = spark.read.parquet(snapshots)
    snapshot = snapshot.withColumn("period", F.col("period").cast("string")).where(F.col("period").isin(needed))
    rows = build(snapshot, period_index(held)).where(F.col(period_col).isin(current))
    drop_partitions(spark, target, period_col, sorted({*current, *gone}))
    rows.write.mode("append").option("compression", "zstd").partitionBy(period_col).parquet(target)
    return current
