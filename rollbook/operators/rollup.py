"""Owner and period roll-ups, the fact table of all reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.constants import OPPORTUNISM_MIN_ACQUIRED, SEGMENTS
from rollbook.operators import diff


def owner_period_rollup(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Inventory and flows per owner and period.

    A change row counts for its new owner and for its former owner. Both views are
    unfolded from the same row, so one aggregation replaces two and their join, and owners
    that vanished come out with inventory 0. The first period has inventory only.
    """
    moves = diff.pair_changes(snapshot, periods, baseline=True)
    later = F.col("idx") > 1
    measures = (
        "inventory",
        "appeared_from_spare",
        "transfers_in",
        "harvested_cross_owner",
        "harvested_own_reactivation",
        "disappeared_to_spare",
        "transfers_out",
    )

    def entry(owner: Column, **flags: Column) -> Column:
        cells = [F.coalesce(flags.get(m, F.lit(False)), F.lit(False)).cast("int").alias(m) for m in measures]
        return F.struct(owner.alias("owner"), *cells)

    new_side = F.when(
        F.col("owner").isNotNull(),
        entry(
            F.col("owner"),
            inventory=F.lit(True),
            appeared_from_spare=later & diff.is_appeared(),
            transfers_in=diff.is_transfer(),
            harvested_cross_owner=diff.is_landing(),
            harvested_own_reactivation=diff.is_reactivation(),
        ),
    )
    old_side = F.when(
        F.col("prev_owner").isNotNull(),
        entry(F.col("prev_owner"), disappeared_to_spare=diff.is_disappeared(), transfers_out=diff.is_transfer()),
    )
    flat = moves.select("idx", F.inline(F.filter(F.array(new_side, old_side), lambda x: x.isNotNull())))
    sums = flat.groupBy("owner", "idx").agg(*[F.sum(m).alias(m) for m in measures])
    named = diff.name_pairs(sums, periods or diff.period_index(snapshot))
    return named.select(
        "owner",
        F.col("curr_period").alias("period"),
        "months_covered",
        "inventory",
        (F.col("appeared_from_spare") + F.col("transfers_in")).alias("acquired"),
        (F.col("disappeared_to_spare") + F.col("transfers_out")).alias("lost"),
        "transfers_in",
        "transfers_out",
        "harvested_cross_owner",
        "harvested_own_reactivation",
        "appeared_from_spare",
        "disappeared_to_spare",
    )


def latest_snapshot(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Rows of the greatest period. It is a scalar in the filter, so a table partitioned by
    period reads one partition only."""
    newest = (snapshot if periods is None else periods).agg(F.max("period")).scalar()
    return snapshot.where(F.col("period") == newest)


def owner_snapshot(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("owner", "segment", "status").agg(F.count("*").alias("n"))


def owner_subcodes(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("owner", "sub_owner").agg(F.count("*").alias("n"))


def owner_inventory(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("owner").agg(F.count("*").alias("inventory"))


def distinct_owner_count(snapshot: DataFrame) -> DataFrame:
    return snapshot.agg(F.countDistinct("owner").alias("n_owners"))


def opportunism(rollup: DataFrame, min_acquired: int = OPPORTUNISM_MIN_ACQUIRED) -> DataFrame:
    """Share of acquired keys that were taken from other owners' disconnected keys."""
    sums = rollup.groupBy("owner").agg(
        F.sum("acquired").alias("acquired"),
        F.sum("harvested_cross_owner").alias("harvested"),
        F.sum("lost").alias("lost"),
        F.sum("appeared_from_spare").alias("appeared"),
    )
    index = F.col("harvested").cast("double") / F.nullif(F.col("acquired"), F.lit(0))
    return sums.where(F.col("acquired") > min_acquired).withColumn("opportunism", index)


def excluded_periods(rollup: DataFrame, excluded: list[str]) -> DataFrame:
    """Drop the named periods and the baseline period."""
    first = rollup.select(F.min("period").alias("period"))
    kept = rollup.where(~F.col("period").isin(excluded)) if excluded else rollup
    return kept.join(F.broadcast(first), "period", "left_anti")


def segment_breakdown(snapshot: DataFrame, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """Count per owner and segment with every segment present, share of maximum and total."""
    counts = snapshot.groupBy("owner").agg(
        *[F.count_if(F.col("segment") == s).alias(f"s{s}") for s in segments]
    )
    cells = F.array(*[F.struct(F.lit(s).alias("segment"), F.col(f"s{s}").alias("n")) for s in segments])
    most = F.greatest(*[F.col(f"s{s}") for s in segments])
    total = sum((F.col(f"s{s}") for s in segments), F.lit(0))
    return counts.select("owner", most.alias("most"), total.alias("total"), F.inline(cells)).select(
        "owner",
        "segment",
        "n",
        (F.col("n") / F.nullif(F.col("most"), F.lit(0))).alias("share_of_max"),
        (F.col("n") / F.nullif(F.col("total"), F.lit(0))).alias("share_of_total"),
    )


def status_shares(snapshot: DataFrame, test_numbers: int) -> DataFrame:
    """Count per owner and status after the default test numbers are taken off UNAVAIL."""
    counts = snapshot.groupBy("owner", "status").agg(F.count("*").alias("n"))
    real = F.when(F.col("status") == 5, F.col("n") - test_numbers).otherwise(F.col("n"))
    left = counts.withColumn("n", real).where(F.col("n") > 0)
    total = F.sum("n").over(Window.partitionBy("owner"))
    return left.withColumn("share", F.col("n") / total)
