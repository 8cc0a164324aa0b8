"""Ranks, leaderboards and series. The inputs hold one row per owner (and period), so the
windows over the whole table stay small; none of them is used on key-level rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.constants import ENRICHMENT_MIN_WORKING, GROWTH_MIN_START, OPPORTUNISM_MIN_ACQUIRED


def rank_with_total(values: DataFrame, name: str) -> DataFrame:
    """(owner, value) to (owner, <name>_rank, <name>_total); rank 1 has the largest value."""
    w = Window.orderBy(F.desc_nulls_last("value"))
    return values.select(
        "owner",
        F.rank().over(w).alias(f"{name}_rank"),
        F.count("*").over(Window.partitionBy()).alias(f"{name}_total"),
    )


def first_last(rollup: DataFrame) -> DataFrame:
    """First and last period with inventory per owner, without a self join."""
    held = rollup.where(F.col("inventory") > 0)
    ends = held.groupBy("owner").agg(
        F.min("period").alias("first_period"),
        F.min_by("inventory", "period").alias("start_inventory"),
        F.max("period").alias("last_period"),
        F.max_by("inventory", "period").alias("end_inventory"),
    )
    delta = F.col("end_inventory") - F.col("start_inventory")
    return ends.withColumn("delta", delta).withColumn(
        "pct", delta / F.nullif(F.col("start_inventory"), F.lit(0)) * 100
    )


#: The ranked measures, in the order of their columns.
MEASURES = ("inv", "opp", "growth", "match", "age")


def measures(
    rollup: DataFrame,
    enrichment: DataFrame,
    min_acquired: int = OPPORTUNISM_MIN_ACQUIRED,
    min_start: int = GROWTH_MIN_START,
    min_working: int = ENRICHMENT_MIN_WORKING,
) -> DataFrame:
    """(owner, metric, value) of the ranked measures, each with its own rule of eligibility.

    Inventory, opportunism and growth come from one aggregation of the roll-up; the
    inventory is that of the greatest period of all owners.
    """
    held = F.when(F.col("inventory") > 0, F.col("period"))
    own = rollup.groupBy("owner").agg(
        F.max("period").alias("last"),
        F.max_by("inventory", "period").alias("inventory"),
        F.sum("acquired").alias("acquired"),
        F.sum("harvested_cross_owner").alias("harvested"),
        F.min_by("inventory", held).alias("start"),
        F.max_by("inventory", held).alias("end"),
    )
    newest = F.max("last").over(Window.partitionBy())  # a row per owner
    own = own.withColumn("newest", newest)
    both = own.join(enrichment.select("owner", "working_count", "match_count", "median_age_months"), "owner", "full")
    enough = F.col("working_count") > min_working
    values = {
        "inv": F.when((F.col("last") == F.col("newest")) & (F.col("inventory") > 0), F.col("inventory")),
        "opp": F.when(F.col("acquired") > min_acquired, F.col("harvested") / F.col("acquired")),
        "growth": F.when(F.col("start") > min_start, F.col("end") - F.col("start")),
        "match": F.when(enough, F.col("match_count") / F.col("working_count")),
        "age": F.when(enough, F.col("median_age_months")),
    }
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), values[n].cast("double").alias("value")) for n in MEASURES])
    return both.select("owner", F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))


def ranks(stacked: DataFrame, names: Sequence[str] = MEASURES) -> DataFrame:
    """One row per owner that has any rank: rank and number of ranked owners by measure.

    The measures are stacked, so one window and one aggregation rank any number of them.
    """
    by_metric = Window.partitionBy("metric")
    ranked = stacked.select(
        "owner", "metric", F.rank().over(by_metric.orderBy(F.desc("value"))).alias("rank"), F.count("*").over(by_metric).alias("total")
    )
    cells = []
    for n in names:
        own = F.col("metric") == n
        cells += [F.max(F.when(own, F.col("rank"))).alias(f"{n}_rank"), F.max(F.when(own, F.col("total"))).alias(f"{n}_total")]
    return ranked.groupBy("owner").agg(*cells)


def trajectory_leaders(rollup: DataFrame, min_start: int, k: int = 15) -> DataFrame:
    """The k largest growers and the k largest shrinkers."""
    moved = first_last(rollup).where(F.col("start_inventory") > min_start)
    up = moved.orderBy(F.desc("delta"), "owner").limit(k).withColumn("side", F.lit("growers"))
    down = moved.orderBy("delta", F.desc("owner")).limit(k).withColumn("side", F.lit("shrinkers"))
    return up.unionByName(down)


def owner_trajectory(rollup: DataFrame) -> DataFrame:
    """Totals, index, ends and change of every owner's whole series."""
    series = rollup.groupBy("owner").agg(
        F.count("*").alias("n_periods"),
        F.sum("acquired").alias("acquired"),
        F.sum("harvested_cross_owner").alias("harvested"),
        F.sum("lost").alias("lost"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.min_by("inventory", "period").alias("first_inventory"),
        F.max_by("inventory", "period").alias("last_inventory"),
    )
    delta = F.col("last_inventory") - F.col("first_inventory")
    return (
        series.withColumn(
            "opportunism",
            F.coalesce(F.col("harvested") / F.nullif(F.col("acquired"), F.lit(0)), F.lit(0.0)),
        )
        .withColumn("delta", delta)
        .withColumn("pct", F.coalesce(delta / F.nullif(F.col("first_inventory"), F.lit(0)) * 100, F.lit(0.0)))
    )


def sampled_trajectory(rollup: DataFrame, target: int = 14) -> DataFrame:
    """Every k-th row of each owner's series and its last, k = max(1, n div target)."""
    w = Window.partitionBy("owner")
    numbered = rollup.withColumn("i", F.row_number().over(w.orderBy("period")) - 1).withColumn(
        "n", F.count("*").over(w)
    )
    step = F.greatest(F.lit(1), F.floor(F.col("n") / target))
    return numbered.where((F.col("i") % step == 0) | (F.col("i") == F.col("n") - 1)).drop("i", "n")


def net_change(series: DataFrame, label: str = "label") -> DataFrame:
    """Value in the global last period (0 if absent) minus the first value of each series."""
    ends = series.groupBy(label).agg(
        F.min_by("value", "period").alias("baseline"),
        F.max("period").alias("own_last"),
        F.max_by("value", "period").alias("own_final"),
    )
    last = F.max("own_last").over(Window.partitionBy())
    final = F.when(F.col("own_last") == last, F.col("own_final")).otherwise(0)
    return ends.select(label, "baseline", final.alias("final"), (final - F.col("baseline")).alias("delta"))


def indexed_series(series: DataFrame, label: str = "label") -> DataFrame:
    """Every value as a percentage of the first non-zero value of its series."""
    w = Window.partitionBy(label)
    base = F.min_by(F.when(F.col("value") > 0, F.col("value")), F.when(F.col("value") > 0, F.col("period"))).over(w)
    scaled = series.withColumn("base", base).where(F.col("base").isNotNull())
    return scaled.select(label, "period", (F.lit(100.0) * F.col("value") / F.col("base")).alias("pct"))


def stacked_series(series: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Running sum across the series of each period, in the order of labels; a missing
    point counts as 0."""
    order = F.array(*[F.lit(x) for x in labels])
    spine = series.select("period").distinct().select("period", F.posexplode(order).alias("pos", "label"))
    filled = spine.join(series.select("label", "period", "value"), ["label", "period"], "left")
    w = Window.partitionBy("period").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.coalesce(F.col("value"), F.lit(0))
    return filled.select("label", "period", value.alias("value"), F.sum(value).over(w).alias("top"))


def other_bucket(members: DataFrame, k: int = 8) -> DataFrame:
    """Per category the k largest members and one row for the rest, with shares."""
    w = Window.partitionBy("category").orderBy(F.desc("inventory"), "owner")
    ranked = members.withColumn("ord", F.row_number().over(w)).where(F.col("inventory") > 0)
    slot = F.when(F.col("ord") <= k, F.col("owner")).otherwise("(others)")
    slices = ranked.groupBy("category", slot.alias("slot")).agg(
        F.sum("inventory").alias("value"), F.count("*").alias("n_owners")
    )
    total = F.sum("value").over(Window.partitionBy("category"))
    return slices.withColumn("share", F.col("value") / total)
