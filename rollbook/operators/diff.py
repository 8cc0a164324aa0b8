"""Differences between consecutive snapshots, for all pairs in one pass.

A snapshot table has one row per (key, period). Joining each period to the next would
shuffle every snapshot twice; here the table is shuffled once by key and each row sees its
neighbours through lag and lead. A key's group holds one row per period, so no group
can grow with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.constants import DISCONN, WORKING
from rollbook.functions.calendar import month_ordinal


def period_index(snapshot: DataFrame) -> DataFrame:
    """(period, idx, prev_period, n_periods) over the periods that exist.

    One row per calendar period, so the windows over the whole of it stay small.
    """
    periods = snapshot.select("period").distinct()
    return periods.select(
        "period",
        F.row_number().over(Window.orderBy("period")).cast("long").alias("idx"),
        F.lag("period").over(Window.orderBy("period")).alias("prev_period"),
        F.count("*").over(Window.partitionBy()).alias("n_periods"),
    )


def with_period_index(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Add idx and n_periods. The dimension is bounded by the calendar, so it is broadcast.

    Pass periods where they are known more cheaply than by a scan of the snapshot table,
    for example from its partitions.
    """
    numbers = (periods or period_index(snapshot)).select("period", "idx", "n_periods")
    return snapshot.join(F.broadcast(numbers), "period")


def pair_changes(
    snapshot: DataFrame,
    periods: DataFrame | None = None,
    owner_col: str = "owner",
    keep: Sequence[str] = (),
    baseline: bool = False,
) -> DataFrame:
    """One row per key and consecutive pair of periods in which the key occurs.

    idx is the number of the later period. prev_* is NULL when the key was absent before,
    the plain columns are NULL when it is absent after. With baseline=True the rows of the
    first period come along under idx 1.
    """
    sides = {"owner": F.col(owner_col), "status": F.col("status"), **{c: F.col(c) for c in keep}}
    rows = with_period_index(snapshot, periods).select(
        "key", "idx", "n_periods", *[c.alias(n) for n, c in sides.items()]
    )
    w = Window.partitionBy("key").orderBy("idx")
    types = dict(rows.dtypes)

    def seen(prev: Column, curr: Column, idx: Column) -> Column:
        return F.struct(
            idx.alias("idx"),
            *[F.when(prev, F.col(f"lag_{n}")).alias(f"prev_{n}") for n in sides],
            *[F.when(curr, F.col(n)).alias(n) for n in sides],
        )

    yes = F.lit(True)
    looked = rows.select(
        "*",
        F.lag("idx").over(w).alias("lag_idx"),
        F.lead("idx").over(w).alias("lead_idx"),
        *[F.lag(n).over(w).alias(f"lag_{n}") for n in sides],
    )
    first = F.lit(True) if baseline else F.col("idx") > 1
    arrival = F.when(first, seen(F.col("lag_idx") == F.col("idx") - 1, yes, F.col("idx")))
    gone = (F.col("idx") < F.col("n_periods")) & (
        F.col("lead_idx").isNull() | (F.col("lead_idx") > F.col("idx") + 1)
    )
    departure = F.when(
        gone,
        F.struct(
            (F.col("idx") + 1).alias("idx"),
            *[F.col(n).alias(f"prev_{n}") for n in sides],
            *[F.lit(None).cast(types[n]).alias(n) for n in sides],
        ),
    )
    both = F.filter(F.array(arrival, departure), lambda x: x.isNotNull())
    return looked.select("key", F.inline(both))


def is_appeared() -> Column:
    return F.col("prev_owner").isNull()


def is_disappeared() -> Column:
    return F.col("owner").isNull()


def is_transfer() -> Column:
    return F.col("prev_owner") != F.col("owner")


def is_landing() -> Column:
    return is_transfer() & (F.col("prev_status") == DISCONN)


def is_reactivation() -> Column:
    return (
        (F.col("prev_owner") == F.col("owner"))
        & (F.col("prev_status") == DISCONN)
        & (F.col("status") == WORKING)
    )


def is_unchanged() -> Column:
    return (F.col("prev_owner") == F.col("owner")) & (F.col("prev_status") == F.col("status"))


def changed_only(changes: DataFrame) -> DataFrame:
    """Drop the keys whose owner and status both stayed."""
    return changes.where(~F.coalesce(is_unchanged(), F.lit(False)))


def name_pairs(per_idx: DataFrame, periods: DataFrame) -> DataFrame:
    """Replace idx by prev_period, curr_period and the calendar months between them."""
    names = periods.select("idx", F.col("period").alias("curr_period"), "prev_period")
    named = per_idx.join(F.broadcast(names), "idx")
    covered = month_ordinal(F.col("curr_period")) - month_ordinal(F.col("prev_period"))
    return named.withColumn("months_covered", F.coalesce(covered, F.lit(0)).cast("long")).drop("idx")


def pair_totals(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Event counts of every consecutive pair of periods."""
    totals = pair_changes(snapshot, periods).groupBy("idx").agg(
        F.count_if(is_transfer()).alias("transfers"),
        F.count_if(is_landing()).alias("landings"),
        F.count_if(is_reactivation()).alias("reactivations"),
        F.count_if(is_appeared()).alias("appeared"),
        F.count_if(is_disappeared()).alias("disappeared"),
        F.count_if(is_unchanged()).alias("unchanged"),
    )
    return name_pairs(totals, periods or period_index(snapshot))


def event_totals(prev: DataFrame, curr: DataFrame) -> DataFrame:
    """One row of totals for two given snapshots."""
    both = full_diff(prev, curr)
    return both.agg(
        F.count_if(is_appeared()).alias("appeared"),
        F.count_if(is_disappeared()).alias("disappeared"),
        F.count_if(is_transfer()).alias("transfers"),
        F.count_if(is_landing()).alias("landings"),
    )


def full_diff(prev: DataFrame, curr: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """Full outer join of two snapshots, sides named as in pair_changes."""
    a = prev.select(*on, F.col("owner").alias("prev_owner"), F.col("status").alias("prev_status"))
    b = curr.select(*on, "owner", "status")
    return a.join(b, list(on), "full")


def shifted(indexed: DataFrame) -> DataFrame:
    """The same rows under the number of the following period, for pairwise joins."""
    return indexed.where(F.col("idx") < F.col("n_periods")).withColumn("idx", F.col("idx") + 1)


def transfers(prev: DataFrame, curr: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """Keys held on both sides by different owners."""
    a = prev.select(*on, F.col("owner").alias("prev_owner"), F.col("status").alias("prev_status"))
    b = curr.select(*on, "owner", "status")
    return a.join(b, list(on)).where(is_transfer())


def appeared(prev: DataFrame, curr: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """Rows of curr whose key is absent in prev."""
    return curr.join(prev.select(*on), list(on), "left_anti")


def owner_fate(prev: DataFrame, curr: DataFrame, on: Sequence[str] = ("key",)) -> DataFrame:
    """Every key of prev with its state in curr, absent ones kept."""
    a = prev.select(*on, F.col("owner").alias("prev_owner"), F.col("status").alias("prev_status"))
    return a.join(curr.select(*on, "owner", "status"), list(on), "left")


def fate_breakdown(fate: DataFrame, *by: str) -> DataFrame:
    """Where the keys of each former owner went, with counts by status before and after."""
    destination = (
        F.when(F.col("owner").isNull(), "(vanished)")
        .when(F.col("owner") == F.col("prev_owner"), "(still)")
        .otherwise(F.col("owner"))
    )
    return fate.groupBy(*by, F.col("prev_owner"), destination.alias("destination")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("prev_status") == DISCONN).alias("from_disconn"),
        F.count_if(F.col("prev_status") == WORKING).alias("from_working"),
        F.count_if(F.col("status") == DISCONN).alias("to_disconn"),
        F.count_if(F.col("status") == WORKING).alias("to_working"),
    )


def code_level_totals(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Event totals at the grain of the full code: any change of code is a transfer, but a
    landing also needs another owner."""
    held = snapshot.withColumn("holder", F.col("owner"))
    moves = pair_changes(held, periods, owner_col="sub_owner", keep=("holder",))
    landing = is_landing() & (F.col("prev_holder") != F.col("holder"))
    same = F.col("prev_owner") == F.col("owner")
    totals = moves.groupBy("idx").agg(
        F.count_if(is_transfer()).alias("transfers"),
        F.count_if(landing).alias("landings"),
        F.count_if(is_reactivation()).alias("reactivations"),
        F.count_if(is_appeared()).alias("appeared"),
        F.count_if(is_disappeared()).alias("disappeared"),
        F.count_if(same & (F.col("prev_status") != F.col("status"))).alias("status_changed"),
        F.count_if(is_unchanged()).alias("unchanged"),
    )
    return name_pairs(totals, periods or period_index(snapshot))


def code_level_status_pairs(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Status transitions of keys that kept their full code."""
    moves = pair_changes(snapshot, periods, owner_col="sub_owner")
    kept = (F.col("prev_owner") == F.col("owner")) & (F.col("prev_status") != F.col("status"))
    return moves.where(kept).groupBy("prev_status", "status").agg(F.count("*").alias("n"))


def code_level_owner_flows(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Acquired, harvested and lost keys per owner and pair, counted on changes of full code."""
    held = snapshot.withColumn("holder", F.col("owner"))
    moves = pair_changes(held, periods, owner_col="sub_owner", keep=("holder",))
    harvested = is_landing() & (F.col("prev_holder") != F.col("holder"))
    took = F.coalesce(is_transfer(), F.lit(True)) & F.col("owner").isNotNull()
    left = F.coalesce(is_transfer(), F.lit(True)) & F.col("prev_owner").isNotNull()

    def entry(owner: Column, got: Column, harvest: Column, lost: Column) -> Column:
        return F.struct(
            owner.alias("owner"),
            got.cast("int").alias("acquired"),
            F.coalesce(harvest, F.lit(False)).cast("int").alias("harvested"),
            lost.cast("int").alias("lost"),
        )

    no = F.lit(False)
    sides = F.array(
        F.when(took, entry(F.col("holder"), F.lit(True), harvested, no)),
        F.when(left, entry(F.col("prev_holder"), no, no, F.lit(True))),
    )
    flat = moves.select("idx", F.inline(F.filter(sides, lambda s: s.isNotNull())))
    return flat.groupBy("idx", "owner").agg(
        F.sum("acquired").alias("acquired"),
        F.sum("harvested").alias("harvested"),
        F.sum("lost").alias("lost"),
    )
