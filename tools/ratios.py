"""Our own ratios: one-pass diff against pairwise full outer joins, and rows/s of the cascade.

usage: python tools/ratios.py [sf_dir]
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rollbook.operators import diff, rules  # noqa: E402
from rollbook.plans import base  # noqa: E402
from rollbook.session import local_session, materialise  # noqa: E402


def timed(run) -> float:
    best = None
    for _ in range(2):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - start
        best = took if best is None else min(best, took)
    return best


def pairwise(rows, n):
    """One full outer join per pair of periods, as the plain formulation has it."""
    out = None
    for i in range(1, n):
        both = diff.full_diff(rows.where(F.col("idx") == i), rows.where(F.col("idx") == i + 1))
        one = both.agg(
            F.count_if(diff.is_transfer()).alias("transfers"),
            F.count_if(diff.is_appeared()).alias("appeared"),
            F.count_if(diff.is_disappeared()).alias("disappeared"),
        ).withColumn("idx", F.lit(i + 1))
        out = one if out is None else out.unionByName(one)
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    snap, periods = base.dated(spark, sf)
    rows = materialise(diff.with_period_index(snap, periods), "ratio-snapshot")
    when = materialise(periods, "ratio-periods")
    n = when.count()
    one = timed(lambda: diff.pair_totals(rows.drop("idx", "n_periods"), when))
    many = timed(lambda: pairwise(rows, n))
    print(f"one pass {one:.2f}s, {n - 1} pairwise full outer joins {many:.2f}s, ratio {many / one:.1f}")
    full = materialise(rules.gap_fill(base.adjust_input(spark, sf), 0, base.top_suffix(spark, sf), "key"), "ratio-filled")
    count = full.count()
    over = materialise(base.overrides(spark, sf), "ratio-overrides")
    took = timed(lambda: rules.adjust_snapshot(full, base.PHONE_RULES, base.RENAME_RULES, base.STATUS_RULES, over))
    print(f"cascade over {count} rows {took:.2f}s, {count / took:,.0f} rows/s")


if __name__ == "__main__":
    main()
