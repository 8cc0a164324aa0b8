"""Comparison of two exports of the same month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("status", "date", "template", "sub_owner")


def align(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Both exports side by side, joined by phone, so that a missing line shifts nothing."""
    a = ours.select("phone", F.struct(*[F.trim(c).alias(c) for c in FIELDS]).alias("ours"))
    b = theirs.select("phone", F.struct(*[F.trim(c).alias(c) for c in FIELDS]).alias("theirs"))
    return a.join(b, "phone", "full")


def difference(pairs: DataFrame) -> DataFrame:
    """Each phone with its finding: equal, only_ours, only_theirs or the differing fields."""
    parts = [F.when(F.col(f"ours.{c}") != F.col(f"theirs.{c}"), c) for c in FIELDS]
    fields = F.concat_ws("+", *parts)
    finding = (
        F.when(F.col("theirs").isNull(), "only_ours")
        .when(F.col("ours").isNull(), "only_theirs")
        .when(fields == "", "equal")
        .otherwise(fields)
    )
    return pairs.withColumn("finding", finding)


def field_report(found: DataFrame) -> DataFrame:
    return found.groupBy("finding").agg(F.count("*").alias("n"))


def code_pair_report(found: DataFrame) -> DataFrame:
    """Differing codes as (theirs, ours) with counts."""
    changed = found.where(F.col("ours.sub_owner") != F.col("theirs.sub_owner"))
    return changed.groupBy(
        F.col("theirs.sub_owner").alias("their_code"), F.col("ours.sub_owner").alias("our_code")
    ).agg(F.count("*").alias("n"))


def verdict(found: DataFrame, corrected_code: str) -> DataFrame:
    """Totals, and passed when every difference is the known correction of the code."""
    differs = ~F.col("finding").isin("equal", "only_ours", "only_theirs")
    expected = (F.col("finding") == "sub_owner") & (F.col("ours.sub_owner") == corrected_code)
    return found.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("finding") == "equal").alias("equal"),
        F.count_if(differs).alias("differing"),
        F.count_if(F.col("finding") == "only_ours").alias("only_ours"),
        F.count_if(F.col("finding") == "only_theirs").alias("only_theirs"),
        F.count_if(differs & expected).alias("expected"),
        (F.count_if(differs & ~F.coalesce(expected, F.lit(False))) == 0).alias("passed"),
    )
