"""The adjustment cascade: four ordered rule passes over snapshot and gap-filled rows.

Rules given as Python tuples become one flat CASE that finds the first matching rule. Rules
given as a table, of any number, are joined: a pattern is its mask (which positions are
fixed) and its fixed characters, so a row has one key per mask, looks all of them up at once,
and carries the least number found along. The rows are dealt by phone once, before the first
pass; looking up and taking the least number leave them where they are, so the passes and the
overrides follow without a further shuffle of rows. Distinct masks are few by nature (at most
two to the power of the pattern's length) and only those are collected.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.constants import SEGMENTS
from rollbook.functions.fence import settled
from rollbook.functions.keys import suffix_text

def matches_pattern(text: Column, pattern: str) -> Column:
    """Equal length and equal characters where the pattern has no '*'."""
    hit = F.length(text) == len(pattern)
    start = 0
    while start < len(pattern):
        if pattern[start] == "*":
            start += 1
            continue
        end = start
        while end < len(pattern) and pattern[end] != "*":
            end += 1
        hit = hit & (F.substring(text, start + 1, end - start) == pattern[start:end])
        start = end
    return hit


def first_match(conditions: Sequence[Column]) -> Column:
    """1-based number of the first condition that holds, or NULL; flat, so of any length."""
    if not conditions:
        return F.lit(None).cast("int")
    out = F.when(conditions[0], 1)
    for n, condition in enumerate(conditions[1:], start=2):
        out = out.when(condition, n)
    return out


def _mask_key(text: Column, mask: str) -> Column:
    """Mask and the characters at its fixed positions; NULL for a text of another length."""
    runs = [F.substring(text, m.start() + 1, len(m[0])) for m in re.finditer("#+", mask)]
    return F.when(F.length(text) == len(mask), F.concat(F.lit(mask), *runs))


def first_rules(rows: DataFrame, rules: DataFrame, text: str, status: str | None = None) -> DataFrame:
    """The rows with the columns of the first rule that fits as struct `rule`, NULL if none does.

    rules: rule_no (unique), pattern and further columns. With a status column the rule's own
    `status` has to be '*' or equal as well. Rows of one phone that are dealt by it stay
    where they are, whatever their number; equal rows are counted and given back as often.
    """
    mask = F.regexp_replace("pattern", "[^*]", "#")
    asked = F.trim("status") if status else F.lit("*")
    key = F.concat(mask, F.replace("pattern", F.lit("*"), F.lit("")), F.lit("|"), asked)
    # of the rules with one key only the first can ever fit
    first = rules.groupBy(key.alias("rule_key")).agg(F.min("rule_no").alias("rule_no"))
    masks = [r[0] for r in rules.select(mask.alias("mask")).distinct().orderBy("mask").collect() if r[0] is not None]
    keys = [_mask_key(F.col(text), m) for m in masks]
    endings = [F.lit("|*")] + ([F.concat(F.lit("|"), F.trim(status))] if status else [])
    every = F.array_compact(F.array(F.lit(None).cast("string"), *[F.concat(k, e) for k in keys for e in endings]))
    own = rows.columns
    asking = rows.withColumn("rule_keys", every)
    asking = asking.select(*own, F.greatest(F.size("rule_keys"), F.lit(1)).alias("asked"), F.explode_outer("rule_keys").alias("rule_key"))
    # grouped by all columns, which the partitioning by phone already satisfies
    met = asking.join(first, "rule_key", "left").groupBy(*own, "asked").agg(F.min("rule_no").alias("rule_no"), F.count("*").alias("n"))
    copies = met.select(*own, "rule_no", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("n div asked"))).alias("copy"))
    numbered = rules.select(F.col("rule_no").alias("own_no"), F.struct(*rules.columns).alias("rule"))
    return copies.join(numbered, F.col("rule_no") == F.col("own_no"), "left").select(*own, "rule")


def _replace(column: str, hit: Column, values: Sequence[str | None]) -> Column:
    """Value of the matching rule; NULL in the rule or no rule keeps the column."""
    options = F.array(*[F.lit(v).cast("string") for v in values])
    return F.coalesce(F.get(options, hit - 1), F.col(column))


def _from_rules(rows: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Values of the struct `rule` in place of the columns; NULL in the rule keeps a column."""
    return rows.withColumns({c: F.coalesce(F.col(f"rule.{r}"), F.col(c)) for c, r in targets.items()}).drop("rule")


def apply_phone_rules(rows: DataFrame, rules: Sequence[tuple] | DataFrame) -> DataFrame:
    """rules: (pattern, status, date, template, code), or a table of `load_phone_rules`."""
    if isinstance(rules, DataFrame):
        return _from_rules(first_rules(rows, rules, "phone"), {"status": "status", "date": "date", "template": "template", "sub_owner": "code"})
    if not rules:
        return rows
    hit = first_match([matches_pattern(F.col("phone"), r[0]) for r in rules])
    targets = ("status", "date", "template", "sub_owner")
    return (
        rows.withColumn("hit", hit)
        .withColumns({c: _replace(c, F.col("hit"), [r[i] for r in rules]) for i, c in enumerate(targets, start=1)})
        .drop("hit")
    )


def apply_rename_rules(rows: DataFrame, rules: Sequence[tuple] | DataFrame) -> DataFrame:
    """rules: (pattern, code), or a table of `load_rename_rules`. An empty code has not five
    characters and so never matches."""
    if isinstance(rules, DataFrame):
        return _from_rules(first_rules(rows, rules, "sub_owner"), {"sub_owner": "code"})
    if not rules:
        return rows
    hit = first_match([matches_pattern(F.col("sub_owner"), r[0]) for r in rules])
    return rows.withColumn("sub_owner", _replace("sub_owner", hit, [r[1] for r in rules]))


def apply_status_rules(rows: DataFrame, rules: Sequence[tuple] | DataFrame) -> DataFrame:
    """rules: (pattern, status or '*', new status), tested on the code after renaming, or a
    table of `load_status_rules`.

    Every test mentions the code, so the rename expression is settled first.
    """
    if isinstance(rules, DataFrame):
        return _from_rules(first_rules(rows, rules, "sub_owner", "status"), {"status": "new_status"})
    if not rules:
        return rows

    def test(rule: tuple) -> Column:
        hit = matches_pattern(F.col("sub_owner"), rule[0])
        return hit if rule[1].strip() == "*" else hit & (F.trim("status") == rule[1].strip())

    hit = first_match([test(r) for r in rules])
    return settled(rows).withColumn("status", _replace("status", hit, [r[2].strip() for r in rules]))


def apply_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides: unique (phone, code). An empty target is ignored. Spark broadcasts the
    side when it is measured to be small and shuffles both when not."""
    wanted = overrides.where(F.coalesce("code", F.lit("")) != "").select("phone", F.col("code").alias("override"))
    joined = rows.join(wanted, "phone", "left")
    return joined.withColumn("sub_owner", F.coalesce("override", "sub_owner")).drop("override")


def wildcard_rule_join(rows: DataFrame, rules: Sequence[tuple] | DataFrame) -> DataFrame:
    """Number of the first phone pattern that fits each row, NULL if none does."""
    if isinstance(rules, DataFrame):
        return first_rules(rows, rules, "phone").withColumn("rule_no", F.col("rule.rule_no")).drop("rule")
    return rows.withColumn("rule_no", first_match([matches_pattern(F.col("phone"), r[0]) for r in rules]))


def key_space(
    spark: SparkSession, low: int, high: int, segments: Sequence[int] = SEGMENTS
) -> DataFrame:
    """Every phone of every segment with a suffix from low to high, spread over all tasks."""
    span = high - low + 1
    ids = spark.range(span * len(segments))
    codes = F.array(*[F.lit(s) for s in segments])
    segment = F.get(codes, (F.floor(F.col("id") / span)).cast("int"))
    suffix = suffix_text(F.lit(low) + F.col("id") % span)
    return ids.select(F.concat(segment.cast("string"), suffix).alias("phone"))


def gap_fill(rows: DataFrame, low: int, high: int, order: str, segments: Sequence[int] = SEGMENTS) -> DataFrame:
    """All phones of the key space in one table: the given rows, and AVAIL for the rest.

    Of several rows with one phone the first by `order` stays. The copies are reduced before
    the shuffle. Rows outside the key space are dropped.
    """
    fields = ("status", "date", "template", "sub_owner")
    # a row number of one keeps a single row per phone and task before the shuffle
    newest = Window.partitionBy("phone").orderBy(order, *fields)
    first = rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").select("phone", F.struct(*fields).alias("r"))
    filled = key_space(rows.sparkSession, low, high, segments).join(first, "phone", "left")
    found = F.col("r").isNotNull()
    return filled.select(
        "phone",
        F.when(found, F.col("r.status")).otherwise("AVAIL").alias("status"),
        *[F.when(found, F.col(f"r.{c}")).otherwise("").alias(c) for c in fields[1:]],
    )


def adjust_snapshot(
    rows: DataFrame,
    phone_rules: Sequence[tuple] | DataFrame,
    rename_rules: Sequence[tuple] | DataFrame,
    status_rules: Sequence[tuple] | DataFrame,
    overrides: DataFrame,
) -> DataFrame:
    """All four passes in order; the owner is read from the final code.

    Rule tables are few against the rows, so Spark broadcasts what it measures to be small.
    """
    tables = any(isinstance(r, DataFrame) for r in (phone_rules, rename_rules, status_rules))
    out = apply_phone_rules(rows.repartition("phone") if tables else rows, phone_rules)
    out = apply_rename_rules(out, rename_rules)
    out = apply_status_rules(out, status_rules)
    out = apply_overrides(out, overrides)
    owner = F.when(F.length("sub_owner") >= 2, F.substring("sub_owner", 1, 2)).otherwise("")
    return out.withColumn("owner", owner)
