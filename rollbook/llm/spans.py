"""Spans of regular expressions in texts, by DataFrame functions only.

A span is (s, e, v): start and end in code points, end exclusive, and the matched string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string>>"
NONE = f"cast(array() as {SPAN})"


def find(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of a pattern that never matches the empty string.

    What stands between the matches is a split by the same pattern, so the positions are
    running sums over lengths, whatever the matches look like.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), lambda v, gap: F.struct(v.alias("v"), F.length(gap).alias("gap")))

    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + F.length(part["v"])
        span = F.struct(start.alias("s"), end.alias("e"), part["v"].alias("v"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.expr(NONE).alias("out"))
    spans = F.aggregate(parts, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(NONE))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind and its place in the order of kinds, ready to be sorted."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def spelled(tagged_spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(tagged_spans), lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def count(tagged_spans: Column, kind: str) -> Column:
    return F.size(F.filter(tagged_spans, lambda x: x["kind"] == kind)).cast("long")
