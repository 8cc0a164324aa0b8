"""Rule files of the adjustment cascade, as numbered text lines (line_no, value).

`<>` starts a comment and a line FILE END stops the file. In replacement fields '*' keeps
the value (NULL here), an empty field clears it, anything else replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = 100_000


def read_rule_file(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of one file, or of several in the order of their names.

    Files of any size are read in splits; a line's number is its place in its split plus the
    lines of the splits before, of which there is one row each.
    """
    meta = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("file", "start").orderBy("at")
    numbered = lines.withColumn("nth", F.row_number().over(inside)).join(offsets, ["file", "start"])
    return numbered.select((F.col("offset") + F.col("nth") - 1).alias("line_no"), "value")


def _body(lines: DataFrame) -> DataFrame:
    """Lines before FILE END without comments and blanks."""
    bare = lines.withColumn("value", F.regexp_replace("value", "<>.*$", ""))
    ends = bare.where(F.trim("value") == "FILE END").agg(F.min("line_no").alias("last"))
    stop = F.coalesce(ends.scalar(), F.lit(2**62))
    return bare.where((F.trim("value") != "") & (F.col("line_no") < stop))


def _parts() -> Column:
    return F.split("value", ",")


def _part(i: int) -> Column:
    return F.trim(F.get(_parts(), F.lit(i)))


def _replacement(i: int) -> Column:
    return F.when(_part(i) != "*", _part(i))


def load_phone_rules(lines: DataFrame) -> DataFrame:
    """(rule_no, pattern, status, date, template, code). A pattern has ten characters or more, as keys have."""
    rows = _body(lines).where(F.size(_parts()) >= 5)
    rules = rows.select(
        F.col("line_no").alias("rule_no"),
        F.regexp_replace(_part(0), "-", "").alias("pattern"),
        _replacement(1).alias("status"),
        _replacement(2).alias("date"),
        _replacement(3).alias("template"),
        _replacement(4).alias("code"),
    )
    return rules.where(F.length("pattern") >= 10)


def load_rename_rules(lines: DataFrame) -> DataFrame:
    """(rule_no, pattern, code)."""
    rows = _body(lines).where(F.size(_parts()) >= 2)
    rules = rows.select(F.col("line_no").alias("rule_no"), _part(0).alias("pattern"), _part(1).alias("code"))
    return rules.where((F.length("pattern") == 5) & (F.length("code") == 5))


def load_status_rules(lines: DataFrame) -> DataFrame:
    """(rule_no, pattern, status, new_status)."""
    rows = _body(lines).where(F.size(_parts()) >= 3)
    rules = rows.select(
        F.col("line_no").alias("rule_no"),
        _part(0).alias("pattern"),
        _part(1).alias("status"),
        _part(2).alias("new_status"),
    )
    return rules.where(F.length("pattern") == 5)


def judge_overrides(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every non-blank line of an override file with a verdict: kept, bad, duplicate, sequence.

    A phone below the largest phone kept so far is out of sequence, and one already kept is
    a duplicate; both follow from the running maximum over the valid lines above. Of
    phones of several lengths the longer one is the larger, as with numbers. The maximum is
    formed per block of lines and over the few block maxima, so no task sees the whole file.
    """
    body = F.trim("value")
    bare = lines.where(body != "").withColumn("value", body)
    phone, code = _part(0), _part(1)
    bad = (
        (F.size(_parts()) < 2)
        | (F.length(phone) < 10)
        | ~phone.rlike(r"^[0-9]+$")
        | (F.length(F.coalesce(code, F.lit(""))) != 5)
    )
    rows = bare.select(
        "line_no",
        (F.col("line_no") / block).cast("long").alias("block"),
        phone.alias("phone"),
        code.alias("code"),
        F.coalesce(bad, F.lit(True)).alias("bad"),
    )
    place = F.struct(F.length("phone"), "phone")
    valid = F.when(~F.col("bad"), place)
    per_block = rows.groupBy("block").agg(F.max(valid).alias("block_max"))
    above = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select("block", F.max("block_max").over(above).alias("carried"))
    inside = Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    running = F.greatest(F.max(valid).over(inside), F.col("carried"))
    judged = rows.join(carried, "block").withColumn("running", running)
    # a phone equal to the running maximum is already kept; a lower one is a duplicate only if
    # the same phone was kept before, which is so when it was the maximum on its first line
    first = judged.where(~F.col("bad")).groupBy("phone").agg(
        F.min("line_no").alias("first_line"), F.min_by("running", "line_no").alias("first_running")
    )
    was_kept = F.col("first_running").isNull() | (place >= F.col("first_running"))
    joined = judged.join(first, "phone", "left")
    later = F.col("line_no") > F.col("first_line")
    verdict = (
        F.when(F.col("bad"), "bad")
        .when(later & was_kept, "duplicate")
        .when(place < F.col("running"), "sequence")
        .otherwise("kept")
    )
    return joined.select("line_no", "phone", "code", verdict.alias("verdict"))


def load_overrides(lines: DataFrame) -> DataFrame:
    """(phone, code) of the kept lines."""
    return judge_overrides(lines).where(F.col("verdict") == "kept").select("phone", "code")
