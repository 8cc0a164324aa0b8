"""Raw snapshot text: one key per line, five comma-separated fields.

    800-200-0000  ,WORKING ,26/01/27,49,XXX01
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.constants import SEGMENTS, STATUS_CODES
from rollbook.functions.fence import settled
from rollbook.functions.keys import SUFFIX_DIGITS, status_code


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of many files with the file they come from, all segments in one scan."""
    return spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"))


def _split(lines: DataFrame) -> DataFrame:
    """Fields of each line as column f, split once; all other columns but value are kept."""
    others = [c for c in lines.columns if c != "value"]
    return settled(lines.select(*others, F.split("value", ",").alias("f")))


def _field(i: int) -> Column:
    return F.trim(F.get("f", F.lit(i)))


def parse_snapshot_lines(lines: DataFrame) -> DataFrame:
    """Number, status, date and code of each usable line; other columns are kept.

    Lines with fewer than five fields or without number or code are dropped. The template
    field is not used here.
    """
    others = [c for c in lines.columns if c != "value"]
    rows = _split(lines).where(F.size("f") >= 5).select(
        *others,
        _field(0).alias("number"),
        _field(1).alias("status"),
        _field(2).alias("date"),
        _field(4).alias("code"),
    )
    return rows.where((F.col("number") != "") & (F.col("code") != ""))


def parse_combined_lines(lines: DataFrame, drop_spares: bool) -> DataFrame:
    """The same for files that mix all segments: the segment is read from the number."""
    rows = parse_snapshot_lines(lines)
    digits = F.regexp_replace("number", "-", "")
    rows = rows.withColumn("segment", F.substring(digits, 1, 3)).where(
        F.col("segment").isin([str(s) for s in SEGMENTS])
    )
    if drop_spares:
        rows = rows.where(F.col("status").isin(list(STATUS_CODES)))
    return rows.withColumn("segment", F.col("segment").cast("int"))


def _date_part(i: int) -> Column:
    ok = F.col("date").rlike(r"^\s*\d+\s*/\s*\d+\s*/\s*\d+\s*$")
    return F.when(ok, F.trim(F.get(F.split("date", "/"), F.lit(i))).cast("int")).otherwise(0).cast("short")


def encode_snapshot(rows: DataFrame) -> DataFrame:
    """Typed snapshot: rows whose number is no integer are dropped, an unknown status is 0,
    an unreadable date is 0/0/0. Other columns are kept."""
    used = {"number", "segment", "status", "date", "code"}
    others = [c for c in rows.columns if c not in used]
    key = F.expr("try_cast(replace(number, '-', '') as bigint)")
    typed = rows.select(
        key.alias("key"),
        F.col("segment").cast("int").alias("segment"),
        status_code(F.col("status")).cast("short").alias("status"),
        F.col("code").alias("sub_owner"),
        F.substring("code", 1, 2).alias("owner"),
        _date_part(0).alias("yy"),
        _date_part(1).alias("mm"),
        _date_part(2).alias("dd"),
        *others,
    )
    return typed.where(F.col("key").isNotNull())


def reject_counts(lines: DataFrame) -> DataFrame:
    """Why lines were dropped or encoded with defaults, as one row of counts."""
    size = F.size("f")
    number, code, date = _field(0), _field(4), _field(2)
    short = size < 5
    blank = ~short & ((number == "") | (code == ""))
    usable = ~short & ~blank
    no_int = F.expr("try_cast(replace(trim(get(f, 0)), '-', '') as bigint)").isNull()
    return _split(lines).agg(
        F.count("*").alias("lines"),
        F.count_if(short).alias("too_few_fields"),
        F.count_if(blank).alias("blank_key_or_code"),
        F.count_if(usable & no_int).alias("bad_number"),
        F.count_if(usable & ~no_int & (status_code(_field(1)) == 0)).alias("unknown_status"),
        F.count_if(usable & ~no_int & ~date.rlike(r"^\s*\d+\s*/\s*\d+\s*/\s*\d+\s*$")).alias("bad_date"),
    )


def parse_adjust_line(lines: DataFrame, longest: int | None = SUFFIX_DIGITS) -> DataFrame:
    """Input of the rule cascade: whole keys only, template kept, codes may be empty.

    `longest` is the number of suffix digits the registry has at most, None for any.
    """
    others = [c for c in lines.columns if c != "value"]
    rows = _split(lines).where(F.size("f") >= 5).select(
        *others,
        F.regexp_replace(_field(0), "-", "").alias("phone"),
        _field(1).alias("status"),
        _field(2).alias("date"),
        _field(3).alias("template"),
        _field(4).alias("sub_owner"),
    )
    most = "" if longest is None else 3 + longest
    return rows.where(F.col("phone").rlike(f"^[0-9]{{{3 + SUFFIX_DIGITS},{most}}}$"))


def missing_segments(rows: DataFrame, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """Segments that a period lacks. The collected set has at most as many entries as there
    are segments."""
    every = F.array(*[F.lit(s) for s in segments])
    found = rows.groupBy("period").agg(F.collect_set(F.col("segment").cast("int")).alias("found"))
    missing = F.sort_array(F.array_except(every, "found"))
    return found.select("period", missing.alias("missing"), (F.size(missing) == 0).alias("complete"))
