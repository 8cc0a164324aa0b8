"""External dictionary tables, read only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DICTIONARY_SCHEMA = (
    "digits string, word string, category string, label string, score double, word_rank long"
)
COLUMNS = tuple(c.split()[0] for c in DICTIONARY_SCHEMA.split(", "))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary in Parquet files, with the declared types."""
    return spark.read.schema(DICTIONARY_SCHEMA).parquet(path)


def read_dictionary_jdbc(spark: SparkSession, url: str, table: str, parts: int = 16, **options: str) -> DataFrame:
    """Dictionary in a relational table, read in parallel over the range of its patterns.

    The driver class must be on the class path. Names of the columns are those of
    DICTIONARY_SCHEMA; patterns have seven digits, so the ranges are cut at equal steps.
    """
    step = 10_000_000 // parts
    cuts = [f"{i * step:07d}" for i in range(1, parts)]
    ranges = [f"digits < '{cuts[0]}' OR digits IS NULL"]
    ranges += [f"digits >= '{a}' AND digits < '{b}'" for a, b in zip(cuts, cuts[1:], strict=False)]
    ranges.append(f"digits >= '{cuts[-1]}'")
    frame = spark.read.jdbc(url, table, predicates=ranges, properties=dict(options))
    return frame.select(*[F.col(c) for c in COLUMNS])
