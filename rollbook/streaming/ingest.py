"""Incremental load of snapshot files with Structured Streaming.

The file source remembers in its checkpoint which files it has read and the file sink lists
in its log which files are complete, so that a month is loaded once even if a run fails and
is started again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rollbook.sources.files import file_name, month_tag, segment_from_name
from rollbook.sources.lines import encode_snapshot, parse_snapshot_lines


def snapshot_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Typed rows of per-segment text files below folder; month and segment from the path."""
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    named = lines.select(
        "value", month_tag(F.col("path")).alias("period"), segment_from_name(file_name(F.col("path"))).alias("segment")
    )
    return encode_snapshot(parse_snapshot_lines(named.where(F.col("segment").isNotNull() & (F.col("period") != ""))))


def load_new_files(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Load everything that is new, then stop. target and checkpoint lie in shared storage."""
    return (
        snapshot_stream(spark, folder)
        .writeStream.format("parquet")
        .partitionBy("period")
        .option("path", target)
        .option("compression", "zstd")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
