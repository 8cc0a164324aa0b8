"""Tables and text exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.keys import dashed
from rollbook.sources.lines import missing_segments


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_snapshots(df: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    """One folder per period, rows sorted by key inside.

    Ranges of (period, key) spread a large period over several tasks and give each file a
    narrow span of keys, so that readers can skip row groups.
    """
    keys = ("period", "key")
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    writer = ranged.sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd")
    writer.partitionBy("period").parquet(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, path: str | None = None) -> None:
    """Catalog table bucketed by key: the diff over it needs no shuffle at all.

    The rows are dealt like the buckets first, so each bucket is one file.
    """
    writer = df.repartition(buckets, "key").write.option("compression", "zstd")
    writer = writer.option("path", path) if path else writer
    writer.bucketBy(buckets, "key").sortBy("key", "period").mode("overwrite").saveAsTable(table)


def bucketed_table(spark: SparkSession, table: str) -> DataFrame:
    """The table in a session of its own, where a join by (key, idx) takes the buckets by key as
    they are instead of shuffling both sides by both columns."""
    session = spark.newSession()
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return session.table(table)


def existing_periods(spark: SparkSession, path: str) -> DataFrame:
    """Periods that a table written by write_snapshots holds, none if there is no table yet.
    No column is read but the one in the folder names."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return spark.createDataFrame([], "period string")
        raise
    return held.select(F.col("period").cast("string").alias("period")).distinct()


def drop_partitions(spark: SparkSession, path: str, column: str, values: list[str]) -> None:
    """Removes the partitions of the given values from a table below path, in any store that
    Spark reads. Those that are not there are passed over."""
    jvm = spark.sparkContext._jvm
    for value in values:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{column}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def replace_periods(rows: DataFrame, path: str) -> None:
    """Writes whole periods, in place of what the table holds of them."""
    keys = ("period", "key")
    writer = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("period").parquet(path)


def new_periods_only(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of the periods that are not written yet."""
    return rows.join(F.broadcast(done.select("period").distinct()), "period", "left_anti")


def append_missing(rows: DataFrame, path: str, segments: tuple[int, ...] | None = None) -> None:
    """Idempotent load: periods already present are left alone.

    With `segments`, a period that lacks one of them is refused and can be loaded later. A
    failed load leaves no period half written: whole partitions replace what is there, and
    they appear when the job commits.
    """
    spark = rows.sparkSession
    fresh = new_periods_only(rows, existing_periods(spark, path))
    if segments is not None:
        whole = missing_segments(fresh, segments).where("complete").select("period")
        fresh = fresh.join(F.broadcast(whole), "period", "left_semi")  # a row per period of the calendar
    replace_periods(fresh, path)


def _field(column: str, width: int) -> Column:
    return F.rpad(F.substring(F.coalesce(F.col(column), F.lit("")), 1, width), width, " ")


def fixed_width_lines(adjusted: DataFrame) -> DataFrame:
    """41 characters per key: dashed key, status cut to 7, date 8, template 2, code 5."""
    return adjusted.select(
        F.concat(
            dashed(F.col("phone")),
            F.lit("  ,"),
            _field("status", 7),
            F.lit(" ,"),
            _field("date", 8),
            F.lit(","),
            _field("template", 2),
            F.lit(","),
            _field("sub_owner", 5),
        ).alias("value")
    )


def variable_lines(adjusted: DataFrame) -> DataFrame:
    """Plain comma text, nothing cut; an empty field leaves two commas side by side."""
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("phone", "status", "date", "template", "sub_owner")]
    return adjusted.select(F.concat_ws(",", *cells).alias("value"))


LINE_END = "\r\n"


def write_text(lines: DataFrame, path: str) -> None:
    lines.write.option("lineSep", LINE_END).text(path)


def write_ordered_text(lines: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Lines (key, value) as text files whose names are in the order of the key, and beside them
    a manifest: lines, bytes and first and last line of every file."""
    ranged = lines.repartitionByRange(files, key) if files else lines.repartitionByRange(key)
    ranged.sortWithinPartitions(key, "value").select("value").write.option("lineSep", LINE_END).text(f"{path}/lines")
    _file_counts(lines.sparkSession, path).write.parquet(f"{path}/manifest")


def _file_counts(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", LINE_END).text(f"{path}/lines").select("value", F.col("_metadata.file_name").alias("file"))
    return read.groupBy("file").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("value") + len(LINE_END)).alias("bytes"), F.min("value").alias("least"), F.max("value").alias("greatest")
    )


def read_ordered_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of an export. Files that are missing, cut or not in the manifest are refused."""
    held, told = _file_counts(spark, path), spark.read.parquet(f"{path}/manifest")
    wrong = held.exceptAll(told).union(told.exceptAll(held))
    names = [r["file"] for r in wrong.select("file").distinct().orderBy("file").limit(10).collect()]
    if names:
        raise ValueError(f"files differ from the manifest of {path}: {', '.join(names)}")
    return spark.read.option("lineSep", LINE_END).text(f"{path}/lines").select(F.col("_metadata.file_name").alias("file"), "value")


SUFFIXES = (4, 5, 6)


def with_suffixes(lookup: DataFrame) -> DataFrame:
    """Last four, five and six digits beside the number, for searches by suffix."""
    number = F.col("digit_number")
    return lookup.withColumns({f"last{n}": F.right(number, F.lit(n)) for n in SUFFIXES})


def write_lookup(lookup: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lookup table by month in two layouts. `number` is sorted by the number and has Bloom filters
    on it, for exact searches; `tail` is sorted by the number read backwards, so that all
    numbers with one suffix stand together whatever its length."""
    ready = with_suffixes(lookup).withColumn("tail", F.reverse("digit_number"))
    for layout, column in (("number", "digit_number"), ("tail", "tail")):
        keys = ("scan_month", column)
        writer = ready.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).option("compression", "zstd")
        writer = writer.option("parquet.bloom.filter.enabled#digit_number", str(layout == "number").lower())
        writer.partitionBy("scan_month").parquet(f"{path}/{layout}")


def search_lookup(spark: SparkSession, path: str, month: str, wanted: list[str]) -> DataFrame:
    """Rows of a month whose number is one of `wanted`, or ends in one that has 4 to 6 digits.

    Whole numbers are looked up in one layout, suffixes in the other; the month prunes
    partitions, and numbers and suffixes reach the scan as filters on the sorted column.
    """
    numbers = [w for w in wanted if len(w) > max(SUFFIXES)]
    tails = sorted({w[::-1] for w in wanted if len(w) in SUFFIXES})

    def layout(name: str) -> DataFrame:
        held = spark.read.parquet(f"{path}/{name}")
        return held.withColumn("scan_month", F.col("scan_month").cast("string")).where(F.col("scan_month") == month)

    ends = F.lit(False)
    for tail in tails:
        ends = ends | F.col("tail").startswith(tail)
    exact = layout("number").where(F.col("digit_number").isin(numbers))
    return exact.unionByName(layout("tail").where(ends & ~F.col("digit_number").isin(numbers))).drop("tail")
