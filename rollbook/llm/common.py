"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import string
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SPACE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation counts as space."""
    return (text or "").lower().encode("utf-8").translate(_SPACE).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in a folder that the driver and all executors share.

    That is `spark.checkpoint.dir`; a session without it (tests) uses its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a written table, which survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: rows with one text share all work on it."""
    return [F.xxhash64(F.lit("a"), text).alias("k1"), F.xxhash64(F.lit("b"), text).alias("k2")]


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver has it, if it was not installed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def arrow_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """mapInArrow with state made once in each task: `make()` returns what turns batch into batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            out = each(batch)
            if out is not None and out.num_rows:
                yield out

    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Numbers that a key filter tells apart: 2^25 bits are 1,024 rows of 4 kB, whatever the number of keys.
FILTER = 1 << 25


def _filter_place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER)) + 1


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the hashed keys. Its size is fixed; the more keys, the less it keeps out."""
    place = _filter_place(F.col(key))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits")
    return keys.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(bits)


def with_hits(rows: DataFrame, key: str, filter_: DataFrame, name: str) -> DataFrame:
    """Adds whether the filter may hold the key: always for keys it was made of, seldom for
    others. So only such rows need to be shuffled to be joined with the keys."""
    place = _filter_place(F.col(key))
    position = F.bitmap_bit_position(place)
    byte = F.expr("substring(__bits, cast(__position div 8 as int) + 1, 1)")
    bit = F.expr("shiftright(cast(conv(hex(__byte), 16, 10) as int), cast(__position % 8 as int)) & 1")
    joined = rows.withColumns({"__bucket": F.bitmap_bucket_number(place), "__position": position}).join(F.broadcast(filter_), "__bucket", "left")
    hit = F.coalesce(bit == 1, F.lit(False))
    return joined.withColumn("__byte", byte).withColumn(name, hit).drop("__bucket", "__bits", "__position", "__byte")
