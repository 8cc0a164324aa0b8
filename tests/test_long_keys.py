"""Keys beyond ten digits: nothing is cut, and queries agree with their SQL twins."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from rollbook.functions import keys  # noqa: E402
from rollbook.operators.rules import gap_fill  # noqa: E402
from rollbook.plans import ORACLE, QUERIES  # noqa: E402
from rollbook.plans.base import adjust_input  # noqa: E402

SF = "/root/testdata/sf0.001"
SHIFT = 20_000_000
NAMES = ("key_split", "normalize_key", "key_status_card", "parse_snapshot_lines", "encode_snapshot", "parse_adjust_line", "rule_individual", "rule_phone_pattern")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def moved(spark, tmp_path_factory):
    """The smallest data with every part key moved up."""
    out = str(tmp_path_factory.mktemp("moved"))
    for name in check.TABLES:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        for column in ("p_partkey", "l_partkey"):
            if column in df.columns:
                df = df.withColumn(column, (F.col(column) + SHIFT).cast(df.schema[column].dataType))
        df.write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, moved, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{moved}/{t}.parquet/*.parquet')")
    error, _ = check.compare(QUERIES[name](spark, moved), con.sql(ORACLE[name]))
    assert error is None, error


def test_gap_fill_beyond_ten_digits(spark, moved):
    rows = adjust_input(spark, moved)
    wanted = {r.phone for r in rows.collect() if not r.phone.startswith("212")}
    filled = gap_fill(rows, SHIFT, SHIFT + 300, "key").collect()
    assert len(filled) == 7 * 301 and wanted == {r.phone for r in filled if r.status != "AVAIL"}
    assert all(len(p) == 11 for p in wanted)


def test_no_key_is_cut(spark):
    df = spark.createDataFrame([(80020000001,), (8002000001,), (7,)], "n long")
    got = df.select(keys.suffix_of(F.col("n")).alias("s"), keys.segment_of(F.col("n")).alias("g"), keys.dashed(F.col("n")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("20000001", 800, "800-200-00001"), ("2000001", 800, "800-200-0001"), ("0000007", 0, "000-000-0007")]
