"""Keys of ten and of more digits in one table: the longer one is the larger one."""

import os

import pytest
from pyspark.sql import functions as F

from rollbook.operators import rules
from rollbook.plans import QUERIES
from rollbook.sources import rule_files

SF = "/root/testdata/sf0.001"


def numbered(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, value string")


@pytest.mark.parametrize("block", [1, 3, 100])
def test_override_verdicts(spark, block):
    texts = ["8889999987,AB001", "88810000013,AB002", "8889999999,AB003", "88810000013,AB004", "88810000014,AB005", "80010000000,AB006", "888100000000,AB007"]
    got = rule_files.judge_overrides(numbered(spark, *texts), block).orderBy("line_no").collect()
    assert [r.verdict for r in got] == ["kept", "kept", "sequence", "duplicate", "kept", "sequence", "kept"]
    assert {r.code for r in rule_files.load_overrides(numbered(spark, *texts)).collect()} == {"AB001", "AB002", "AB005", "AB007"}


def test_phone_rules(spark):
    text = numbered(spark, "800-444-****,UNAVAIL,*,*,*", "800-444-*****,RESERVED,*,*,*", "800-44,X,*,*,*")
    loaded = rule_files.load_phone_rules(text)
    rows = spark.createDataFrame([("8004441234", "", "", "", ""), ("80044412345", "", "", "", "")], "phone string, status string, date string, template string, sub_owner string")
    got = {r.phone: r.status for r in rules.apply_phone_rules(rows, loaded).collect()}
    assert got == {"8004441234": "UNAVAIL", "80044412345": "RESERVED"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_adjust_from_files(spark, tmp_path, monkeypatch):
    """Suffixes on both sides of ten million; only the key space around them is filled."""
    import rollbook.plans.base as base

    top = spark.read.parquet(f"{SF}/part.parquet").agg(F.max("p_partkey")).first()[0]
    low = 10_000_000 - top // 2
    for name in os.listdir(SF):
        df = spark.read.parquet(f"{SF}/{name}")
        for column in ("p_partkey", "l_partkey"):
            if column in df.columns:
                df = df.withColumn(column, (F.col(column) + low).cast(df.schema[column].dataType))
        df.write.parquet(f"{tmp_path}/{name}")

    def around(rows, _, high, order, fill=rules.gap_fill):
        return fill(rows, low, high, order)

    monkeypatch.setattr(rules, "gap_fill", around)
    monkeypatch.setattr(base, "gap_fill", around)
    wanted = sorted(map(tuple, QUERIES["adjust_snapshot"](spark, str(tmp_path)).collect()))
    assert {len(r[0]) for r in wanted if r[4].startswith("OV")} == {10, 11}
    assert sorted(map(tuple, QUERIES["adjust_from_files"](spark, str(tmp_path)).collect())) == wanted
