"""Dictionary matches, ages, shared addresses, stubs and the streaming load."""

import os

from pyspark.sql import functions as F

from rollbook.operators import contacts, dictionary, directory, rollup
from rollbook.sources import sinks
from rollbook.streaming.ingest import load_new_files

DICT = "digits string, word string, category string, label string, score double, word_rank long"


def test_median_rounds_half_to_even(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", None), ("d", 60), ("d", 0), ("d", 59)]
    got = {r["owner"]: r for r in dictionary.age_buckets(spark.createDataFrame(rows, "owner string, age_months int")).collect()}
    assert [got[o]["median_age_months"] for o in "abcd"] == [2, 2, None, 59]
    assert (got["d"]["b_under_1m"], got["d"]["b_2_5y"], got["d"]["b_5y_plus"]) == (1, 1, 1)
    assert got["c"]["b_under_1m"] == 0


def test_match_rates(spark):
    words = spark.createDataFrame([("2000000", "AAA", "c", "C", 1.0, 1), ("2000000", "BBB", None, None, None, None)], DICT)
    keys = spark.createDataFrame([("x", "2000000"), ("x", "2000001")], "owner string, digits string")
    assert dictionary.match_rate(keys, words).first()["match_rate"] == 0.5
    literal = dictionary.match_rate_per_word(keys, words).first()
    assert (literal["working_count"], literal["match_count"]) == (3, 2)


def test_top_words_and_best_word(spark):
    words = spark.createDataFrame(
        [("1", "LOW", "c", "C", 1.0, 5), ("1", "HIGH", "d", "D", 9.0, 1), ("2", "NONE", None, None, None, None), ("2", "NOTHING", None, None, 0.0, 3)], DICT
    )
    best = {r["digits"]: r["word"] for r in dictionary.best_word(words).collect()}
    assert best == {"1": "HIGH", "2": "NOTHING"}
    keys = spark.createDataFrame([("x", "1", 8000000001, 800), ("x", "1", 8330000001, 833)], "owner string, digits string, key long, segment int")
    top = dictionary.top_words(dictionary.matches(keys, words), 2).collect()
    every = [(r["key"], r["word"]) for r in sorted((r for r in top if r["category"] is None), key=lambda r: r["ord"])]
    assert every == [(8000000001, "HIGH"), (8330000001, "HIGH")]
    assert len(top) == 6


def test_notable(spark):
    rows = [(800, "W", 5000, 0.0, True), (800, "W", None, 0.0, False), (833, "W", 1, 999.0, False), (833, "W", None, 1000.0, True), (800, None, 1, 5000.0, False)]
    df = spark.createDataFrame(rows, "s int, w string, r int, c double, want boolean")
    assert df.where(dictionary.notable(F.col("s"), F.col("w"), F.col("r"), F.col("c")) != F.col("want")).count() == 0


def test_vendor_codes(spark):
    manifest = spark.createDataFrame([("9ABCDE",), ("AB001",), ("X",)], "vendor_code string")
    assert {tuple(r) for r in dictionary.vendor_codes(manifest).collect()} == {("9ABCD", "9ABCDE"), ("AB001", "AB001")}


def test_shared_address_of_a_hot_address(spark):
    address = {"street1": " 1 Main  St.", "city": "X", "state": "TX"}
    docs = [(i, f"A{i % 4}001", f"org-{i}", address) for i in range(400)] + [(900, "ZZ001", "org-900", {"street1": None, "city": "X", "state": "TX"})]
    df = spark.createDataFrame(docs, "doc_no long, code string, _id string, address struct<street1: string, city: string, state: string>")
    found = contacts.shared_address(df)
    assert found.count() == 400
    first = found.where("doc_no = 0").first()
    assert (first["n_owners"], first["confidence"], first["peers"], first["address_key"]) == (4, "high", ["A1", "A2", "A3"], "1 main st|x|tx")
    flags = contacts.flag_dedupe(contacts.mailbox_flags(df))
    assert flags.count() == 4


def test_stub_slugs(spark):
    rows = [("AB", "AB101", "Acme", "1", "X", "Texas", "USA", ""), ("CD", "CD101", "Acme", "1", "X", "ON", "Canada", ""),
            ("EF", "EF101", "", "", "", "", "", ""), ("GH", "GH101", "Taken", "", "", "", "", ""), ("GH", "GH001", "Taken", "", "", "", "", "")]
    people = spark.createDataFrame(rows, "owner string, code string, company_name string, street string, city string, state string, country string, zip string")
    docs = spark.createDataFrame([("ZZ101", ("taken",))], "code string, slug struct<current: string>")
    got = {r["owner"]: r for r in directory.stub_owners(people, docs, {"Texas": "TX"}).collect()}
    assert {o: r["slug"] for o, r in got.items()} == {"AB": "acme", "CD": "acme-cd", "EF": "unknown-ef", "GH": "taken-gh"}
    assert (got["AB"]["state"], got["CD"]["state"], got["CD"]["country"], got["EF"]["country"], got["GH"]["code"]) == ("TX", "ON", "Canada", "United States", "GH001")


def test_public_membership_skips_the_document_only(spark):
    cats = spark.createDataFrame([("c1", "one", "One"), ("h", "hidden", "Hidden")], "id string, slug string, title string")
    docs = spark.createDataFrame(
        [(1, "AB1", [{"_ref": "c1"}, {"_ref": "h"}]), (2, "AB2", [{"_ref": "c1"}]), (3, "1AB", [{"_ref": "c1"}]), (4, "CD1", [{"_ref": "h"}, {"_ref": "gone"}])],
        "doc_no long, code string, categories array<struct<_ref: string>>",
    )
    assert [tuple(r) for r in directory.public_membership(docs, cats, cats, "categories", hidden_slugs=("hidden",)).collect()] == [("AB", "one", "One")]
    assert {r[0] for r in directory.hidden_owners(docs, cats, ["QQ"], hidden_slugs=("hidden",)).collect()} == {"AB", "1A", "CD", "QQ"}


def test_streaming_load_reads_each_file_once(spark, tmp_path):
    def put(month, segment, *numbers):
        folder = tmp_path / "in" / month
        folder.mkdir(parents=True, exist_ok=True)
        text = "".join(f"{n}  ,WORKING ,26/01/27,49,XXX01\n" for n in numbers)
        (folder / f"Number-Status-NPA-{segment}.txt").write_text(text)

    paths = [str(tmp_path / p) for p in ("in", "out", "checkpoint")]
    put("2025-01", 800, "800-200-0000", "800-200-0001")
    load_new_files(spark, *paths).awaitTermination()
    put("2025-02", 833, "833-200-0000")
    load_new_files(spark, *paths).awaitTermination()
    load_new_files(spark, *paths).awaitTermination()
    got = spark.read.parquet(paths[1]).groupBy("period", "segment").count().orderBy("period").collect()
    assert [tuple(r) for r in got] == [("2025-01", 800, 2), ("2025-02", 833, 1)]
    assert os.path.isdir(os.path.join(paths[1], "period=2025-01"))


def test_hot_key_and_hot_owner_stay_exact(spark):
    """A third of all lines belongs to one key, and a third of all keys to one owner."""
    from pyspark.sql import Window

    lines = spark.range(90_000).selectExpr("if(id % 3 = 0, 0, id) as key", "id as t", "id % 7 as v")
    w = Window.partitionBy("key").orderBy(F.desc("t"))
    newest = lines.withColumn("n", F.row_number().over(w)).where("n = 1")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the shuffle
    assert newest.count() == 60_001
    assert newest.where("key = 0").first()["t"] == 89_997

    keys = spark.range(9000).selectExpr(
        "if(id % 3 = 0, 'AA', concat('B', id % 9)) as owner", "lpad(id, 7, '0') as digits", "id as key", "800 as segment"
    )
    words = keys.selectExpr("digits", "concat('W', digits) as word", "'c' as category", "'C' as label", "cast(key as double) as score", "1L as word_rank")
    top = dictionary.top_hits(dictionary.matches(keys, words), 5)
    best = [r["key"] for r in top.where("owner = 'AA'").orderBy("ord").collect()]
    assert best == [8997, 8994, 8991, 8988, 8985]


def test_further_hidden_slugs(spark):
    cats = spark.createDataFrame([("c1", "one", "One"), ("n", "no-owner", "None")], "id string, slug string, title string")
    docs = spark.createDataFrame([(1, "AB1", [{"_ref": "n"}, {"_ref": "c1"}])], "doc_no long, code string, categories array<struct<_ref: string>>")
    assert directory.hidden_owners(docs, cats, hidden_slugs=("hidden",)).count() == 0
    assert directory.hidden_owners(docs, cats, hidden_slugs=("hidden", "no-owner")).count() == 1
    assert directory.public_membership(docs, cats, cats, "categories", hidden_slugs=("no-owner",)).count() == 0
    assert directory.unknown_and_real(docs, cats, ("one", "no-owner")).count() == 0


def test_newest_period_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = [(n, f"2020-0{n % 3 + 1}") for n in range(9)]
    spark.createDataFrame(rows, "key long, period string").write.partitionBy("period").parquet(path)
    newest = rollup.latest_snapshot(spark.read.parquet(path))
    assert sorted(r.key for r in newest.collect()) == [2, 5, 8]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "PartitionFilters" in line]
    assert any("(period" in f.split("PartitionFilters")[1].split("PushedFilters")[0] and "subquery" in f for f in filters)


def test_loads_refuse_incomplete_periods(spark, tmp_path):
    path = str(tmp_path / "loads")
    segments = (800, 833)
    rows = spark.createDataFrame([(n, p, s) for n in range(3) for p in ("2020-01", "2020-02") for s in segments], "key long, period string, segment int")
    half = rows.where("not (period = '2020-02' and segment = 833)")
    for load, want in ((half, {"2020-01": 6}), (half, {"2020-01": 6}), (rows, {"2020-01": 6, "2020-02": 6}), (rows, {"2020-01": 6, "2020-02": 6})):
        sinks.append_missing(load, path, segments)
        assert {r.period: r["count"] for r in spark.read.parquet(path).groupBy("period").count().collect()} == want
