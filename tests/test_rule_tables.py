"""Rule tables of many masks against a plain search, and the plan of the cascade."""

import contextlib
import io
import random

from pyspark.sql import functions as F

from rollbook.operators import rules


def fits(pattern, text):
    return len(pattern) == len(text) and all(p in ("*", t) for p, t in zip(pattern, text, strict=True))


def many(rng, count, masks, length, letters):
    shapes = set()
    while len(shapes) < masks:
        shapes.add(tuple(rng.random() < 0.6 for _ in range(length)))
    shapes = sorted(shapes)
    return [(i, "".join(rng.choice(letters) if fixed else "*" for fixed in rng.choice(shapes))) for i in rng.sample(range(10**6), count)]


def test_many_rules_and_masks(spark):
    rng = random.Random(8)
    table = many(rng, 20_000, 200, 10, "01")
    phones = ["".join(rng.choice("012") for _ in range(rng.choice((10, 10, 10, 9, 11)))) for _ in range(150)]
    phones += phones[:20] + [None, ""]  # repeated rows stay repeated
    rows = spark.createDataFrame([(p,) for p in phones], "phone string")
    got = rules.wildcard_rule_join(rows, spark.createDataFrame(table, "rule_no long, pattern string")).collect()
    want = [(p, min((i for i, x in table if p and fits(x, p)), default=None)) for p in phones]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(n for _, n in want) and any(n is None for _, n in want)


def test_tables_are_the_same_as_tuples(spark, tmp_path):
    rng = random.Random(9)
    codes = ["".join(rng.choice("AB1") for _ in range(5)) for _ in range(30)]
    phones = ["80" + "".join(rng.choice("01") for _ in range(8)) for _ in range(200)]
    rows = spark.createDataFrame([(p, rng.choice(["WORKING", " SPARE "]), "d", "t", rng.choice(codes)) for p in phones], "phone string, status string, date string, template string, sub_owner string")
    phone = [(f"80{x}", rng.choice([None, "NEW"]), None, "", rng.choice([None, "AB1AB"])) for _, x in many(rng, 60, 12, 8, "01")]
    rename = [(x, rng.choice(codes)) for _, x in many(rng, 40, 8, 5, "AB1")]
    status = [(x, rng.choice(["*", "SPARE", "NEW"]), "DONE") for _, x in many(rng, 40, 8, 5, "AB1")]
    exact = spark.createDataFrame([(phones[0], "EXACT"), (phones[1], "")], "phone string, code string")

    def numbered(data, names):
        schema = "rule_no long, " + ", ".join(f"{n} string" for n in names.split())
        return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], schema)

    tables = numbered(phone, "pattern status date template code"), numbered(rename, "pattern code"), numbered(status, "pattern status new_status")
    by_tuples = rules.adjust_snapshot(rows, phone, rename, status, exact)
    by_tables = rules.adjust_snapshot(rows, *tables, exact).select(*by_tuples.columns)
    assert sorted(map(tuple, by_tables.collect())) == sorted(map(tuple, by_tuples.collect()))
    assert by_tables.where(F.col("status") == "DONE").count() > 0

    def kept(df, name):  # of a table in files Spark knows the size
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    again = rules.adjust_snapshot(kept(rows, "rows"), *[kept(t, f"t{i}") for i, t in enumerate(tables)], kept(exact, "exact"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        again.explain("formatted")
    tree = out.getvalue().split("\n(1) ")[0]
    # one for the rows and one for the keys of each rule table
    assert tree.count("Exchange (") - tree.count("BroadcastExchange (") == 4, tree
    assert "Window" not in tree and tree.count("Scan parquet") == 8
