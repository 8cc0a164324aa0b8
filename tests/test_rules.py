"""Rule cascade, rule files, gap fill, exports, validation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rollbook.operators import rules, validate
from rollbook.sources import lines, rule_files, sinks

ROWS = "phone string, status string, date string, template string, sub_owner string, line_no long"


def make(spark, *data):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], ROWS)


def numbered(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, value string")


def test_phone_rules_keep_clear_replace_first_match(spark):
    rows = make(spark, ("8004441111", "WORKING", "25/01/01", "43", "AB001"), ("8004451111", "WORKING", "25/01/01", "43", "AB001"))
    out = rules.apply_phone_rules(
        rows, [("80044*****", "UNAVAIL", None, "", "ZZ999"), ("800445****", "RESERVED", None, None, None)]
    )
    got = {r["phone"]: tuple(r)[1:5] for r in out.select("phone", "status", "date", "template", "sub_owner").collect()}
    assert got["8004441111"] == ("UNAVAIL", "25/01/01", "", "ZZ999")
    assert got["8004451111"] == ("UNAVAIL", "25/01/01", "", "ZZ999")


def test_status_rule_sees_the_renamed_code(spark):
    rows = make(spark, ("8002000000", "WORKING", "", "", "QR002"), ("8002000001", "WORKING", "", "", ""))
    out = rules.apply_status_rules(rules.apply_rename_rules(rows, [("QR***", "MN001")]), [("MN0*1", "WORKING", " SUSPEND ")])
    assert [(r["status"], r["sub_owner"]) for r in out.orderBy("phone").collect()] == [("SUSPEND", "MN001"), ("WORKING", "")]


def test_cascade_order_and_owner(spark):
    rows = make(spark, ("8002000000", "WORKING", "", "", "AA001"), ("8002000001", "WORKING", "", "", "AA001"), ("8002000002", "AVAIL", "", "", ""))
    over = spark.createDataFrame([("8002000000", "XX001"), ("8002000001", "")], "phone string, code string")
    out = rules.adjust_snapshot(rows, [], [("AA***", "BB001")], [("XX***", "*", "SUSPEND")], over)
    got = [(r["status"], r["sub_owner"], r["owner"]) for r in out.orderBy("phone").collect()]
    # the override comes last, so the status rule on its code never fires
    assert got == [("WORKING", "XX001", "XX"), ("WORKING", "BB001", "BB"), ("AVAIL", "", "")]


def test_gap_fill(spark):
    rows = make(
        spark,
        ("8000000003", "WORKING", "d", "1", "A"), ("8000000004", "TRANSIT", "d", "1", "first"),
        ("8000000004", "WORKING", "d", "1", "second"), ("8000000009", "DISCONN", "d", "1", "C"), ("8000000099", "DISCONN", "", "", ""),
    )
    out = rules.gap_fill(rows, 0, 9, "line_no", segments=(800,)).collect()
    assert len(out) == 10
    assert sum(r["status"] == "AVAIL" for r in out) == 7
    assert {r["sub_owner"] for r in out if r["phone"] == "8000000004"} == {"first"}
    wide = rules.key_space(spark, 2000000, 2000009)
    assert wide.count() == 70
    assert wide.agg(F.min("phone"), F.max("phone")).first()[:] == ("8002000000", "8882000009")


def test_rule_files(spark):
    text = numbered(
        spark, "<> head", "800-444-****,UNAVAIL,*,,*      <> why", "800-44,*,*,*,*", "", "8*0*******,*,*,*,AB001", "FILE END", "8004441111,X,*,*,*"
    )
    got = [tuple(r) for r in rule_files.load_phone_rules(text).orderBy("rule_no").collect()]
    assert got == [(1, "800444****", "UNAVAIL", None, "", None), (4, "8*0*******", None, None, None, "AB001")]
    names = numbered(spark, "QRS02,MNO01", "QRS0,MNO01", "A***1 , B0001 <> x")
    assert [tuple(r)[1:] for r in rule_files.load_rename_rules(names).orderBy("rule_no").collect()] == [("QRS02", "MNO01"), ("A***1", "B0001")]
    states = numbered(spark, "QRS02,WORKING,SUSPEND", "QRS02,*      ,UNAVAIL")
    assert [tuple(r)[2:] for r in rule_files.load_status_rules(states).orderBy("rule_no").collect()] == [("WORKING", "SUSPEND"), ("*", "UNAVAIL")]
    assert [tuple(r)[1:] for r in rule_files.load_rename_rules(names).orderBy("rule_no").collect()] == [("QRS02", "MNO01"), ("A***1", "B0001")]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_override_verdicts(spark, block):
    texts = [
        "8000000005,AB001", "8000000003,AB001", "8000000005,AB002", "8000000007,AB003", "8000000003,AB009",
        "800000000,AB001", "8000000009,ABC", "80000000X9,AB001", "8000000010", "8000000011,AB004", "8000000007,AB003", "  ",
    ]
    got = [r["verdict"] for r in rule_files.judge_overrides(numbered(spark, *texts), block).orderBy("line_no").collect()]
    assert got == ["kept", "sequence", "duplicate", "kept", "sequence", "bad", "bad", "bad", "bad", "kept", "duplicate"]


def test_parse_lines(spark):
    data = ["800-200-0000  ,WORKING ,26/01/27,49,XXX01", "800-200-0001,WORKING,26/01/27,49", "800-200-0002,ODD,x,1,YY001,more",
            "800-2X0-0003,WORKING,26/01/27,49,XXX01", ",WORKING,26/01/27,49,XXX01", "2125551212,WORKING,26/01/27,49,XXX01", "8002000004,SPARE,,,"]
    text = spark.createDataFrame([(v, 800) for v in data], "value string, segment int")
    typed = lines.encode_snapshot(lines.parse_snapshot_lines(text))
    got = {r["key"]: (r["status"], r["owner"], r["yy"], r["mm"], r["dd"]) for r in typed.collect()}
    assert got == {8002000000: (1, "XX", 26, 1, 27), 8002000002: (0, "YY", 0, 0, 0), 2125551212: (1, "XX", 26, 1, 27)}
    mixed = lines.parse_combined_lines(text.drop("segment"), drop_spares=True)
    assert sorted(r["number"] for r in mixed.collect()) == ["800-200-0000", "800-2X0-0003"]
    adjust = {r["phone"]: r["template"] for r in lines.parse_adjust_line(text).collect()}
    assert adjust == {"8002000000": "49", "8002000002": "1", "2125551212": "49", "8002000004": ""}
    counts = lines.reject_counts(text).first().asDict()
    assert counts == {"lines": 7, "too_few_fields": 1, "blank_key_or_code": 2, "bad_number": 1, "unknown_status": 1, "bad_date": 1}


def test_exports(spark):
    rows = make(spark, ("8002000000", "RESERVED", "26/01/27", "49", "XXX01"), ("8002000001", "AVAIL", "", "", ""))
    fixed = [r[0] for r in sinks.fixed_width_lines(rows).collect()]
    assert fixed == ["800-200-0000  ,RESERVE ,26/01/27,49,XXX01", "800-200-0001  ,AVAIL   ,        ,  ,     "]
    assert {len(x) for x in fixed} == {41}
    assert [r[0] for r in sinks.variable_lines(rows).collect()] == ["8002000000,RESERVED,26/01/27,49,XXX01", "8002000001,AVAIL,,,"]


def test_text_sink_and_snapshot_sink(spark, tmp_path):
    rows = make(spark, ("8002000000", "RESERVED", "26/01/27", "49", "XXX01"))
    sinks.write_text(sinks.variable_lines(rows), str(tmp_path / "txt"))
    parts = [p.read_bytes() for p in (tmp_path / "txt").iterdir() if p.name.startswith("part")]
    assert b"".join(parts) == b"8002000000,RESERVED,26/01/27,49,XXX01\r\n"
    snap = spark.createDataFrame([(1, "2025-01"), (2, "2025-02")], "key long, period string")
    sinks.write_snapshots(snap.where("period = '2025-01'"), str(tmp_path / "snap"))
    sinks.append_missing(snap, str(tmp_path / "snap"))
    sinks.append_missing(snap, str(tmp_path / "snap"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "snap")).select("key", "period").collect()) == [(1, "2025-01"), (2, "2025-02")]
    look = spark.createDataFrame([("8002000123", "2026-05")], "digit_number string, scan_month string")
    sinks.write_lookup(look, str(tmp_path / "look"))
    assert spark.read.parquet(str(tmp_path / "look" / "number")).first()["last4"] == "0123"


def test_bucketed_table_needs_no_shuffle(spark):
    from rollbook.operators import diff

    snap = spark.range(2000).selectExpr("id % 500 as key", "concat('2025-0', id div 500 + 1) as period", "'AA' as owner", "1 as status")
    spark.sql("DROP TABLE IF EXISTS bucketed_snap")
    sinks.write_bucketed(snap, "bucketed_snap", 4)
    table = spark.table("bucketed_snap")
    periods = spark.createDataFrame([("2025-01", 1, 4), ("2025-02", 2, 4), ("2025-03", 3, 4), ("2025-04", 4, 4)], "period string, idx long, n_periods long")
    plan = diff.pair_changes(table, periods)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" not in plan
    spark.sql("DROP TABLE bucketed_snap")


def test_validation(spark):
    ours = make(spark, ("1", "A", "d", "t", "MN"), ("2", "A", "d", "t", "x"), ("3", "B", "d", "t", "y"), ("4", "A", "d", "t", "z"))
    theirs = make(spark, ("1", "A", "d", "t", "ND"), ("2", "A ", "d", "t", "x"), ("3", "A", "d", "t", "q"), ("5", "A", "d", "t", "z"))
    found = validate.difference(validate.align(ours, theirs))
    assert {r["phone"]: r["finding"] for r in found.collect()} == {
        "1": "sub_owner", "2": "equal", "3": "status+sub_owner", "4": "only_ours", "5": "only_theirs",
    }
    v = validate.verdict(found, "MN").first()
    assert (v["equal"], v["differing"], v["expected"], v["passed"]) == (1, 2, 1, False)
    assert validate.verdict(found.where("phone in ('1', '2')"), "MN").first()["passed"]


@pytest.mark.parametrize("count", [30, 300, 20_000])
def test_rules_of_any_number(spark, count):
    """A table of rules gives what the first match of all patterns gives; so does a long CASE."""
    rng = random.Random(count)
    digits = "0123456789*"
    patterns = ["8" + "".join(rng.choice(digits) if rng.random() < 0.5 else "*" for _ in range(2)) + f"{rng.randrange(count):04d}***" for _ in range(count)]
    phones = [f"8{rng.randrange(100):02d}{rng.randrange(count):04d}{rng.randrange(1000):03d}" for _ in range(400)] + ["800", ""]
    rows = spark.createDataFrame([(x,) for x in dict.fromkeys(phones)], "phone string")
    table = spark.createDataFrame([(n + 1, x) for n, x in enumerate(patterns)], "rule_no int, pattern string")
    want = {}
    tests = [(n + 1, re.compile(x.replace("*", ".").replace("+", "."))) for n, x in enumerate(patterns)]
    for x in dict.fromkeys(phones):
        want[x] = next((n for n, t in tests if t.fullmatch(x)), None)
    assert {r.phone: r.rule_no for r in rules.wildcard_rule_join(rows, table).collect()} == want
    if count <= 300:
        assert {r.phone: r.rule_no for r in rules.wildcard_rule_join(rows, [(x,) for x in patterns]).collect()} == want


def test_cascade_from_tables(spark):
    """Tables and tuples of rules give the same month."""
    rows = [(f"800000000{n}", s, "01/01/01", "", c) for n in range(10) for s, c in [(" WORKING" if n % 2 else "SPARE", f"A{n}B01" if n % 3 else "")]]
    df = spark.createDataFrame(rows, "phone string, status string, date string, template string, sub_owner string")
    phone = [("800*****01", "X", None, "T", None), ("80000000**", None, "", None, None)]
    rename, status = [("A1***", "ZZZ01"), ("A***1", "ZZZ02")], [("ZZZ02", "WORKING", "NEW"), ("ZZZ**", "*", "OTHER"), ("A****", "SPARE", "S")]
    none = spark.createDataFrame([], "phone string, code string")

    def table(data, names):
        return spark.createDataFrame([(n, *r) for n, r in enumerate(data)], "rule_no int, " + ", ".join(f"{x} string" for x in names.split()))

    a = rules.adjust_snapshot(df, phone, rename, status, none)
    b = rules.adjust_snapshot(df, table(phone, "pattern status date template code"), table(rename, "pattern code"), table(status, "pattern status new_status"), none)
    assert sorted(a.select(*sorted(a.columns)).collect()) == sorted(b.select(*sorted(a.columns)).collect())


def test_rule_file_in_splits(spark, tmp_path):
    lines = [f"line {n}" + "x" * (n % 90) for n in range(2000)]
    (tmp_path / "rules.txt").write_text("\r\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        read = rule_files.read_rule_file(spark, str(tmp_path / "rules.txt"))
        assert [r.value for r in read.orderBy("line_no").collect()] == lines
        assert sorted(r.line_no for r in read.collect()) == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
