"""Files that are written and read: contacts, directories, exports, the lookup table."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from rollbook.operators import contacts, directory
from rollbook.sources import sinks

HEAD = "﻿ID,Company Name,Company Address,Primary Contact,Change Contact,Notes\r\n"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_contacts_of_several_files(spark, tmp_path):
    """Quoted line breaks and quotes, a mark before the header, a record of too many cells; the later of equal codes counts."""
    texts = {
        "suffix_01.csv": 'AB101,"First, Inc","1 Oak\r\nRow","P ""x""",,"two\nlines"\r\nab102,Low,,,,\r\n' + "".join(f"ZZ{i:03d},n{i},,,,\r\n" for i in range(500)),
        "suffix_02.csv": "AB101,Second,,,,late\r\nAB101,Third,,,,later\r\nx,short,,,,\r\nCD101,a,b,c,d,e,f,g\r\n",
        "suffix_10.csv": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes((HEAD + text).encode("utf-8"))
    rows = contacts.read_contacts_csv(spark, str(tmp_path / "suffix_*.csv"))
    got = rows.orderBy("row_no").collect()
    assert [r.ID for r in got] == ["AB101", "ab102", *[f"ZZ{i:03d}" for i in range(500)], "AB101", "AB101", "x", "CD101"]
    assert got[0]["Company Address"].splitlines() == ["1 Oak", "Row"] and got[0]["Primary Contact"] == 'P "x"' and got[0].Notes == "two\nlines"
    assert [r.ID for r in got if r.corrupt] == ["CD101"]
    codes = {r.admin_code: r for r in contacts.admin_codes(rows, "row_no").collect()}
    assert codes["AB1"].code == "AB101" and codes["AB1"].company_name == "Third" and codes["AB1"].notes == "later"
    assert "x" not in {k.lower() for k in codes} and codes["ZZ0"].company_name == "n0"


def test_directory_of_several_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n {"doc_no": 1, "title": "A\\nB",\n  "categories": [{"_ref": "c"}]},\n {"doc_no": 2}\n]')
    (tmp_path / "b.json").write_text('[{"doc_no": 3, "unknown": 1}]')
    (tmp_path / "c.json").write_text('[{"doc_no": 4, ')
    rows = directory.read_directory(spark, str(tmp_path))
    rows = {r.doc_no: r for r in rows.collect()}
    assert rows[1].title == "A\nB" and rows[1].categories[0]._ref == "c" and rows[2].title is None and rows[3].corrupt is None
    assert [r.corrupt is not None for k, r in rows.items() if k not in (1, 2, 3)] == [True]


def test_ordered_text(spark, tmp_path):
    path, wide = str(tmp_path / "out"), [f"{i * 7919 % 10**6:07d}, " + "x " * (i % 5) for i in range(3000)]
    lines = spark.createDataFrame([(v,) for v in wide], "value string").repartition(7)
    sinks.write_ordered_text(lines, path, "value", files=3)
    names = sorted(n for n in os.listdir(f"{path}/lines") if n.startswith("part"))
    data = b"".join(open(f"{path}/lines/{n}", "rb").read() for n in names)
    assert data == "".join(v + "\r\n" for v in sorted(wide)).encode() and len(names) > 1
    assert sorted(r.value for r in sinks.read_ordered_text(spark, path).collect()) == sorted(wide)
    told = spark.read.parquet(f"{path}/manifest").orderBy("file").collect()
    assert [t.file for t in told] == names and sum(t.lines for t in told) == 3000
    assert all(a.greatest < b.least for a, b in zip(told, told[1:], strict=False))
    with open(f"{path}/lines/{names[1]}", "r+b") as f:  # a file that was cut
        f.truncate(100)
    os.remove(f"{path}/lines/.{names[1]}.crc")
    with pytest.raises(ValueError, match=names[1]):
        sinks.read_ordered_text(spark, path)


def test_lookup_search_prunes(spark, tmp_path):
    path = str(tmp_path / "lookup")
    rows = [(f"8{i * 104729 % 10**9:09d}", f"w{i}", m) for i in range(4000) for m in ("2026-04", "2026-05")]
    sinks.write_lookup(spark.createDataFrame(rows, "digit_number string, term string, scan_month string"), path)
    numbers = [n for n, _, _ in rows]
    wanted = [numbers[0], numbers[8], "8999999999", numbers[20][-4:], numbers[40][-5:], numbers[60][-6:], "12"]
    found = sinks.search_lookup(spark, path, "2026-05", wanted)
    got = sorted((r.digit_number, r.term) for r in found.collect())
    want = sorted({(n, t) for n, t, m in rows if m == "2026-05" and (n in wanted or any(n.endswith(w) for w in wanted if 4 <= len(w) <= 6))})
    assert got == want and {r.scan_month for r in found.collect()} == {"2026-05"} and len(got) >= 5
    plan = plan_of(found)
    assert plan.count("PartitionFilters: [isnotnull(scan_month") == 2 and "In(digit_number" in plan and "StringStartsWith(tail" in plan
    assert "Exchange" not in plan
    assert sinks.search_lookup(spark, path, "2026-05", []).count() == 0
    # the tails stand in order, so a file covers a narrow range of suffixes
    spans = spark.read.parquet(f"{path}/tail").groupBy(F.input_file_name()).agg(F.min("tail").alias("a"), F.max("tail").alias("b"), F.first("scan_month").alias("m")).orderBy("m", "a").collect()
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:], strict=False) if x.m == y.m)
