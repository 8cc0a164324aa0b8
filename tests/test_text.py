"""Key, file-name, address, contact, domain, payload and mention functions."""

import datetime
import json
import random
import re

from pyspark.sql import functions as F

from rollbook.functions import calendar, keys
from rollbook.functions.text import brand_of, contact_struct, domain_of, plain_text, split_address
from rollbook.operators import contacts, directory, documents, pool
from rollbook.sources import files


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_key(spark):
    texts = ["1-800-FLOWERS", "+1 (800) 356-9377", "8003569377", "212-555-1212", "", None, "1-888-1234567", "80035693771"]
    want = ["8003569377", "8003569377", "8003569377", None, None, None, "8881234567", None]
    assert column(spark, texts, keys.normalize_key) == want


def test_key_parts(spark):
    assert column(spark, [8002000000, 8339999999], keys.segment_of, "long") == [800, 833]
    assert column(spark, [8002000000, 8330000007], keys.suffix_of, "long") == ["2000000", "0000007"]
    assert column(spark, [8002000000], keys.dashed, "long") == ["800-200-0000"]
    assert column(spark, [8002000000], keys.segment_form, "long") == ["800-2000000"]


def test_file_names(spark):
    want = {
        "apr2019.zip": "2019-04", "june2018": "2018-06", "2020 feb all.txt": "2020-02", "2020-3-ALL.txt": "2020-03",
        "22 07 Data.zip": "2022-07", "18-10": "2018-10", "bq180907": "2018-09", "RegistryAug2019": "2019-08",
        "20July": "2020-07", "Jan 2023": "2023-01", "Oct-1 2020": "2020-10", "notes.txt": None, "2020-13": None,
        "2020 dec all edited2.txt": "2020-12", "sept_2021": "2021-09",
    }
    assert column(spark, list(want), files.month_from_name) == list(want.values())
    names = {
        "SMS800.D20180301.txt": 800, "CD-ROM_TFN_Report_844_20250601000000.txt": 844, "Number-Status-NPA-833.txt": 833,
        "cd-rom_tfn_report_888_x-UPDATED010101.TXT": 888, "SMS801.txt": None, "Report_800.txt": None,
    }
    assert column(spark, list(names), files.segment_from_name) == list(names.values())


def test_best_source(spark):
    rows = [("2025-01", f"{s}", c, n) for s, n, cs in (("a.zip", 1, range(7)), ("b", 2, range(7)), ("c.txt", 3, range(3))) for c in cs]
    rows += [("2025-02", "d.zip", 1, 4), ("2025-02", "e.zip", 2, 5)]
    df = spark.createDataFrame(rows, "period string, source string, segment int, source_no int")
    best = {r["period"]: r["source"] for r in files.best_source_rows(df).collect()}
    assert best == {"2025-01": "b", "2025-02": "d.zip"}


def test_address(spark):
    texts = [
        "77 Example Drive  Rivertown New York, USA 12999 800-555-0100", "12 King St Toronto ON, Canada M5V 2T6",
        "5 Elm Rd Charleston West Virginia, USA 25301", "po box 7", "", None, "9 Long Wide Oak Street Big City Texas, USA",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    got = [tuple(r)[1:] for r in split_address(df, "a").select("i", "street", "city", "state", "country", "zip", "phone").orderBy("i").collect()]
    assert got == [
        ("77 Example Drive", "Rivertown", "New York", "USA", "12999", "800-555-0100"),
        ("12", "King St Toronto", "ON", "Canada", "M5V 2T6", ""),
        ("5", "Elm Rd Charleston", "West Virginia", "USA", "25301", ""),
        ("po box 7", "", "", "", "", ""),
        ("", "", "", "", "", ""),
        ("", "", "", "", "", ""),
        ("9 Long Wide Oak", "Street Big City", "Texas", "USA", "", ""),
    ]


def test_contact(spark):
    got = column(
        spark,
        ["Ann Lee ann@mail.example.com P: 555-010-1234 x9 F: 555-111-2222", "Just A Name", "", None, "ann@mail.example.com"],
        contact_struct,
    )
    assert [tuple(r) for r in got] == [
        ("Ann Lee", "ann@mail.example.com", "555-010-1234 x9", "555-111-2222"),
        ("Just A Name", "", "", ""),
        ("", "", "", ""),
        ("", "", "", ""),
        ("", "ann@mail.example.com", "", ""),
    ]


def test_brand(spark):
    got = column(spark, ["100 Main St, The UPS Store 12", "1 Broad St", "Suite 5 PMB #3", "Post Office Box 9", None], brand_of)
    assert [tuple(r) if r else None for r in got] == [
        ("The UPS Store", "high", "Main St, The UPS Store 12"),
        None,
        ("Private Mailbox (PMB)", "medium", "Suite 5 PMB #3"),
        ("P.O. Box", "medium", "Post Office Box 9"),
        None,
    ]


def test_domain(spark):
    want = {
        "https://www.Site.example.com/a?b": "site.example.com", "site.example.org": "site.example.org",
        "http://u@shop.example.net:8080/x": "shop.example.net", "no site": None, "x.y": None, "": None, "www.a.example": "a.example",
    }
    assert column(spark, list(want), domain_of) == list(want.values())


def test_dates(spark):
    days = [datetime.date(2024, 1, 7), datetime.date(2024, 1, 6)]
    assert column(spark, days, calendar.last_saturday, "date") == [datetime.date(2024, 1, 6)] * 2
    assert column(spark, ["1/7/2024", "13/1/2024", "x", None], calendar.us_date) == [datetime.date(2024, 1, 7), None, None, None]
    assert column(spark, ["Nov 2038", "N/A", ""], calendar.month_year_date) == [datetime.date(2038, 11, 1), None, None]
    assert column(spark, ["2024-03", "2024-Q2"], calendar.month_ordinal) == [2024 * 12 + 3, 2024 * 12 + 6]


def test_report_header(spark):
    double = "".join(c * 2 for c in "Subject: Report for Saturday, 01/06/2024")
    rows = [("r1", "Notification No: NUM-24-7\nDate: 1/8/2024\n" + double), ("r2", "Date: 1/7/2024"), ("r3", "for Saturday, 1/13/2024")]
    got = pool.report_header(spark.createDataFrame(rows, "report string, text string")).orderBy("report").collect()
    sixth = datetime.date(2024, 1, 6)
    assert [(r["report_no"], r["week_ending"]) for r in got] == [("NUM-24-7", sixth), ("r2", sixth), ("r3", datetime.date(2024, 1, 13))]
    assert column(spark, ["1,234", " N/A", "", "12.5", None], pool.clean_int) == [1234, None, None, None, None]


def test_growth_weeks(spark):
    rows = [("2024-01-01", -5), ("2024-01-08", 3), ("2024-01-15", None), ("2024-01-22", 0)]
    flows = spark.createDataFrame(rows, "week_ending string, growth_week long")
    assert pool.weeks_since_growth(flows).first()[0] == 2


def test_rich_text(spark):
    kind = "array<struct<_type: string, children: array<struct<text: string>>>>"
    block = {"_type": "block", "children": [{"text": "a"}, {"text": None}, {"text": "b "}]}
    assert column(spark, [[block, {"_type": "image", "children": [{"text": "x"}]}, block], None], plain_text, kind) == ["ab \n\nab", ""]


def test_payloads(spark):
    good = json.dumps({"overview": "o", "confidence": " HIGH ", "recent_news": [{"title": " t "}, {"title": ""}, 3]})
    texts = {
        good: "clean", f"```json\n{good}\n```": "clean", good.replace('"overview"', '"junk", "overview"', 1).replace("{", '{"a": 1, ', 1): "repaired",
        good + " end": "salvaged", "none": "failed", "[1]": "failed", good + good: "failed",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = documents.parse_payload(df, "t")
    assert [r["outcome"] for r in parsed.orderBy("i").collect()] == list(texts.values())
    first = documents.normalise_payload(parsed).orderBy("i").first()
    assert (first["overview"], first["confidence"], len(first["news"]), first["news"][0]["title"]) == ("o", "high", 1, "t")


def test_mentions_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta-max", "acme corp", "Ünïcode", "a.b.c.d", "delta", "acme", "corps", "??!!??", "x_alpha"]
    texts = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "s", "!", "é"]) for _ in range(6))) for i in range(200)]
    texts.append((999, "end??!!??start"))
    names = [("A", "Acme Corp", None), ("B", "alpha", "beta-max"), ("C", "Ünïcode", "a.b.c.d"), ("D", "unknown", "abc"), ("E", "??!!??", "corps"), ("F", "acme corp!", "x_alpha")]
    got = documents.mention_search(
        spark.createDataFrame(texts, "doc_id int, text string"), documents.needles(spark.createDataFrame(names, "owner string, title string, alias string"))
    )
    want = set()
    for owner, *both in names:
        for n in both:
            if n and len(n.strip()) >= 5 and n.lower() not in documents.STOP_NAMES:
                pattern = re.compile(r"\b" + re.escape(n.lower().strip()) + r"\b")
                want |= {(owner, i) for i, t in texts if pattern.search(t.lower())}
    assert {tuple(r) for r in got.collect()} == want
    assert ("E", 999) in want


def test_mentions_look_only_around_anchors(spark):
    """Names of many lengths and shared words: no stretch is put together at every place of a text."""
    names = [(f"o{i}", " ".join(["telecom"] * (i % 9)) + f" name{i} telecom", "the telecom") for i in range(60)]
    texts = [(0, "the telecom, the telecom"), (1, "telecom name1 telecom."), (2, "telecom telecom name2 telecom name0 telecoms"), (None, "x-the telecom"), (3, None), (4, "")]
    wanted = documents.needles(spark.createDataFrame(names, "owner string, title string, alias string"))
    got = documents.mention_search(spark.createDataFrame(texts, "doc_id int, text string"), wanted)
    want = {(f"o{i}", d) for i in range(60) for d in (0, None)} | {("o1", 1), ("o2", 2)}
    assert len(got.collect()) == len(want) and {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "array_distinct" not in plan and "BroadcastHashJoin" in plan
    anchors = {r["needle"]: r["anchor"] for r in documents._anchored(wanted).collect()}
    assert anchors["telecom name1 telecom"] == "name1" and anchors["the telecom"] == "the"
    none = documents.mention_search(spark.createDataFrame(texts, "doc_id int, text string"), wanted.where("false"))
    assert none.count() == 0 and none.columns == ["owner", "doc_id"]


def test_contact_csv_and_clusters(spark, tmp_path):
    head = '"ID","Company Name","Company Address","Primary Contact","Change Contact","Notes"\n'
    body = ('"AB102","Acme ""A""","1 Main St","Ann a@x.example.com P: 555-000-1111","",""\n'
            '"AB101","First","","Bob a@x.example.com","",""\n"cd101","Other","","A@X.example.com P: 1-555-000-1111","",""\n"X","","","","",""\n')  # fmt: skip
    (tmp_path / "s.csv").write_bytes(b"\xef\xbb\xbf" + (head + body).encode())
    rows = contacts.read_contacts_csv(spark, str(tmp_path / "s.csv"))
    assert rows.count() == 4
    codes = contacts.admin_codes(rows.withColumn("row_no", F.monotonically_increasing_id()), "row_no")
    assert {r["admin_code"]: r["code"] for r in codes.collect()} == {"AB1": "AB101", "CD1": "CD101"}
    found = contacts.contact_clusters(contacts.contact_table(codes)).collect()
    assert [(r["key_type"], r["key"], r["n_codes"], r["n_owners"]) for r in found] == [("email", "a@x.example.com", 2, 2)]


def test_read_directory(spark, tmp_path):
    docs = [{"doc_no": 1, "_id": "drafts.a", "title": "D", "code": "AB101", "categories": [{"_ref": "c1", "_key": "k"}]},
            {"doc_no": 2, "_id": "a", "title": "P", "code": "AB101", "groups": None}]
    (tmp_path / "docs.json").write_text(json.dumps(docs, indent=1))
    read = directory.read_directory(spark, str(tmp_path / "docs.json"))
    assert [r["title"] for r in directory.latest_version(read).collect()] == ["P"]
    assert directory.dedupe_summary(read).first()["both"] == 1


def test_partner_names(spark):
    docs = spark.createDataFrame([(1, "AB1", "Lumo"), (2, "CD1", "Mayfair")], "doc_no long, code string, title string")
    groups = spark.createDataFrame([("AB", "Lumo"), ("CD", "Prime"), ("CD", "Alt")], "owner string, title string")
    names = directory.owner_names(docs, groups)
    rows = spark.createDataFrame([("AB",), ("CD",), ("DISC",), ("ZZ",)], "partner string")
    got = {r["partner"]: r["partner_name"] for r in directory.partner_names(rows, names).collect()}
    assert got == {"AB": "Lumo", "CD": "Mayfair (Alt, Prime)", "DISC": "DISC", "ZZ": "ZZ"}


def test_slugs_in_owner_order(spark):
    """The first free of base, base-owner, base-3, ...; also against other stubs' slugs."""
    rows = [("AB", "foo"), ("CD", "foo-ab"), ("EF", "foo"), ("GH", "bar"), ("IJ", "bar"), ("KL", "new"), ("MN", "new")]
    used = ["foo", "bar", "bar-gh", "bar-3", "foo-ef", "other", "newer-3"]
    taken, want = set(used), {}
    for owner, base in sorted(rows):
        options = [base, f"{base}-{owner.lower()}", *[f"{base}-{n}" for n in range(3, 20)]]
        want[owner] = next(x for x in options if x not in taken)
        taken.add(want[owner])
    got = directory.unique_slugs(spark.createDataFrame(rows, "owner string, base string"), spark.createDataFrame([(x,) for x in used], "slug string"))
    assert {r.owner: r.slug for r in got.collect()} == want and want["CD"] == "foo-ab-cd" and want["GH"] == "bar-4"
    assert directory.unique_slugs(spark.createDataFrame(rows[:0], "owner string, base string"), spark.createDataFrame([], "slug string")).count() == 0
