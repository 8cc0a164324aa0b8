"""Contacts, mailbox flags, domains, mentions, news and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions.text import STATE_CODES, brand_of, contact_struct, domain_of, plain_text, split_address
from rollbook.operators import contacts, directory, documents
from rollbook.plans.base import DOCS_SQL, owner_docs, query, table
from rollbook.plans.directory_queries import _published
from rollbook.session import scratch_path

DOCS = f"WITH{DOCS_SQL}\n"

# --- contact lists, one row per customer ----------------------------------------------

CONTACT_ROWS_SQL = """
cr AS (SELECT c_custkey AS k, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS owner,
    lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', c_custkey % 26 + 1, 1) || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS code,
    CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 90 AS VARCHAR), 9, '0') ELSE c_name END AS company_name,
    CAST(c_custkey % 900 + 100 AS VARCHAR) AS n, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS z FROM customer),
ca AS (SELECT *, substr(code, 1, 3) AS admin_code,
    CASE k % 6 WHEN 0 THEN n || ' Main Street' WHEN 1 THEN n || ' Oak' WHEN 2 THEN '12' WHEN 3 THEN 'po box ' || n WHEN 5 THEN n || ' Elm Rd' ELSE '' END AS street,
    CASE k % 6 WHEN 0 THEN 'Springfield' WHEN 1 THEN 'Avenue New York' WHEN 2 THEN 'King St Toronto' WHEN 5 THEN 'Charleston' ELSE '' END AS city,
    CASE k % 6 WHEN 0 THEN 'Texas' WHEN 1 THEN 'New York' WHEN 2 THEN 'ON' WHEN 5 THEN 'West Virginia' ELSE '' END AS state,
    CASE k % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'USA' WHEN 2 THEN 'Canada' WHEN 5 THEN 'USA' ELSE '' END AS country,
    CASE k % 6 WHEN 0 THEN '7' || z WHEN 1 THEN '1' || z || '-1234' WHEN 2 THEN 'M5V 2T6' ELSE '' END AS zip,
    CASE k % 6 WHEN 0 THEN '214-555-' || z WHEN 5 THEN '555555' || z ELSE '' END AS company_phone,
    CASE k % 5 WHEN 0 THEN 'Ann Lee' WHEN 1 THEN 'Bob P: 1 555 020 ' || lpad(CAST(k % 25 AS VARCHAR), 4, '0') WHEN 2 THEN 'nobody@x' WHEN 4 THEN 'Cara Ng' ELSE '' END AS primary_name,
    CASE k % 5 WHEN 0 THEN 'ann' || k % 40 || '@mail.example.com' WHEN 4 THEN 'CARA' || k % 40 || '@Mail.Example.com' ELSE '' END AS primary_email,
    CASE k % 5 WHEN 0 THEN '555-0' || lpad(CAST(k % 30 AS VARCHAR), 2, '0') || '-1234 x9' WHEN 1 THEN '1 555 020 ' || lpad(CAST(k % 25 AS VARCHAR), 4, '0') ELSE '' END AS primary_phone,
    CASE k % 5 WHEN 0 THEN '555-111-2222' WHEN 4 THEN '555-333-4444' ELSE '' END AS primary_fax FROM cr),
adm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY admin_code ORDER BY code, k DESC) AS rn FROM ca) WHERE rn = 1)"""


def _contact_rows(spark, d, notes='says "hi", ok'):
    k = F.col("c_custkey")
    n = (k % 900 + 100).cast("string")
    z = F.lpad((k % 10000).cast("string"), 4, "0")
    code = F.concat(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k % 26 + 1).cast("int"), F.lit(1)),
        F.lpad((k % 100).cast("string"), 2, "0"),
    )
    company = (
        F.when(k % 9 == 0, "")
        .when(k % 7 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 90).cast("string"), 9, "0")))
        .otherwise(F.col("c_name"))
    )
    address = (
        F.when(k % 6 == 0, F.concat(n, F.lit(" Main Street  Springfield Texas, USA 7"), z, F.lit(" 214-555-"), z))
        .when(k % 6 == 1, F.concat(n, F.lit(" Oak Avenue New York New York, USA 1"), z, F.lit("-1234")))
        .when(k % 6 == 2, "12 King St Toronto ON, Canada M5V 2T6")
        .when(k % 6 == 3, F.concat(F.lit("po box "), n))
        .when(k % 6 == 5, F.concat(n, F.lit(" Elm Rd  Charleston West Virginia, USA 555555"), z))
        .otherwise("")
    )
    slot = (k % 40).cast("string")
    primary = (
        F.when(k % 5 == 0, F.concat(F.lit("Ann Lee ann"), slot, F.lit("@mail.example.com P: 555-0"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("-1234 x9 F: 555-111-2222")))
        .when(k % 5 == 1, F.concat(F.lit("Bob P: 1 555 020 "), F.lpad((k % 25).cast("string"), 4, "0")))
        .when(k % 5 == 2, "nobody@x")
        .when(k % 5 == 4, F.concat(F.lit("Cara Ng CARA"), slot, F.lit("@Mail.Example.com F: 555-333-4444")))
        .otherwise("")
    )
    cells = (
        F.when(k % 4 == 0, F.concat(F.lit(" "), F.lower(code))).otherwise(code),
        company,
        address,
        primary,
        F.lit("Dan P: 555-777-8888"),
        F.lit(notes),
    )
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]
    return table(spark, d, "customer").select(k.alias("row_no"), F.concat_ws(",", *quoted).alias("value"))


def _codes(spark, d):
    return contacts.admin_codes(contacts.parse_contact_lines(_contact_rows(spark, d)), "row_no")


#: Contacts of a file, few enough for the task that reads it.
CONTACTS_PER_FILE = 5000


def _contact_files(spark, d):
    """The contacts as CSV files with a byte order mark, a header and line breaks in quotes."""
    rows = _contact_rows(spark, d, 'says "hi",\nok').withColumn("file_no", F.lpad(F.floor(F.col("row_no") / CONTACTS_PER_FILE).cast("string"), 8, "0"))
    names = ",".join(f.split("`")[1] for f in contacts.CONTACT_SCHEMA.split(", "))
    heads = rows.select("file_no").distinct().select(F.lit(-1).cast("long").alias("row_no"), F.lit("\ufeff" + names).alias("value"), "file_no")
    path = scratch_path(spark, "contacts")
    ordered = rows.unionByName(heads).repartition("file_no").sortWithinPartitions("file_no", "row_no").drop("row_no")
    ordered.write.partitionBy("file_no").text(path)
    return f"{path}/*"


@query(
    "scan_contacts_csv",
    f"WITH{CONTACT_ROWS_SQL}\nSELECT admin_code, owner, code, company_name, 'Dan P: 555-777-8888' AS change_raw, 'says \"hi\",' || chr(10) || 'ok' AS notes FROM adm",
)
def _(spark, d):
    rows = contacts.read_contacts_csv(spark, _contact_files(spark, d)).where("corrupt is null")
    return contacts.admin_codes(rows, "row_no").drop("address_raw", "primary_raw")


@query("parse_address", f"WITH{CONTACT_ROWS_SQL}\nSELECT k, street, city, state, country, zip, company_phone AS phone FROM ca")
def _(spark, d):
    rows = contacts.parse_contact_lines(_contact_rows(spark, d)).withColumnRenamed("row_no", "k")
    return split_address(rows, "`Company Address`").select("k", "street", "city", "state", "country", "zip", "phone")


@query(
    "parse_contact",
    f"WITH{CONTACT_ROWS_SQL}\nSELECT k, primary_name AS name, primary_email AS email, primary_phone AS phone, primary_fax AS fax FROM ca",
)
def _(spark, d):
    rows = contacts.parse_contact_lines(_contact_rows(spark, d)).withColumnRenamed("row_no", "k")
    return rows.select("k", contact_struct(F.col("`Primary Contact`")).alias("c")).select("k", "c.*")


@query(
    "contact_table",
    f"""WITH{CONTACT_ROWS_SQL}
SELECT owner, admin_code, code, company_name, street, city, state, country, zip, company_phone, primary_name, primary_email, primary_phone, primary_fax,
  'Dan P: 555-777-8888' AS change_name, '' AS change_email, '555-777-8888' AS change_phone, '' AS change_fax, 'says "hi", ok' AS notes FROM adm""",
)
def _(spark, d):
    return contacts.contact_table(_codes(spark, d))


@query(
    "contact_clusters",
    f"""WITH{CONTACT_ROWS_SQL},
ks AS (SELECT 'email' AS key_type, lower(primary_email) AS key, admin_code FROM adm WHERE primary_email <> ''
  UNION ALL SELECT 'phone', right(regexp_replace(primary_phone, '[^0-9]', '', 'g'), 10), admin_code FROM adm WHERE length(regexp_replace(primary_phone, '[^0-9]', '', 'g')) >= 10)
SELECT key_type, key, count(DISTINCT admin_code) AS n_codes, string_agg(DISTINCT admin_code, '|' ORDER BY admin_code) AS admin_codes,
  count(DISTINCT substr(admin_code, 1, 2)) AS n_owners, string_agg(DISTINCT substr(admin_code, 1, 2), '|' ORDER BY substr(admin_code, 1, 2)) AS owners
FROM ks GROUP BY 1, 2 HAVING count(DISTINCT admin_code) >= 2""",
)
def _(spark, d):
    return contacts.contact_clusters(contacts.contact_table(_codes(spark, d)))


@query(
    "stub_owners",
    f"""WITH{DOCS_SQL},{CONTACT_ROWS_SQL},
pub AS (SELECT * FROM docs WHERE owner NOT IN (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') FROM supplier WHERE s_acctbal < 500)),
fc AS (SELECT *, CASE WHEN company_name <> '' THEN company_name ELSE 'Unknown (' || owner || ')' END AS title FROM
  (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY code) AS rn2 FROM adm WHERE owner NOT IN (SELECT owner FROM pub)) WHERE rn2 = 1),
sl AS (SELECT *, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS base FROM fc)
SELECT owner, code, title, CASE WHEN base NOT IN (SELECT slug FROM pub) AND row_number() OVER (PARTITION BY base ORDER BY owner) = 1 THEN base ELSE base || '-' || owner END AS slug,
  street, city, CASE state WHEN 'Texas' THEN 'TX' WHEN 'New York' THEN 'NY' WHEN 'West Virginia' THEN 'WV' ELSE state END AS state,
  CASE WHEN country IN ('', 'USA') THEN 'United States' ELSE country END AS country, zip FROM sl""",
)
def _(spark, d):
    return directory.stub_owners(contacts.contact_table(_codes(spark, d)), _published(spark, d), STATE_CODES)


# --- mailbox flags --------------------------------------------------------------------

FLAGS_SQL = f"""{DOCS_SQL},
br AS (SELECT *, CASE doc_no % 9 WHEN 0 THEN 'The UPS Store' WHEN 1 THEN 'Private Mailbox (PMB)' WHEN 2 THEN 'P.O. Box' END AS brand,
  CASE doc_no % 9 WHEN 0 THEN trim(substr(street1, 1, 23)) WHEN 1 THEN trim(substr(street1, greatest(instr(street1, 'PMB') - 10, 1), instr(street1, 'PMB') + 5 + 10 - greatest(instr(street1, 'PMB') - 10, 1)))
    WHEN 2 THEN trim(substr(street1, 1, 18)) END AS raw_hit FROM docs),
ak AS (SELECT doc_no, owner, regexp_replace(regexp_replace(trim(lower(street1)), '\\s+', ' ', 'g'), '[ .,]+$', '') || '|' || lower(city) || '|' || lower(state) AS address_key
  FROM docs WHERE street1 IS NOT NULL AND city IS NOT NULL),
sh AS (SELECT a.doc_no, a.owner, a.address_key, n_owners, CASE WHEN n_owners >= 3 THEN 'high' ELSE 'medium' END AS confidence,
  [x FOR x IN owners IF x <> a.owner] AS peers FROM ak a JOIN (SELECT address_key, count(DISTINCT owner) AS n_owners, list_sort(list_distinct(list(owner))) AS owners FROM ak GROUP BY 1) g USING (address_key) WHERE n_owners > 1),
fl AS (SELECT b.owner, b.doc_no, 'org-' || b.doc_no AS doc_id, coalesce(b.brand, 'Shared address (' || n_owners || ' owners)') AS brand,
  CASE WHEN b.brand = 'The UPS Store' THEN 'high' WHEN b.brand IS NOT NULL THEN 'medium' ELSE confidence END AS confidence,
  coalesce(b.raw_hit, 'also: ' || array_to_string(list_slice(peers, 1, 5), ', ')) AS raw_hit, coalesce(street1, '') AS street1
  FROM br b LEFT JOIN sh USING (doc_no) WHERE b.brand IS NOT NULL OR n_owners IS NOT NULL)"""


@query(
    "brand_classifier",
    f"WITH{FLAGS_SQL}\nSELECT doc_no, brand, CASE WHEN brand = 'The UPS Store' THEN 'high' WHEN brand IS NOT NULL THEN 'medium' END AS confidence, raw_hit FROM br",
)
def _(spark, d):
    return owner_docs(spark, d).select("doc_no", brand_of(F.col("address.street1")).alias("b")).select("doc_no", "b.*")


@query(
    "shared_address",
    f"WITH{FLAGS_SQL}\nSELECT doc_no, owner, address_key, n_owners, confidence, array_to_string(peers, '|') AS peers FROM sh",
)
def _(spark, d):
    return contacts.shared_address(owner_docs(spark, d))


@query("mailbox_flags", f"WITH{FLAGS_SQL}\nSELECT * FROM fl")
def _(spark, d):
    return contacts.mailbox_flags(owner_docs(spark, d))


@query(
    "flag_dedupe",
    f"""WITH{FLAGS_SQL}
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE confidence WHEN 'high' THEN 0 ELSE 1 END, doc_no) AS rn FROM fl) WHERE rn = 1""",
)
def _(spark, d):
    return contacts.flag_dedupe(contacts.mailbox_flags(owner_docs(spark, d)))


# --- domains --------------------------------------------------------------------------


@query(
    "extract_domain",
    """SELECT page_id, CASE WHEN contains(h, '.') AND length(h) >= 4 THEN h END AS domain FROM (SELECT page_id,
    regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z]+://([^/?#]*)', 1), ':.*$', ''), '^www\\.', '') AS h FROM pages)""",
)
def _(spark, d):
    return table(spark, d, "pages").select("page_id", domain_of(F.col("url")).alias("domain"))


DOMAIN_SQL = f"""{DOCS_SQL},
dm AS (SELECT owner, 'org-' || doc_no AS doc_id, CASE doc_no % 6 WHEN 1 THEN 'site' || doc_no || '.example.com' WHEN 2 THEN 'site' || doc_no || '.example.org'
  WHEN 3 THEN 'registry.example' WHEN 5 THEN 'shop' || (doc_no % 50) || '.example.net' END AS domain FROM docs),
dom AS (SELECT * FROM dm WHERE domain IS NOT NULL AND domain <> 'registry.example'),
lk AS (SELECT domain, max(CAST(CASE WHEN n % 5 <> 0 THEN '20' || lpad(CAST(n % 20 AS VARCHAR), 2, '0') || '-03-15' END AS DATE)) AS created,
  '2024-' || lpad(CAST(max(n) % 6 + 1 AS VARCHAR), 2, '0') || '-10T12:00:00' AS looked_up_at
  FROM (SELECT domain, CAST(substr(doc_id, 5) AS BIGINT) AS n FROM dom) GROUP BY 1 HAVING max(n) % 4 <> 0)"""


def _domains(spark, d):
    return contacts.owner_domains(owner_docs(spark, d), ["registry.example"])


def _lookups(spark, d):
    """A stored result for most domains; the creation day is unknown for some."""
    n = F.substring("doc_id", 5, 20).cast("long")
    rows = _domains(spark, d).select("domain", n.alias("n"))
    day = F.concat(F.lit("20"), F.lpad((F.col("n") % 20).cast("string"), 2, "0"), F.lit("-03-15")).cast("date")
    month = F.lpad((F.max("n") % 6 + 1).cast("string"), 2, "0")
    found = rows.groupBy("domain").agg(
        F.max(F.when(F.col("n") % 5 != 0, day)).alias("created"),
        F.concat(F.lit("2024-"), month, F.lit("-10T12:00:00")).alias("looked_up_at"),
        F.max("n").alias("last_n"),
    )
    return found.where(F.col("last_n") % 4 != 0).drop("last_n")


@query("owner_domains", f"WITH{DOMAIN_SQL}\nSELECT * FROM dom")
def _(spark, d):
    return _domains(spark, d)


@query(
    "domain_age",
    f"""WITH{DOMAIN_SQL}
SELECT owner, doc_id, domain, CAST(created AS VARCHAR) AS created, date_diff('day', created, DATE '2024-06-30') / 365.25::DOUBLE AS age_years, looked_up_at FROM dom JOIN lk USING (domain)""",
)
def _(spark, d):
    return contacts.domain_age(_domains(spark, d), _lookups(spark, d), F.lit("2024-06-30").cast("date"))


@query(
    "stale_lookups",
    f"""WITH{DOMAIN_SQL}
SELECT DISTINCT domain FROM dom LEFT JOIN lk USING (domain) WHERE looked_up_at IS NULL
  OR floor((epoch(TIMESTAMP '2024-06-30 00:00:00') - epoch(CAST(looked_up_at AS TIMESTAMP))) / 86400) >= 90""",
)
def _(spark, d):
    return contacts.stale_lookups(_domains(spark, d), _lookups(spark, d), F.lit("2024-06-30").cast("timestamp"), 90)


# --- texts ----------------------------------------------------------------------------


def _mention_names(spark, d):
    """Names to look for: the opening words and the first long word of each passage."""
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("owner"),
        F.regexp_extract("text", r"^(\S+ \S+ \S+)", 1).alias("title"),
        F.regexp_extract("text", r"([A-Za-z]{6,})", 1).alias("alias"),
    )


@query(
    "mention_search",
    r"""WITH nd AS (SELECT DISTINCT owner, needle FROM (SELECT item_id AS owner, lower(trim(unnest([regexp_extract(text, '^(\S+ \S+ \S+)', 1), regexp_extract(text, '([A-Za-z]{6,})', 1)]))) AS needle FROM benchmark)
    WHERE length(needle) >= 5 AND needle NOT IN ('unknown', 'secondary', 'telecom', 'communications', 'international', 'messaging', 'regional phone company'))
    , mk AS (SELECT doc_id, regexp_replace(lower(text), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(1), 'g') AS marked FROM documents),
    mn AS (SELECT owner, CASE WHEN m[1] <> chr(1) THEN chr(1) ELSE '' END || m || CASE WHEN m[-1] <> chr(1) THEN chr(1) ELSE '' END AS m
      FROM (SELECT owner, regexp_replace(needle, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(1), 'g') AS m FROM nd))
    SELECT DISTINCT owner, doc_id FROM mn JOIN mk ON contains(marked, m)""",
)
def _(spark, d):
    return documents.mention_search(table(spark, d, "documents"), documents.needles(_mention_names(spark, d)))


@query(
    "flatten_rich_text",
    DOCS + "SELECT doc_no, s_name || ' of ' || n_name || chr(10) || chr(10) || 'No ' || doc_no AS plain FROM docs",
)
def _(spark, d):
    return owner_docs(spark, d).select("doc_no", plain_text(F.col("summary")).alias("plain"))


@query(
    "flatten_conversations",
    """SELECT conv_id, turn, trim(array_to_string([x FOR x IN string_split(text, chr(10)) IF x <> ''], chr(10) || chr(10)), chr(10) || chr(13) || chr(9) || ' ') AS plain
    FROM conversations""",
)
def _(spark, d):
    """The lines of a turn as the blocks of its rich text; an empty line is no text block."""
    blocks = F.transform(
        F.split("text", "\n"),
        lambda x: F.struct(F.when(x == "", "break").otherwise("block").alias("_type"), F.array(F.struct(x.alias("text"))).alias("children")),
    )
    return table(spark, d, "conversations").select("conv_id", "turn", plain_text(blocks).alias("plain"))


@query(
    "news_feed",
    DOCS.rstrip()
    + """
SELECT 'company-news' AS kind, unnest(['2024-0' || (doc_no % 9 + 1) || '-15', '']) AS date, unnest(['News ' || doc_no, 'Old ' || doc_no]) AS title, unnest(['text', '']) AS snippet,
  unnest(['d.example', '']) AS source_domain, unnest(['https://d.example/' || doc_no, '']) AS source_url, owner, title AS owner_title, CAST(NULL AS VARCHAR) AS article_slug
FROM docs WHERE doc_no % 10 = 0
UNION ALL
SELECT 'article', CASE WHEN n_chars % 5 = 0 THEN '' ELSE '2023-0' || (n_chars % 9 + 1) || '-01' END, 'Article ' || doc_id, source, NULL,
  '/article/a-' || doc_id, NULL, NULL, 'a-' || doc_id FROM documents
WHERE doc_id % 3 < 2 AND NOT lang = 'fr' AND n_chars % 11 <> 0""",
)
def _(spark, d):
    n = F.col("n_chars")
    day = F.concat(F.lit("2023-0"), (n % 9 + 1).cast("string"), F.lit("-01T10:00:00Z"))
    prefix = F.when(F.col("doc_id") % 3 == 0, "draft-article-").when(F.col("doc_id") % 3 == 1, "drafts.draft-article-").otherwise("post-")
    posts = table(spark, d, "documents").select(
        F.concat(prefix, F.col("doc_id").cast("string")).alias("_id"),
        (F.col("lang") == "fr").alias("noindex"),
        F.when(n % 11 != 0, F.concat(F.lit("a-"), F.col("doc_id").cast("string"))).alias("slug"),
        F.when((n % 5 != 0) & (n % 2 == 0), day).alias("published_at"),
        F.when((n % 5 != 0) & (n % 2 == 1), day).alias("updated_at"),
        F.lit(None).cast("string").alias("created_at"),
        F.concat(F.lit(" Article "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("excerpt"),
    )
    return documents.news_feed(owner_docs(spark, d), posts)


# --- payloads, one per order ----------------------------------------------------------


def _payloads(spark, d):
    k = F.col("o_orderkey")
    ks = k.cast("string")
    fault = k % 8

    def body(overview, between):
        return F.concat(
            F.lit('{"overview": "'),
            overview,
            F.lit('", '),
            between,
            F.lit('"affiliations": "", "toll_free_specific": "'),
            F.when(k % 3 == 0, "No significant news found").otherwise(F.concat(F.lit("Spec "), ks)),
            F.lit('", "confidence": " '),
            F.col("o_orderpriority"),
            F.lit('", "recent_news": [{"date": "'),
            F.date_format("o_orderdate", "yyyy-MM-dd"),
            F.lit('", "title": " T'),
            ks,
            F.lit('", "source_domain": "d.example"}, {"title": " "}, "x"]}'),
        )

    overview = F.concat(F.lit("Order "), ks, F.lit(" of "), F.col("o_orderstatus"))
    clean = body(overview, F.lit(""))
    content = (
        F.when(fault == 0, clean)
        .when(fault == 1, F.concat(F.lit("```json\n"), clean, F.lit("\n```")))
        .when(fault == 2, body(overview, F.lit('"junk", ')))
        .when(fault == 3, body(overview, F.lit(", ")))
        .when(fault == 4, F.concat(clean, F.lit(" and that is all")))
        .when(fault == 5, "no payload at all")
        .when(fault == 6, '{"overview": "", "recent_news": []}')
        .otherwise(body(F.lit(""), F.lit("")))
    )
    return table(spark, d, "orders").select(k.alias("id"), content.alias("content"))


@query(
    "json_repair",
    """SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 2 THEN 'repaired' WHEN 3 THEN 'repaired' WHEN 4 THEN 'salvaged' WHEN 5 THEN 'failed' ELSE 'clean' END AS outcome FROM orders""",
)
def _(spark, d):
    return documents.parse_payload(_payloads(spark, d), "content").select("id", "outcome")


@query(
    "news_payload_normalise",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 <> 7 THEN 'Order ' || o_orderkey || ' of ' || o_orderstatus END AS overview, CAST(NULL AS VARCHAR) AS affiliations,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Spec ' || o_orderkey END AS specific, lower(o_orderpriority) AS confidence, CAST(1 AS BIGINT) AS n_news,
    'T' || o_orderkey AS first_title, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS first_date FROM orders WHERE o_orderkey % 8 NOT IN (5, 6)""",
)
def _(spark, d):
    rows = documents.normalise_payload(documents.parse_payload(_payloads(spark, d), "content"))
    return rows.select(
        "id",
        "overview",
        "affiliations",
        "specific",
        "confidence",
        F.size("news").alias("n_news"),
        F.get("news", F.lit(0))["title"].alias("first_title"),
        F.get("news", F.lit(0))["date"].alias("first_date"),
    )
