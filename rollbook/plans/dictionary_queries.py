"""Dictionary matches, holdings and the tables sold or searched from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.constants import SALABLE_STATUSES, SEGMENTS
from rollbook.operators import dictionary as words
from rollbook.plans.base import (
    ADJUSTED_CTES,
    AGES_SQL,
    CURRENT_SQL,
    DICTIONARY_SQL,
    adjusted,
    current_keys,
    dictionary,
    key_ages,
    query,
    table,
    wide_suffix,
)
from rollbook.session import materialise, scratch_path
from rollbook.sources import sinks, tables

CUR = f"WITH{CURRENT_SQL},{DICTIONARY_SQL}\n"
AGE = f"WITH{AGES_SQL},{DICTIONARY_SQL}\n"


@query("scan_dictionary", f"WITH{DICTIONARY_SQL}\nSELECT * FROM dict")
def _(spark, d):
    """The dictionary written by someone else and read with the declared types."""
    path = scratch_path(spark, "dictionary")
    sinks.write_parquet(dictionary(spark, d), path)
    return tables.read_dictionary(spark, path)


@query(
    "age_buckets",
    AGE
    + """SELECT owner, count(*) FILTER (WHERE age_months < 1) AS b_under_1m, count(*) FILTER (WHERE age_months BETWEEN 1 AND 2) AS b_1_3m,
    count(*) FILTER (WHERE age_months BETWEEN 3 AND 11) AS b_3_12m, count(*) FILTER (WHERE age_months BETWEEN 12 AND 23) AS b_1_2y,
    count(*) FILTER (WHERE age_months BETWEEN 24 AND 59) AS b_2_5y, count(*) FILTER (WHERE age_months >= 60) AS b_5y_plus,
    CAST(round_even(median(age_months), 0) AS BIGINT) AS median_age_months FROM ages WHERE status = 1 GROUP BY 1""",
)
def _(spark, d):
    return words.age_buckets(words.working_keys(key_ages(spark, d)))


@query("median_age", AGE + "SELECT owner, CAST(round_even(median(age_months), 0) AS BIGINT) AS median_age_months FROM ages GROUP BY 1")
def _(spark, d):
    return words.age_buckets(key_ages(spark, d)).select("owner", "median_age_months")


@query(
    "dictionary_match_rate",
    AGE
    + """SELECT owner, count(*) AS working_count, count(hit) AS match_count, count(hit) / count(*) AS match_rate
    FROM (SELECT * FROM ages WHERE status = 1) a LEFT JOIN (SELECT DISTINCT digits, 1 AS hit FROM dict) USING (digits) GROUP BY 1""",
)
def _(spark, d):
    return words.match_rate(words.working_keys(key_ages(spark, d)), dictionary(spark, d))


@query(
    "dictionary_left_join",
    AGE
    + """SELECT owner, count(*) AS working_count, count(v.digits) AS match_count
    FROM (SELECT * FROM ages WHERE status = 1) a LEFT JOIN dict v ON a.digits = v.digits GROUP BY 1""",
)
def _(spark, d):
    """Counted once per word, as the plain left join has it."""
    return words.match_rate_per_word(words.working_keys(key_ages(spark, d)), dictionary(spark, d))


@query(
    "dictionary_inner_join",
    CUR + "SELECT c.key, c.owner, v.word, v.category FROM cur c JOIN dict v USING (digits) WHERE c.status = 1 AND word IS NOT NULL",
)
def _(spark, d):
    matched = words.matches(words.working_keys(current_keys(spark, d)), dictionary(spark, d))
    return matched.select("key", "owner", "word", "category")


@query(
    "dictionary_category_counts",
    CUR
    + """SELECT owner, category, max(label) AS label, count(*) AS n FROM cur JOIN dict USING (digits)
    WHERE status = 1 AND category IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, d):
    return words.category_counts(words.matches(words.working_keys(current_keys(spark, d)), dictionary(spark, d)))


@query(
    "topk_dictionary_hits",
    CUR
    + """SELECT owner, key, word, ord FROM (SELECT *, row_number() OVER (PARTITION BY owner
      ORDER BY coalesce(score, 0) DESC, coalesce(word_rank, 999999), key, word) AS ord FROM cur JOIN dict USING (digits)) WHERE ord <= 50""",
)
def _(spark, d):
    matched = words.matches(current_keys(spark, d), dictionary(spark, d))
    return words.top_hits(matched).select("owner", "key", "word", "ord")


@query(
    "topk_per_category",
    CUR.rstrip()
    + """,
m AS (SELECT *, coalesce(score, 0.0) * CASE WHEN segment = 800 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS boosted FROM cur JOIN dict USING (digits) WHERE status = 1)
SELECT * FROM (SELECT owner, CAST(NULL AS VARCHAR) AS category, key, word, row_number() OVER (PARTITION BY owner
    ORDER BY boosted DESC, coalesce(word_rank, 999999), key, word) AS ord FROM m) WHERE ord <= 60
UNION ALL SELECT * FROM (SELECT owner, category, key, word, row_number() OVER (PARTITION BY owner, category
    ORDER BY boosted DESC, coalesce(word_rank, 999999), key, word) FROM m WHERE category IS NOT NULL) t(owner, category, key, word, ord) WHERE ord <= 60""",
)
def _(spark, d):
    return words.top_words(words.matches(words.working_keys(current_keys(spark, d)), dictionary(spark, d)))


BEST_SQL = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY digits
  ORDER BY coalesce(score, 0) DESC, coalesce(word_rank, 999999), word) AS rn FROM dict) WHERE rn = 1)"""


@query("best_word_per_suffix", f"WITH{DICTIONARY_SQL},{BEST_SQL}\nSELECT * EXCLUDE (rn) FROM best")
def _(spark, d):
    return words.best_word(dictionary(spark, d))


@query("best_word_lookup", f"WITH{CURRENT_SQL},{DICTIONARY_SQL},{BEST_SQL}\nSELECT key, owner, word, score FROM cur JOIN best USING (digits)")
def _(spark, d):
    return current_keys(spark, d).join(words.best_word(dictionary(spark, d)), "digits").select("key", "owner", "word", "score")


@query(
    "notable_flag",
    f"""WITH{CURRENT_SQL},{DICTIONARY_SQL},{BEST_SQL}
SELECT key, coalesce(word IS NOT NULL AND ((segment = 800 AND coalesce(word_rank, 999999) <= 5000) OR coalesce(score, 0) >= 1000), false) AS is_notable
FROM cur LEFT JOIN best USING (digits)""",
)
def _(spark, d):
    rows = current_keys(spark, d).join(words.best_word(dictionary(spark, d)), "digits", "left")
    flag = words.notable(F.col("segment"), F.col("word"), F.col("word_rank"), F.col("score"))
    return rows.select("key", flag.alias("is_notable"))


# --- digit index, labels, vendors -----------------------------------------------------

INDEX_SQL = """
dindex AS (SELECT format('{:07d}', p_partkey) AS digits, upper(p_name) AS term, CASE WHEN p_size % 11 <> 0 THEN p_type END AS category,
  CASE WHEN p_size % 2 = 0 THEN p_brand END AS category_2, CAST(CASE WHEN p_size % 4 <> 0 THEN p_size END AS BIGINT) AS relevance,
  CAST(CASE WHEN p_size % 6 = 0 THEN 0 WHEN p_size % 6 <> 1 THEN p_size END AS BIGINT) AS word_rank, CAST(CASE WHEN p_size % 5 <> 0 THEN 7 ELSE 6 END AS BIGINT) AS term_length FROM part
  UNION ALL SELECT format('{:07d}', p_partkey), upper(p_brand), 'EXTRA', NULL, CAST(p_size % 3 AS BIGINT), CAST(p_size AS BIGINT), 7 FROM part WHERE p_size % 3 = 0),
labs AS (SELECT DISTINCT p_type AS code, 'Kind ' || p_type AS label FROM part WHERE p_type <> 'ECONOMY'
  UNION SELECT DISTINCT p_brand, 'Brand ' || p_brand FROM part WHERE p_brand <> 'Brand#2'),
dio AS (SELECT *, row_number() OVER (PARTITION BY digits ORDER BY coalesce(relevance, 0) DESC, CASE WHEN coalesce(word_rank, 0) = 0 THEN 1000000 ELSE word_rank END, term) AS ord
  FROM dindex WHERE term_length = 7 AND category IS NOT NULL),
vend AS (SELECT DISTINCT substr(vendor_code, 1, 5) AS sub_owner, vendor_code FROM (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0')
  || CASE WHEN s_suppkey % 10 = 0 THEN 'F' ELSE '' END AS vendor_code FROM supplier WHERE s_acctbal > 2000 UNION SELECT 'X1'))"""


def _digit_index(spark, d):
    part = table(spark, d, "part")
    size = F.col("p_size")
    digits = wide_suffix(F.col("p_partkey")).alias("digits")
    main = part.select(
        digits,
        F.upper("p_name").alias("term"),
        F.when(size % 11 != 0, F.col("p_type")).alias("category"),
        F.when(size % 2 == 0, F.col("p_brand")).alias("category_2"),
        F.when(size % 4 != 0, size).cast("long").alias("relevance"),
        F.when(size % 6 == 0, 0).when(size % 6 != 1, size).cast("long").alias("word_rank"),
        F.when(size % 5 != 0, 7).otherwise(6).cast("long").alias("term_length"),
    )
    extra = part.where(size % 3 == 0).select(
        digits,
        F.upper("p_brand").alias("term"),
        F.lit("EXTRA").alias("category"),
        F.lit(None).cast("string").alias("category_2"),
        (size % 3).cast("long").alias("relevance"),
        size.cast("long").alias("word_rank"),
        F.lit(7).cast("long").alias("term_length"),
    )
    return main.unionByName(extra)


def _labels(spark, d):
    part = table(spark, d, "part")
    kinds = part.where(F.col("p_type") != "ECONOMY").select(
        F.col("p_type").alias("code"), F.concat(F.lit("Kind "), "p_type").alias("label")
    )
    brands = part.where(F.col("p_brand") != "Brand#2").select(
        F.col("p_brand").alias("code"), F.concat(F.lit("Brand "), "p_brand").alias("label")
    )
    return kinds.unionByName(brands).distinct()


def _manifest(spark, d):
    supplier = table(spark, d, "supplier").where(F.col("s_acctbal") > 2000)
    code = F.concat(
        F.lpad(F.col("s_nationkey").cast("string"), 2, "0"),
        F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"),
        F.when(F.col("s_suppkey") % 10 == 0, "F").otherwise(""),
    )
    return supplier.select(code.alias("vendor_code"))


@query("digit_index_order", f"WITH{INDEX_SQL}\nSELECT * FROM dio")
def _(spark, d):
    return words.digit_index_order(_digit_index(spark, d))


@query(
    "multi_category_lookup",
    f"""WITH{CURRENT_SQL},{INDEX_SQL}
SELECT c.key, o.term, o.category, o.ord FROM cur c LEFT JOIN dio o USING (digits)""",
)
def _(spark, d):
    index = words.digit_index_order(_digit_index(spark, d)).select("digits", "term", "category", "ord")
    return current_keys(spark, d).join(index, "digits", "left").select("key", "term", "category", "ord")


@query(
    "label_join",
    f"""WITH{INDEX_SQL}
SELECT digits, term, category, category_2, coalesce(a.label, category) AS category_label, b.label AS category_label_2
FROM dio LEFT JOIN labs a ON a.code = category LEFT JOIN labs b ON b.code = category_2""",
)
def _(spark, d):
    rows = words.digit_index_order(_digit_index(spark, d)).select("digits", "term", "category", "category_2")
    return words.category_labels(rows, _labels(spark, d))


SALABLE_SQL = "sal AS (SELECT adj.*, vendor_code FROM adj JOIN vend USING (sub_owner) WHERE status IN ('WORKING', 'FEATURE', 'REQUEST', 'RESERVED'))"


@query(
    "salable_vendor_filter",
    f"WITH{ADJUSTED_CTES},{INDEX_SQL},\n{SALABLE_SQL}\nSELECT phone, status, sub_owner, vendor_code FROM sal",
)
def _(spark, d):
    rows = words.salable(adjusted(spark, d), _manifest(spark, d), SALABLE_STATUSES)
    return rows.select("phone", "status", "sub_owner", "vendor_code")


@query(
    "vendor_inventory",
    f"""WITH{ADJUSTED_CTES},{INDEX_SQL},
{SALABLE_SQL}
SELECT phone, vendor_code, substr(phone, 1, 3) AS area_code, status, CAST(TRY_CAST(nullif(template, '') AS INTEGER) AS BIGINT) AS age_months,
  nullif(date, '') AS first_used_date, 'adjusted' AS source, term, category AS category_code, coalesce(a.label, category) AS category_label,
  category_2 AS category_code_2, b.label AS category_label_2, relevance
FROM sal LEFT JOIN dio ON substr(phone, 4) = digits LEFT JOIN labs a ON a.code = category LEFT JOIN labs b ON b.code = category_2""",
)
def _(spark, d):
    return words.vendor_inventory(
        adjusted(spark, d), _manifest(spark, d), _digit_index(spark, d), _labels(spark, d), SALABLE_STATUSES
    )


LOOKUP_SQL = f"""WITH{ADJUSTED_CTES},{DICTIONARY_SQL},{BEST_SQL},
lk AS (SELECT phone AS digit_number, substr(phone, 1, 3) || '-' || word AS word_form, status, date AS change_date, trim(sub_owner) AS code,
  '2026-05' AS scan_month, category AS category_code, label AS category_label, word_rank AS keyword_rank, score AS value_score, word AS term,
  CAST(NULL AS BIGINT) AS is_new_disconn, CAST(NULL AS BIGINT) AS is_new_transit FROM adj JOIN best ON substr(phone, 4) = digits)
"""


@query("lookup_build", LOOKUP_SQL + "SELECT * FROM lk")
def _(spark, d):
    return words.lookup_table(adjusted(spark, d), dictionary(spark, d), "2026-05")


@query(
    "sink_lookup_table",
    LOOKUP_SQL + "SELECT *, right(digit_number, 4) AS last4, right(digit_number, 5) AS last5, right(digit_number, 6) AS last6 FROM lk",
)
def _(spark, d):
    path = scratch_path(spark, "lookup")
    sinks.write_lookup(words.lookup_table(adjusted(spark, d), dictionary(spark, d), "2026-05"), path)
    return spark.read.parquet(f"{path}/tail").drop("tail")


#: Whole numbers of all segments, and suffixes of four, five and six digits.
SEARCHED = [*[f"{s}0000{n:03d}" for s in SEGMENTS for n in (17, 96, 108)], "0012", "00123", "000077"]


@query(
    "lookup_search",
    LOOKUP_SQL
    + f"""SELECT *, right(digit_number, 4) AS last4, right(digit_number, 5) AS last5, right(digit_number, 6) AS last6 FROM lk
    WHERE digit_number IN ({", ".join(f"'{w}'" for w in SEARCHED if len(w) == 10)}) OR right(digit_number, 4) = '0012'
      OR right(digit_number, 5) = '00123' OR right(digit_number, 6) = '000077'""",
)
def _(spark, d):
    """A table of two months, searched for one of them."""
    path, rows = scratch_path(spark, "lookup"), materialise(words.lookup_table(adjusted(spark, d), dictionary(spark, d), "2026-05"), "month")
    sinks.write_lookup(rows.unionByName(rows.withColumn("scan_month", F.lit("2026-04"))), path)
    return sinks.search_lookup(spark, path, "2026-05", SEARCHED)
