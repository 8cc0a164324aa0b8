"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rollbook.llm import bpe, decontaminate, filter_audit, license_scan, minhash, order_minhash, packing, pii, secret_scan, site_style, suffix_dedup, toxicity, variants
from rollbook.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(f):
    QUERIES[f.__name__] = f
    return f


def twin(name: str, sql: str) -> None:
    ORACLE[name] = sql


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints_with_next(table(spark, sf_dir, "documents"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op4_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.judged(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


@query
def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(table(spark, sf_dir, "pages"))


@query
def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


@query
def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.extract(table(spark, sf_dir, "documents")))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.words(table(spark, sf_dir, "documents"), noise=31))


twin(
    "op11_spelling_variants",
    r"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{7,}')) AS run
        FROM documents
    ), found AS (
        SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run
    ), spelled AS (
        SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM found
    ), bytes AS (
        SELECT run, n, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM spelled
    ), bits AS (
        SELECT run, n, flatten(list_transform(bytes, lambda b: list_transform(range(8), lambda k: (b >> k) & 1))) AS bits FROM bytes
    ), hashed AS (
        SELECT run, n, xor(4294967295::BIGINT, list_reduce(
            list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1)))) AS h
        FROM bits
    ), noisy AS (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
        FROM hashed
    ), words AS (
        SELECT word, sum(n)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), holes AS (
        SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), shorter AS (
        SELECT DISTINCT h.word AS longer, h.n AS n, w.word AS shorter, w.n AS m FROM holes h JOIN words w ON h.rest = w.word
    ), near AS (
        SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION ALL SELECT longer, shorter, m FROM shorter
        UNION ALL SELECT shorter, longer, n FROM shorter
    ), ranked AS (
        SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r FROM near
    ), judged AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
        FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1
    ), ways AS (
        SELECT word, word AS here FROM judged
        UNION ALL SELECT ways.word, j.form FROM ways JOIN judged j ON ways.here = j.word WHERE j.form IS NOT NULL
    ), ends AS (
        SELECT ways.word, here AS root FROM ways JOIN judged j ON ways.here = j.word WHERE j.form IS NULL
    )
    SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
    """,
)


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), filter_audit.sample_fails, 4)
    return filter_audit.audit(counted, "ABCDE")


twin(
    "op12_filter_audit",
    r"""
    WITH texts AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
    ), counted AS (
        SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            min(doc_id) OVER (PARTITION BY t) AS least
        FROM texts
    ), failed AS (
        SELECT doc_id, part,
            CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN least < doc_id THEN 'E' ELSE '' END AS f
        FROM counted
    ), marked AS (
        SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
    ), masks AS (
        SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
        FROM failed LEFT JOIN marked USING (doc_id) GROUP BY part, f
    ), letters AS (
        SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
    ), orders AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
        FROM letters a
        JOIN letters b ON b.x <> a.x
        JOIN letters c ON c.x NOT IN (a.x, b.x)
        JOIN letters d ON d.x NOT IN (a.x, b.x, c.x)
        JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)
    ), steps AS (
        SELECT filter_order, step::INTEGER AS step, substr(filter_order, step, 1) AS x, substr(filter_order, 1, step - 1) AS before
        FROM orders, range(1, 6) AS r(step)
    ), told AS (
        SELECT part, filter_order, step, x,
            contains(f, x) AS fails, translate(f, before, '') = f AS reached, f = x AS only_x, n, good, toxic
        FROM masks, steps
    ), summed AS (
        SELECT part, filter_order, step, x,
            coalesce(sum(n) FILTER (WHERE reached AND NOT fails), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (WHERE reached AND fails), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (WHERE NOT reached AND fails), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (WHERE only_x), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (WHERE reached AND fails), 0)::BIGINT AS good_lost,
            coalesce(sum(toxic) FILTER (WHERE reached AND fails), 0)::BIGINT AS toxic_lost
        FROM told GROUP BY part, filter_order, step, x
    )
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
    FROM summed
    """,
)


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digests(license_scan.scan(table(spark, sf_dir, "documents")))
