"""Matches of key suffixes with a dictionary of words.

dictionary: (digits, word, category, label, score, word_rank). Several words may share
one pattern, so joins fan out where the reports want every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.constants import (
    MISSING_RANK,
    NOTABLE_MAX_RANK,
    NOTABLE_MIN_SCORE,
    NOTABLE_SEGMENT,
    WORKING,
)


def working_keys(snapshot: DataFrame) -> DataFrame:
    return snapshot.where(F.col("status") == WORKING)


def patterns(dictionary: DataFrame) -> DataFrame:
    """Each pattern once, so that a join with it cannot multiply keys."""
    return dictionary.select("digits").distinct().withColumn("hit", F.lit(1))


def match_rate(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Working keys per owner and how many of them spell at least one word."""
    joined = keys.select("owner", "digits").join(patterns(dictionary), "digits", "left")
    sums = joined.groupBy("owner").agg(F.count("*").alias("working_count"), F.count("hit").alias("match_count"))
    return sums.withColumn("match_rate", F.col("match_count") / F.col("working_count"))


def match_rate_per_word(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same counted once per matching word: a key with two words counts twice."""
    words = dictionary.groupBy("digits").agg(F.count("*").alias("n_words"))
    joined = keys.select("owner", "digits").join(words, "digits", "left")
    rows = F.coalesce(F.col("n_words"), F.lit(1))
    return joined.groupBy("owner").agg(
        F.sum(rows).alias("working_count"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("match_count")
    )


AGE_BUCKETS = {
    # Limits in whole months, both included; None is open.
    "b_under_1m": (None, 0),
    "b_1_3m": (1, 2),
    "b_3_12m": (3, 11),
    "b_1_2y": (12, 23),
    "b_2_5y": (24, 59),
    "b_5y_plus": (60, None),
}


def _in_bucket(age: Column, low: int | None, high: int | None) -> Column:
    inside = F.lit(True)
    if low is not None:
        inside = inside & (age >= low)
    if high is not None:
        inside = inside & (age <= high)
    return inside


def age_buckets(keys: DataFrame) -> DataFrame:
    """(owner, age_months) to six counts and the median age, rounded half to even.

    The counts per (owner, age) are formed first: they are few, so the exact median works
    on a frequency table and not on a list of all keys of an owner.
    """
    freq = keys.groupBy("owner", "age_months").agg(F.count("*").alias("n"))
    median = F.expr("percentile(age_months, 0.5, n)")
    return freq.groupBy("owner").agg(
        *[
            F.coalesce(F.sum(F.when(_in_bucket(F.col("age_months"), *ends), F.col("n"))), F.lit(0)).alias(name)
            for name, ends in AGE_BUCKETS.items()
        ],
        F.rint(median).cast("int").alias("median_age_months"),
    )


def enrichment(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Match rate and age profile of every owner."""
    return match_rate(keys, dictionary).join(age_buckets(keys), "owner")


def boosted_score(segment: Column, score: Column) -> Column:
    """Score with the premium of the oldest segment."""
    factor = F.when(segment == NOTABLE_SEGMENT, 1.05).otherwise(1.0)
    return F.coalesce(score, F.lit(0.0)) * factor


def matches(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every pair of a key and a word it spells."""
    return keys.join(dictionary.where(F.col("word").isNotNull()), "digits")


def category_counts(matched: DataFrame) -> DataFrame:
    return (
        matched.where(F.col("category").isNotNull())
        .groupBy("owner", "category")
        .agg(F.max("label").alias("label"), F.count("*").alias("n"))
    )


def _best_first() -> list[Column]:
    rank = F.coalesce(F.col("word_rank"), F.lit(MISSING_RANK))
    return [F.desc(F.coalesce(F.col("score"), F.lit(0.0))), rank.asc(), F.col("key").asc(), F.col("word").asc()]


def top_hits(matched: DataFrame, k: int = 50) -> DataFrame:
    """The k best words of every owner. Spark keeps only k rows per owner and task before
    the shuffle, so a dominating owner does not end up whole in one task."""
    w = Window.partitionBy("owner").orderBy(*_best_first())
    return matched.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)


def top_words(matched: DataFrame, k: int = 60) -> DataFrame:
    """The k best keys per (owner, category), and per owner over all categories under
    category NULL."""
    scored = matched.withColumn("score", boosted_score(F.col("segment"), F.col("score"))).select(
        "owner", "category", "key", "word", "score", "word_rank"
    )
    # the two rankings as one: an 'all' copy of every row beside its own category
    own = F.struct(F.lit(False).alias("is_all"), F.col("category").alias("category"))
    every = F.struct(F.lit(True).alias("is_all"), F.lit(None).cast("string").alias("category"))
    lists = F.array_compact(F.array(every, F.when(F.col("category").isNotNull(), own)))
    rows = scored.withColumn("list", F.explode(lists)).select("owner", "list.*", "key", "word", "score", "word_rank")
    w = Window.partitionBy("owner", "is_all", "category").orderBy(*_best_first())
    best = rows.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)
    return best.select("owner", "category", "key", "word", "ord")


def best_word(dictionary: DataFrame) -> DataFrame:
    """One word per pattern: best score, then rank, then alphabet."""
    w = Window.partitionBy("digits").orderBy(
        F.desc(F.coalesce(F.col("score"), F.lit(0.0))),
        F.coalesce(F.col("word_rank"), F.lit(MISSING_RANK)),
        "word",
    )
    return dictionary.withColumn("n", F.row_number().over(w)).where(F.col("n") == 1).drop("n")


def notable(segment: Column, word: Column, rank: Column, score: Column) -> Column:
    """Worth a page of its own."""
    strong = (segment == NOTABLE_SEGMENT) & (F.coalesce(rank, F.lit(MISSING_RANK)) <= NOTABLE_MAX_RANK)
    high = F.coalesce(score, F.lit(0.0)) >= NOTABLE_MIN_SCORE
    return F.coalesce(word.isNotNull() & (word != "") & (strong | high), F.lit(False))


def digit_index_order(index: DataFrame) -> DataFrame:
    """Usable rows of the digit index with their place within the pattern, best first."""
    usable = index.where((F.col("term_length") == 7) & F.col("category").isNotNull())
    rank = F.when(F.coalesce(F.col("word_rank"), F.lit(0)) == 0, 1_000_000).otherwise(F.col("word_rank"))
    w = Window.partitionBy("digits").orderBy(F.desc(F.coalesce(F.col("relevance"), F.lit(0))), rank, "term")
    return usable.withColumn("ord", F.row_number().over(w))


def category_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Label of both category codes: the first falls back to its code, the second to NULL."""
    first = labels.select(F.col("code").alias("category"), F.col("label").alias("label_1"))
    second = labels.select(F.col("code").alias("category_2"), F.col("label").alias("label_2"))
    return (
        rows.join(first, "category", "left")
        .join(second, "category_2", "left")
        .withColumn("category_label", F.coalesce("label_1", "category"))
        .withColumn("category_label_2", F.col("label_2"))
        .drop("label_1", "label_2")
    )


def vendor_codes(manifest: DataFrame) -> DataFrame:
    """Five-character search code of each vendor; longer codes are found by their first five."""
    usable = manifest.where(F.length("vendor_code") >= 5)
    return usable.select(F.substring("vendor_code", 1, 5).alias("sub_owner"), "vendor_code").distinct()


def salable(adjusted: DataFrame, manifest: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Rows of vendors in a status that can be sold."""
    kept = adjusted.where(F.col("status").isin(*statuses))
    return kept.join(vendor_codes(manifest), "sub_owner")


def vendor_inventory(
    adjusted: DataFrame, manifest: DataFrame, index: DataFrame, labels: DataFrame, statuses: tuple[str, ...]
) -> DataFrame:
    """All category matches of every salable key; keys without a match stay with NULLs."""
    rows = salable(adjusted, manifest, statuses).withColumn("digits", F.substring("phone", F.lit(4), F.length("phone")))
    terms = digit_index_order(index).select("digits", "term", "category", "category_2", "relevance")
    joined = category_labels(rows.join(terms, "digits", "left"), labels)
    return joined.select(
        "phone",
        "vendor_code",
        F.substring("phone", 1, 3).alias("area_code"),
        "status",
        F.expr("try_cast(nullif(template, '') as int)").alias("age_months"),
        F.nullif(F.col("date"), F.lit("")).alias("first_used_date"),
        F.lit("adjusted").alias("source"),
        "term",
        F.col("category").alias("category_code"),
        "category_label",
        F.col("category_2").alias("category_code_2"),
        "category_label_2",
        "relevance",
    )


def lookup_table(adjusted: DataFrame, dictionary: DataFrame, scan_month: str) -> DataFrame:
    """Adjusted keys that spell a word, with the best word of their suffix."""
    best = best_word(dictionary).select("digits", "word", "category", "label", "word_rank", "score")
    rows = adjusted.withColumn("digits", F.substring("phone", F.lit(4), F.length("phone"))).join(best, "digits")
    return rows.select(
        F.col("phone").alias("digit_number"),
        F.concat_ws("-", F.substring("phone", 1, 3), F.col("word")).alias("word_form"),
        "status",
        F.coalesce("date", F.lit("")).alias("change_date"),
        F.trim(F.coalesce("sub_owner", F.lit(""))).alias("code"),
        F.lit(scan_month).alias("scan_month"),
        F.col("category").alias("category_code"),
        F.col("label").alias("category_label"),
        F.col("word_rank").alias("keyword_rank"),
        F.col("score").alias("value_score"),
        F.col("word").alias("term"),
        F.lit(None).cast("int").alias("is_new_disconn"),
        F.lit(None).cast("int").alias("is_new_transit"),
    )
