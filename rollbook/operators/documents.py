"""Mentions in texts, news feeds and payloads that carry JSON in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.fence import settled
from rollbook.functions.text import stripped

# Names too common to search for.
STOP_NAMES = (
    "?", "unknown", "secondary", "telecom", "communications", "international", "messaging",
    "regional phone company",
)

# Faults between the fields of a payload, each replaced by a comma.
PAYLOAD_FAULTS = (r',\s*"[^"]*"\s*,', r',\s*""\s*,', r",\s*,")

# Runs of word characters, and runs of other characters.
_WORDS = r"[\p{L}\p{N}_]+"
_RUNS = rf"{_WORDS}|[^\p{{L}}\p{{N}}_]+"


def needles(names: DataFrame, stop: Sequence[str] = STOP_NAMES) -> DataFrame:
    """(owner, needle) from title and alias: trimmed, lower, five characters or more."""
    flat = names.select("owner", F.explode(F.array("title", "alias")).alias("needle"))
    low = flat.select("owner", F.lower(F.trim("needle")).alias("needle"))
    return low.where((F.length("needle") >= 5) & ~F.col("needle").isin(*stop)).distinct()


def _anchored(wanted: DataFrame) -> DataFrame:
    """What to look for in place of each needle, by one of its runs, the anchor: the word that the
    fewest needles share (then the longest, the first), or the only run of one without a word.

    needle, anchor, behind (runs before the anchor), n (runs in all), first (the least place
    where the needle may begin) and beyond (runs that have to follow it): a needle that begins
    or ends with a run of other characters has a word beside it, as that run is a whole one.
    """
    cut = wanted.select("needle").distinct().withColumn("runs", F.regexp_extract_all("needle", F.lit(_RUNS), F.lit(0)))
    each = cut.select("needle", F.size("runs").alias("n"), F.posexplode("runs").alias("place", "run"))
    shared = each.withColumn("n_shared", F.count("*").over(Window.partitionBy("run"))).withColumn("word", F.col("run").rlike(f"^{_WORDS}"))
    best = F.max(F.struct("word", (-F.col("n_shared")).alias("rare"), F.length("run").alias("long"), (-F.col("place")).alias("early"), "run"))
    whole = shared.groupBy("needle", "n").agg(
        best.alias("best"),
        F.when(F.bool_or((F.col("place") == 0) & F.col("word")), 1).otherwise(2).alias("first"),
        F.when(F.bool_or((F.col("place") == F.col("n") - 1) & F.col("word")), 0).otherwise(1).alias("beyond"),
    )
    return whole.select("needle", F.col("best.run").alias("anchor"), (-F.col("best.early")).alias("behind"), "n", "first", "beyond")


def mention_search(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(owner, doc_id) for every text that mentions a needle between word boundaries.

    A text is a sequence of runs of word characters and runs of others. A needle stands in it
    between boundaries if and only if some stretch of whole runs equals the needle. So each text
    is cut into its runs once, an equi-join finds the runs that are the anchor of a needle, and
    only there the stretch around them is put together and compared. Names belong to owners
    and are few, so they are broadcast: texts are read once, and no run or text is shuffled.
    """
    # settled: otherwise the runs would be found again wherever they are used
    runs = settled(texts.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(_RUNS), F.lit(0)).alias("runs")))
    placed = runs.select("doc_id", "runs", F.posexplode("runs").alias("place", "run"))
    start = F.col("place") + 1 - F.col("behind")
    inside = (start >= F.col("first")) & (start + F.col("n") - 1 + F.col("beyond") <= F.size("runs"))
    # outside the text there is no start for slice
    stretch = F.array_join(F.slice("runs", F.greatest(start, F.lit(1)), F.col("n")), "")
    found = placed.join(F.broadcast(_anchored(wanted)), (F.col("run") == F.col("anchor")) & inside & (stretch == F.col("needle")))
    met = found.select("doc_id", "needle").distinct()
    return met.join(F.broadcast(wanted.select("owner", "needle")), "needle").select("owner", "doc_id").distinct()


def news_feed(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """Company news of all owners and own articles in one list, newest first, undated last.

    News name their source and their owner, articles their slug and their own address.
    """
    from rollbook.operators.directory import base_id

    names = {"date": "date", "title": "title", "snippet": "snippet", "source_domain": "sourceDomain", "source_url": "sourceUrl"}
    clean = {n: F.trim(F.coalesce(F.col(f"n.{field}"), F.lit(""))) for n, field in names.items()}
    none = F.lit(None).cast("string")
    owner = F.substring(F.upper(F.trim("code")), 1, 2)
    company = (
        docs.select(owner.alias("owner"), F.col("title").alias("owner_title"), F.explode("recentNews").alias("n"))
        .where(F.coalesce("owner", F.lit("")) != "")
        .select(F.lit("company-news").alias("kind"), *[c.alias(n) for n, c in clean.items()], "owner", "owner_title", none.alias("article_slug"))
    )
    article = posts.where(
        base_id(F.col("_id")).startswith("draft-article-")
        & ~F.coalesce("noindex", F.lit(False))
        & (F.trim(F.coalesce("slug", F.lit(""))) != "")
    ).select(
        F.lit("article").alias("kind"),
        F.substring(F.coalesce("published_at", "updated_at", "created_at", F.lit("")), 1, 10).alias("date"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.trim(F.coalesce("excerpt", F.lit(""))).alias("snippet"),
        none.alias("source_domain"),
        F.concat(F.lit("/article/"), F.trim("slug")).alias("source_url"),
        none.alias("owner"),
        none.alias("owner_title"),
        F.trim("slug").alias("article_slug"),
    )
    undated = F.when(F.col("date") == "", "0000-00-00").otherwise(F.col("date"))
    return company.unionByName(article).orderBy(F.desc(undated), "kind", "title")


# --- payloads -------------------------------------------------------------------------


def _with_object(rows: DataFrame, name: str, text: Column) -> DataFrame:
    """Add the JSON object of a text as a variant, NULL unless the text is exactly one object.

    The text is parsed inside brackets: junk behind the object then breaks the array, and
    a second object would make it longer. Texts without braces at both ends are not tried,
    since a failing parse costs far more than a good one.
    """
    body = stripped(text)
    likely = body.startswith("{") & body.endswith("}")
    wrapped = F.when(likely, F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    parsed = settled(rows.withColumn(name, wrapped))
    alone = F.try_variant_get(name, "$[1]", "variant").isNull()
    return parsed.withColumn(name, F.when(alone, F.try_variant_get(name, "$[0]", "variant")))


def without_fence(content: Column) -> Column:
    """Text without a surrounding code fence and its language word."""
    trimmed = stripped(content)
    inner = F.trim(trimmed, F.lit("`"))
    named = stripped(F.regexp_replace(inner, r"^\s*json", ""))
    fenced = F.when(inner.rlike(r"^\s*json"), named).otherwise(inner)
    return F.when(trimmed.startswith("```"), fenced).otherwise(trimmed)


def repaired(text: Column) -> Column:
    """Lone strings and doubled commas between fields taken out."""
    for fault in PAYLOAD_FAULTS:
        text = F.regexp_replace(text, fault, ",")
    return text


def parse_payload(rows: DataFrame, column: str) -> DataFrame:
    """Add parsed (a variant or NULL) and how it was won: clean, repaired, salvaged, failed."""
    staged = _with_object(rows.withColumn("clean_text", without_fence(F.col(column))), "v1", F.col("clean_text"))
    staged = _with_object(staged, "v2", F.when(F.col("v1").isNull(), repaired(F.col("clean_text"))))
    upto = F.regexp_extract(F.col(column), r"(?s)^(.*\})", 1)
    staged = _with_object(staged, "v3", F.when(F.col("v1").isNull() & F.col("v2").isNull(), upto))
    how = (
        F.when(F.col("v1").isNotNull(), "clean")
        .when(F.col("v2").isNotNull(), "repaired")
        .when(F.col("v3").isNotNull(), "salvaged")
        .otherwise("failed")
    )
    won = staged.withColumn("outcome", how).withColumn("parsed", F.coalesce("v1", "v2", "v3"))
    return settled(won.drop("clean_text", "v1", "v2", "v3"))


def normalise_payload(parsed: DataFrame) -> DataFrame:
    """Typed columns and the news items of each parsed payload; empty ones are dropped."""

    def text(path: str) -> Column:
        return F.trim(F.coalesce(F.try_variant_get("parsed", f"$.{path}", "string"), F.lit("")))

    items = F.coalesce(
        F.try_variant_get("parsed", "$.recent_news", "array<variant>"), F.array().cast("array<variant>")
    )

    def cell(item: Column, name: str) -> Column:
        return F.trim(F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit("")))

    news = F.filter(
        F.transform(
            items,
            lambda n: F.struct(
                *[cell(n, c).alias(c) for c in ("date", "title", "snippet", "source_domain", "source_url")]
            ),
        ),
        lambda s: s["title"] != "",
    )
    specific = text("toll_free_specific")
    others = [c for c in parsed.columns if c != "parsed"]
    rows = parsed.where(F.col("parsed").isNotNull()).select(
        *others,
        F.nullif(text("overview"), F.lit("")).alias("overview"),
        F.nullif(text("affiliations"), F.lit("")).alias("affiliations"),
        # Fixed value: the answer that stands for nothing found.
        F.when((specific != "") & (F.lower(specific) != "no significant news found"), specific).alias("specific"),
        F.nullif(F.lower(text("confidence")), F.lit("")).alias("confidence"),
        news.alias("news"),
    )
    return settled(rows).where(F.col("overview").isNotNull() | (F.size("news") > 0))
