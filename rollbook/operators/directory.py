"""Directory documents about owners, and roll-ups along their categories and groups.

An owner code has two characters, so tables with one row per owner hold at most 1,296 rows
(36 * 36). That bound, not a guess, is why such tables, and those with one row per owner and
curated category or group, may be broadcast below.

docs: (doc_no, _id, title, alias, code, slug, website, address, categories, groups, ...)
where categories and groups are arrays of structs with a _ref.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.constants import DISC_NODE, DORMANT_MAX, META_SLUGS, SPARE_NODE, WORKING
from rollbook.session import materialise

_REF = T.ArrayType(T.StructType([T.StructField("_ref", T.StringType())]))
DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_no", T.LongType()),
        T.StructField("_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("alias", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("slug", T.StructType([T.StructField("current", T.StringType())])),
        T.StructField("website", T.StringType()),
        T.StructField(
            "address",
            T.StructType([T.StructField(n, T.StringType()) for n in ("street1", "city", "state", "country")]),
        ),
        T.StructField("categories", _REF),
        T.StructField("groups", _REF),
    ]
)


def read_directory(spark, path: str) -> DataFrame:
    """Documents from JSON files that each hold one array, with a declared schema. A file that is
    no JSON is one row with its text in `corrupt`."""
    schema = T.StructType([*DOC_SCHEMA.fields, T.StructField("corrupt", T.StringType())])
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")


def parse_directory(lines: DataFrame) -> DataFrame:
    """Documents from one JSON text per row in column value."""
    return lines.select(F.from_json("value", DOC_SCHEMA).alias("d")).select("d.*")


def owner_of(code: Column) -> Column:
    """Owner of a document's code, NULL when the code is too short."""
    clean = F.upper(F.trim(code))
    return F.when(F.length(clean) >= 2, F.substring(clean, 1, 2))


def base_id(doc_id: Column) -> Column:
    return F.regexp_replace(doc_id, r"^drafts\.", "")


def latest_version(docs: DataFrame) -> DataFrame:
    """One document per base id, published before draft. At most two versions exist of each."""
    draft = F.col("_id").startswith("drafts.")
    w = Window.partitionBy(base_id(F.col("_id"))).orderBy(draft, "doc_no")
    return docs.withColumn("n", F.row_number().over(w)).where(F.col("n") == 1).drop("n")


def dedupe_summary(docs: DataFrame) -> DataFrame:
    draft = F.col("_id").startswith("drafts.")
    per_id = docs.groupBy(base_id(F.col("_id")).alias("id")).agg(
        F.max((~draft).cast("int")).alias("published"), F.max(draft.cast("int")).alias("draft")
    )
    return per_id.agg(
        F.count("*").alias("total_unique"),
        F.count_if((F.col("published") == 1) & (F.col("draft") == 0)).alias("published_only"),
        F.count_if((F.col("published") == 0) & (F.col("draft") == 1)).alias("draft_only"),
        F.count_if((F.col("published") == 1) & (F.col("draft") == 1)).alias("both"),
    )


def explode_refs(docs: DataFrame, array: str) -> DataFrame:
    """(doc_no, owner, ref), one row per reference of a document with a usable code."""
    rows = docs.select("doc_no", owner_of(F.col("code")).alias("owner"), F.explode(array).alias("r"))
    return rows.where(F.col("owner").isNotNull()).select("doc_no", "owner", F.col("r._ref").alias("ref"))


def doc_membership(docs: DataFrame, dim: DataFrame, array: str) -> DataFrame:
    """(owner, slug, title) of every resolvable reference, each pair once.

    dim is (id, slug, title): the curated list of categories or groups.
    """
    refs = explode_refs(docs, array).select("owner", "ref").distinct()
    return refs.join(dim.withColumnRenamed("id", "ref"), "ref").select("owner", "slug", "title").distinct()


def public_membership(
    docs: DataFrame,
    dim: DataFrame,
    categories: DataFrame,
    array: str,
    *,
    hidden_slugs: Sequence[str],
) -> DataFrame:
    """The same without synthetic owners and without documents tagged hidden.

    Skipping is by document, so an owner keeps what its other documents say.
    """
    hidden_refs = categories.where(F.col("slug").isin(*hidden_slugs)).select(F.col("id").alias("ref"))
    tagged = explode_refs(docs, "categories").join(hidden_refs, "ref", "left_semi").select("doc_no").distinct()
    seen = docs.where(~F.upper(F.trim("code")).startswith("1")).join(tagged, "doc_no", "left_anti")
    return doc_membership(seen, dim, array)


def hidden_owners(
    docs: DataFrame,
    categories: DataFrame,
    override: Sequence[str] = (),
    *,
    hidden_slugs: Sequence[str],
) -> DataFrame:
    """Owners named by the override list, by the synthetic code rule or by a hidden tag."""
    spark = docs.sparkSession
    owners = docs.select(owner_of(F.col("code")).alias("owner")).where(F.col("owner").isNotNull())
    synthetic = owners.where(F.col("owner").startswith("1"))
    hidden_refs = categories.where(F.col("slug").isin(*hidden_slugs)).select(F.col("id").alias("ref"))
    tagged = explode_refs(docs, "categories").join(hidden_refs, "ref", "left_semi").select("owner")
    named = spark.createDataFrame([(o,) for o in override], "owner string")
    return synthetic.unionByName(tagged).unionByName(named).distinct()


def hidden_filter(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(hidden), "owner", "left_anti")


def first_docs(docs: DataFrame) -> DataFrame:
    """The first document of every owner."""
    keep = [c for c in docs.columns if c != "doc_no"]
    first = (
        docs.withColumn("owner", owner_of(F.col("code")))
        .where(F.col("owner").isNotNull())
        .groupBy("owner")
        .agg(F.min_by(F.struct(*keep), "doc_no").alias("d"), F.min("doc_no").alias("doc_no"))
    )
    return first.select("owner", "doc_no", "d.*")


def directory_filter(
    docs: DataFrame,
    categories: DataFrame,
    category: str | None = None,
    hidden: str | None = None,
    text: str | None = None,
    *,
    hidden_slugs: Sequence[str],
) -> DataFrame:
    """First document per owner, narrowed by category slug, hidden 'yes'/'no' and a text."""
    first = first_docs(docs)
    tags = (
        explode_refs(docs, "categories")
        .join(categories.select(F.col("id").alias("ref"), F.col("slug").alias("cat")), "ref")
        .groupBy("doc_no")
        .agg(F.sort_array(F.collect_set("cat")).alias("category_slugs"))
    )
    rows = first.join(tags, "doc_no", "left").withColumn(
        "category_slugs", F.coalesce("category_slugs", F.array().cast("array<string>"))
    )
    is_hidden = F.arrays_overlap("category_slugs", F.array(*[F.lit(s) for s in hidden_slugs])) | F.col(
        "owner"
    ).startswith("1")
    rows = rows.withColumn("is_hidden", is_hidden)
    if category:
        rows = rows.where(F.array_contains("category_slugs", category))
    if hidden in ("yes", "no"):
        rows = rows.where(F.col("is_hidden") if hidden == "yes" else ~F.col("is_hidden"))
    if text:
        blob = F.concat_ws(" ", F.coalesce("title", F.lit("?")), F.coalesce("alias", F.lit("")), "code")
        rows = rows.where(F.lower(blob).contains(text.lower()))
    return rows


def directory_search(
    docs: DataFrame, categories: DataFrame, groups: DataFrame, hidden: DataFrame, text: str
) -> DataFrame:
    """Owners, groups and categories whose name contains the text: (kind, id, title)."""
    needle = text.lower()

    def has(column: str) -> Column:
        return F.coalesce(F.lower(F.col(column)).contains(needle), F.lit(False))

    found = docs.where(has("title") | has("alias") | has("code"))
    owners = hidden_filter(first_docs(found), hidden).select(
        F.lit("owner").alias("kind"), F.col("owner").alias("id"), "title"
    )

    def named(dim: DataFrame, kind: str) -> DataFrame:
        return dim.where(has("title")).select(F.lit(kind).alias("kind"), F.col("slug").alias("id"), "title")

    return owners.unionByName(named(groups, "group")).unionByName(named(categories, "category"))


def own_website(website: Column, own: Sequence[str]) -> Column:
    """The website unless it leads back to one of our own domains."""
    leads_back = F.lit(False)
    for domain in own:
        leads_back = leads_back | F.lower(website).contains(domain)
    return F.when(~leads_back, website)


def enrichment_eligible(docs: DataFrame, categories: DataFrame, skip_titles: Sequence[str], done: DataFrame) -> DataFrame:
    """Documents with a website, outside the skipped categories, not processed yet."""
    skip = categories.where(F.col("title").isin(*skip_titles)).select(F.col("id").alias("ref"))
    refs = docs.select("doc_no", F.explode("categories").alias("r")).select("doc_no", F.col("r._ref").alias("ref"))
    skipped = refs.join(skip, "ref", "left_semi").select("doc_no").distinct()
    sited = docs.where(F.coalesce("website", F.lit("")) != "")
    return sited.join(skipped, "doc_no", "left_anti").join(done.select("_id"), "_id", "left_anti")


def owner_resolution(docs: DataFrame, categories: DataFrame, groups: DataFrame) -> DataFrame:
    """Title of the first document and all categories and groups of every owner."""

    def slugs(dim: DataFrame, array: str, name: str) -> DataFrame:
        return doc_membership(docs, dim, array).groupBy("owner").agg(F.sort_array(F.collect_set("slug")).alias(name))

    first = first_docs(docs).select("owner", "title", "alias")
    none = F.array().cast("array<string>")
    return (
        first.join(slugs(categories, "categories", "category_slugs"), "owner", "left")
        .join(slugs(groups, "groups", "group_slugs"), "owner", "left")
        .withColumn("category_slugs", F.coalesce("category_slugs", none))
        .withColumn("group_slugs", F.coalesce("group_slugs", none))
    )


def owner_names(docs: DataFrame, group_titles: DataFrame) -> DataFrame:
    """(owner, name, display): display adds the groups in brackets unless they are the name.

    group_titles is (owner, title). A group named by several documents counts once.
    """
    names = first_docs(docs).select("owner", F.coalesce("title", "owner").alias("name"))
    titles = group_titles.groupBy("owner").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    joined = names.join(titles, "owner", "left")
    own = F.lower("name")
    others = F.filter("titles", lambda t: F.lower(t) != own)
    bracket = F.concat(F.col("name"), F.lit(" ("), F.array_join(others, ", "), F.lit(")"))
    return joined.select("owner", "name", F.when(F.size(others) > 0, bracket).otherwise(F.col("name")).alias("display"))


def partner_names(rows: DataFrame, names: DataFrame, column: str = "partner") -> DataFrame:
    """Add the display name of an edge end; the pool nodes and unknown owners keep their code."""
    lookup = names.select(F.col("owner").alias(column), F.col("display").alias("partner_name"))
    joined = rows.join(F.broadcast(lookup), column, "left")
    plain = F.col(column).isin(DISC_NODE, SPARE_NODE) | F.col("partner_name").isNull()
    return joined.withColumn("partner_name", F.when(plain, F.col(column)).otherwise(F.col("partner_name")))


def directory_gap(snapshot: DataFrame, docs: DataFrame, samples: int = 5) -> DataFrame:
    """Owners in the data that no document covers, with counts and a few of their codes."""
    covered = docs.select(owner_of(F.col("code")).alias("owner")).where(F.col("owner").isNotNull()).distinct()
    codes = (
        snapshot.join(F.broadcast(covered), "owner", "left_anti")
        .groupBy("owner", "sub_owner")
        .agg(*_status_counts())
    )
    names = ("inventory", "working", "transit", "disconn")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.asc_nulls_last("sub_owner")))
    few = F.when(F.col("place") <= samples, F.col("sub_owner"))
    # only the first codes of an owner are collected
    return codes.withColumn("place", place).groupBy("owner").agg(
        *[F.sum(n).alias(n) for n in names], F.sort_array(F.collect_list(few)).alias("sample_codes")
    )


def _status_counts() -> list[Column]:
    return [
        F.count("*").alias("inventory"),
        F.count_if(F.col("status") == 1).alias("working"),
        F.count_if(F.col("status") == 2).alias("transit"),
        F.count_if(F.col("status") == 3).alias("disconn"),
    ]


def directory_coverage(snapshot: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents, owners covered, owners with several, and what the data has beyond."""
    per_owner = (
        docs.select(owner_of(F.col("code")).alias("owner"))
        .where(F.col("owner").isNotNull())
        .groupBy("owner")
        .agg(F.count("*").alias("n_docs"))
    )
    held = snapshot.groupBy("owner").agg(F.count("*").alias("inventory"))
    both = per_owner.join(held, "owner", "full")
    missing = F.col("n_docs").isNull()
    lost = F.sum(F.when(missing, F.col("inventory")).otherwise(0))
    return both.agg(
        F.sum(F.coalesce("n_docs", F.lit(0))).alias("n_docs"),
        F.count("n_docs").alias("n_owners"),
        F.count_if(F.col("n_docs") > 1).alias("n_multi"),
        F.count_if(missing).alias("n_missing"),
        lost.alias("missing_inventory"),
        (lost / F.sum("inventory")).alias("missing_share"),
    )


# --- roll-ups along a membership ------------------------------------------------------


def member_trajectory(rollup: DataFrame, membership: DataFrame, by: str) -> DataFrame:
    """Inventory per category or group and period; an owner counts once in each."""
    members = membership.select("owner", by).distinct()
    return rollup.join(F.broadcast(members), "owner").groupBy(by, "period").agg(F.sum("inventory").alias("inventory"))


def member_series(rollup: DataFrame, membership: DataFrame, by: str) -> DataFrame:
    """Six sums per category or group and period."""
    members = membership.select("owner", by).distinct()
    return rollup.join(F.broadcast(members), "owner").groupBy(by, "period").agg(
        F.sum("inventory").alias("inventory"),
        F.sum("acquired").alias("acquired"),
        F.sum("lost").alias("lost"),
        F.sum("harvested_cross_owner").alias("harvested"),
        F.sum("appeared_from_spare").alias("from_spare"),
        F.sum("disappeared_to_spare").alias("to_spare"),
    )


def members_only(rows: DataFrame, membership: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(membership.select("owner").distinct()), "owner", "left_semi")


def category_summary(rollup: DataFrame, membership: DataFrame) -> DataFrame:
    """Start, end, change and cumulative flows per category over the whole span."""
    members = membership.select("owner", "category").distinct()
    per_period = (
        rollup.join(F.broadcast(members), "owner", "left")
        .groupBy(F.coalesce("category", F.lit("(uncategorized)")).alias("category"), "period")
        .agg(
            F.sum("inventory").alias("inventory"),
            F.sum("harvested_cross_owner").alias("harvested"),
            F.sum("acquired").alias("acquired"),
        )
    )
    every = Window.partitionBy()
    edges = per_period.withColumn("first", F.min("period").over(every)).withColumn("last", F.max("period").over(every))

    def at(edge: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("period") == F.col(edge), F.col("inventory"))), F.lit(0))

    sums = edges.groupBy("category").agg(
        at("first").alias("start"),
        at("last").alias("end"),
        F.sum("harvested").alias("harvested"),
        F.sum("acquired").alias("acquired"),
    )
    delta = F.col("end") - F.col("start")
    zero = F.lit(0.0)
    return (
        sums.withColumn("delta", delta)
        .withColumn("pct", F.coalesce(delta / F.nullif(F.col("start"), F.lit(0)) * 100, zero))
        .withColumn("opportunism", F.coalesce(F.col("harvested") / F.nullif(F.col("acquired"), F.lit(0)), zero))
    )


def group_summary(inventory: DataFrame, rollup: DataFrame, membership: DataFrame, by: str = "group") -> DataFrame:
    """Members, inventory and index per group; groups without members do not occur."""
    members = membership.select(by, "owner").distinct()
    flows = rollup.groupBy("owner").agg(
        F.sum("acquired").alias("acquired"), F.sum("harvested_cross_owner").alias("harvested")
    )
    joined = members.join(inventory, "owner", "left").join(flows, "owner", "left")
    sums = joined.groupBy(by).agg(
        F.count("*").alias("members"),
        F.coalesce(F.sum("inventory"), F.lit(0)).alias("inventory"),
        F.coalesce(F.sum("acquired"), F.lit(0)).alias("acquired"),
        F.coalesce(F.sum("harvested"), F.lit(0)).alias("harvested"),
    )
    index = F.col("harvested") / F.nullif(F.col("acquired"), F.lit(0))
    return sums.withColumn("opportunism", F.coalesce(index, F.lit(0.0)))


def group_validation(inventory: DataFrame, membership: DataFrame) -> DataFrame:
    """Groups with two or more owners, their combined inventory and the sorted owners."""
    members = membership.select("group", "owner").distinct().join(inventory, "owner", "left")
    sums = members.groupBy("group").agg(
        F.count("*").alias("members"),
        F.coalesce(F.sum("inventory"), F.lit(0)).alias("inventory"),
        F.sort_array(F.collect_set("owner")).alias("owners"),
    )
    return sums.where(F.col("members") >= 2)


def category_index(inventory: DataFrame, enrichment: DataFrame, membership: DataFrame) -> DataFrame:
    """Members, inventory, match rate and share of each category."""
    members = membership.select("category", "owner").distinct()
    joined = members.join(inventory, "owner", "left").join(enrichment, "owner", "left")
    sums = joined.groupBy("category").agg(
        F.count("*").alias("members"),
        F.coalesce(F.sum("inventory"), F.lit(0)).alias("inventory"),
        (F.sum("match_count") / F.nullif(F.sum("working_count"), F.lit(0))).alias("match_rate"),
    )
    return sums.withColumn("share", F.col("inventory") / F.sum("inventory").over(Window.partitionBy()))


def group_rank(inventory: DataFrame, membership: DataFrame) -> DataFrame:
    """Place of each group by combined inventory and its size against the largest.

    Groups whose members hold nothing are ranked with 0.
    """
    members = membership.select("group", "owner").distinct()
    sums = members.join(inventory, "owner", "left").groupBy("group").agg(
        F.coalesce(F.sum("inventory"), F.lit(0)).alias("inventory")
    )
    every = Window.partitionBy()
    return sums.select(
        "group",
        "inventory",
        F.row_number().over(Window.orderBy(F.desc("inventory"), "group")).alias("rank"),
        F.count("*").over(every).alias("total"),
        (F.col("inventory") / F.nullif(F.max("inventory").over(every), F.lit(0))).alias("pct"),
    )


def sibling_inventory(rollup: DataFrame, membership: DataFrame, prev: Column, curr: Column) -> DataFrame:
    """Inventory of every group member in two periods; 0 where it is missing."""
    at = rollup.groupBy("owner").agg(
        F.max(F.when(F.col("period") == prev, F.col("inventory"))).alias("prev_inventory"),
        F.max(F.when(F.col("period") == curr, F.col("inventory"))).alias("curr_inventory"),
    )
    joined = membership.select("group", "owner").distinct().join(at, "owner", "left").na.fill(0)
    return joined.withColumn("delta", F.col("curr_inventory") - F.col("prev_inventory"))


def members_listing(inventory: DataFrame, enrichment: DataFrame, membership: DataFrame, by: str) -> DataFrame:
    """Members with inventory, match rate, age and a circle size by the root of inventory."""
    rows = (
        membership.select(by, "owner")
        .distinct()
        .join(inventory, "owner", "left")
        .join(enrichment.select("owner", "match_rate", "median_age_months"), "owner", "left")
        .na.fill(0, ["inventory"])
    )
    largest = F.max("inventory").over(Window.partitionBy(by))
    ratio = F.coalesce(F.sqrt(F.col("inventory") / F.nullif(largest, F.lit(0))), F.lit(0.0))
    # Circles are 30 to 120 pixels wide.
    return rows.withColumn("size", F.floor(30 + ratio * 90).cast("int"))


def directory_listing(inventory: DataFrame, enrichment: DataFrame, names: DataFrame, hidden: DataFrame) -> DataFrame:
    """All visible owners with inventory, match rate and median age."""
    rows = hidden_filter(inventory, hidden).join(names.select("owner", "name"), "owner", "left")
    facts = enrichment.select("owner", "match_rate", "median_age_months")
    return rows.join(facts, "owner", "left").withColumn("name", F.coalesce("name", F.lit("(not in directory)")))


def category_members(inventory: DataFrame, rollup: DataFrame, membership: DataFrame) -> DataFrame:
    """Members of every category with inventory and all-time index."""
    flows = rollup.groupBy("owner").agg(
        F.sum("acquired").alias("acquired"), F.sum("harvested_cross_owner").alias("harvested")
    )
    rows = membership.select("category", "owner").distinct().join(inventory, "owner", "left").join(flows, "owner", "left")
    rows = rows.na.fill(0, ["inventory", "acquired", "harvested"])
    index = F.coalesce(F.col("harvested") / F.nullif(F.col("acquired"), F.lit(0)), F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("inventory"), "owner"))
    return rows.withColumn("opportunism", index).withColumn("ord", place)


def segment_holders(snapshot: DataFrame, hidden: DataFrame, first: int = 15, shown: int = 10) -> DataFrame:
    """Largest holders of working keys per segment: cut to `first`, hide, cut to `shown`."""
    counts = snapshot.where(F.col("status") == WORKING).groupBy("segment", "owner").agg(F.count("*").alias("n"))
    by_segment = Window.partitionBy("segment")
    best = by_segment.orderBy(F.desc("n"), "owner")
    with_total = counts.withColumn("total", F.sum("n").over(by_segment))
    cut = with_total.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first)
    seen = hidden_filter(cut, hidden).withColumn("ord", F.row_number().over(best)).where(F.col("ord") <= shown)
    return seen.select("segment", "owner", "n", "ord", (F.col("n") / F.col("total")).alias("share"))


# --- dormant owners -------------------------------------------------------------------


def _recent_largest(rollup: DataFrame, last_n: int) -> DataFrame:
    """Largest inventory of each owner in the last n periods; owners absent in all are missing."""
    recent = rollup.select("period").distinct().orderBy(F.desc("period")).limit(last_n)
    rows = rollup.join(F.broadcast(recent), "period", "left_semi")
    return rows.groupBy("owner").agg(F.max("inventory").alias("largest"))


def set_difference_reports(
    rollup: DataFrame, docs: DataFrame, dormant_ref: str, last_n: int, limit: int = DORMANT_MAX
) -> DataFrame:
    """Candidates for the dormant tag and whether they carry it already.

    Candidates are small in every recent period or absent from all of them; only owners
    with a document that is not synthetic count.
    """
    listed = (
        docs.select(owner_of(F.col("code")).alias("owner"), "doc_no", "categories")
        .where(F.col("owner").isNotNull() & ~F.col("owner").startswith("1"))
        .groupBy("owner")
        .agg(F.max_by("categories", "doc_no").alias("categories"))
    )
    tagged = F.exists("categories", lambda c: c["_ref"] == dormant_ref)
    small = listed.join(_recent_largest(rollup, last_n), "owner", "left").where(
        F.coalesce("largest", F.lit(0)) <= limit
    )
    return small.select("owner", F.coalesce(tagged, F.lit(False)).alias("already_tagged"))


def dormant_owners(rollup: DataFrame, docs: DataFrame, dormant_ref: str, last_n: int, limit: int = DORMANT_MAX) -> DataFrame:
    """Owners that should get the dormant tag."""
    return set_difference_reports(rollup, docs, dormant_ref, last_n, limit).where(~F.col("already_tagged")).select("owner")


def dormant_profile(inventory: DataFrame, rollup: DataFrame, tagged: DataFrame, limit: int = DORMANT_MAX) -> DataFrame:
    """Dormant owners, by size or by tag, and the last period in which they were not."""
    last_active = rollup.groupBy("owner").agg(
        F.max(F.when(F.col("inventory") > limit, F.col("period"))).alias("last_active_period")
    )
    marks = tagged.select("owner").distinct().withColumn("is_tagged", F.lit(True))
    rows = last_active.join(inventory, "owner", "left").join(marks, "owner", "left").na.fill(0, ["inventory"])
    rows = rows.withColumn("is_tagged", F.coalesce("is_tagged", F.lit(False)))
    return rows.where((F.col("inventory") <= limit) | F.col("is_tagged"))


# --- repairs and stubs ----------------------------------------------------------------


def unknown_and_real(docs: DataFrame, categories: DataFrame, meta: Sequence[str] = META_SLUGS) -> DataFrame:
    """Documents tagged unknown beside a real category, and their references without it."""
    real = categories.where(~F.col("slug").isin(*meta)).select(F.col("id").alias("ref"), F.lit(1).alias("real"))
    unknown = categories.where(F.col("slug") == "unknown").select(F.col("id").alias("ref"), F.lit(1).alias("unknown"))
    refs = docs.select("doc_no", F.posexplode("categories").alias("pos", "r")).select("doc_no", "pos", "r._ref")
    tagged = refs.withColumnRenamed("_ref", "ref").join(real, "ref", "left").join(unknown, "ref", "left")
    kept = F.when(F.col("unknown").isNull(), F.struct("pos", "ref"))
    per_doc = tagged.groupBy("doc_no").agg(
        F.max("real").alias("has_real"),
        F.max("unknown").alias("has_unknown"),
        F.sort_array(F.collect_list(kept)).alias("kept"),
    )
    bad = per_doc.where((F.col("has_real") == 1) & (F.col("has_unknown") == 1))
    return bad.select("doc_no", F.transform("kept", lambda k: k["ref"]).alias("new_refs"))


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 80)
    return F.when(cut == "", "owner").otherwise(cut)


def unique_slugs(rows: DataFrame, used: DataFrame) -> DataFrame:
    """(owner, slug) for rows (owner, base): in the order of owners, the first free one of the
    base, base-<owner>, base-3, base-4 and so on, given the slugs `used` (slug) already.

    All owners ask for a slug at once. Of those that ask for one slug the first owner holds it,
    unless it is used; the others ask for their next one, also an owner whose slug an earlier
    one comes to ask for later. When nobody has to go on, every owner has what it would have
    chosen in its turn. A round takes one window over the owners; of the used slugs only those
    that can be in the way are read again.
    """
    own = F.concat("base", F.lit("-"), F.lower("owner"))
    wanted = rows.select(F.explode(F.array("base", own)).alias("stem")).distinct()
    stems = F.array_distinct(F.array("slug", F.regexp_replace("slug", "-[0-9]+$", "")))
    near = used.select("slug", F.explode(stems).alias("stem")).join(wanted, "stem", "left_semi")
    near = materialise(near.select("slug", F.lit(True).alias("held")).distinct(), "used-slugs")
    slug = F.when(F.col("n") == 1, F.col("base")).when(F.col("n") == 2, own).otherwise(F.concat("base", F.lit("-"), F.col("n").cast("string")))
    asking = rows.select("owner", "base", F.lit(1).alias("n"), F.lit(True).alias("lost"))
    first = Window.partitionBy("slug").orderBy("owner")
    while True:
        judged = asking.withColumn("slug", slug).withColumn("place", F.row_number().over(first)).join(near, "slug", "left")
        lost = (F.col("place") > 1) | F.coalesce("held", F.lit(False))
        asking = materialise(judged.select("owner", "base", (F.col("n") + lost.cast("int")).alias("n"), lost.alias("lost")), "slugs")
        if asking.where("lost").isEmpty():
            return asking.select("owner", slug.alias("slug"))


def stub_owners(contacts: DataFrame, docs: DataFrame, state_codes: dict[str, str]) -> DataFrame:
    """One stub per owner without a document: first contact by code, unique slug, short state.

    Slugs are those of `unique_slugs`.
    """
    covered = docs.select(owner_of(F.col("code")).alias("owner")).where(F.col("owner").isNotNull()).distinct()
    missing = contacts.join(F.broadcast(covered), "owner", "left_anti")
    first = missing.groupBy("owner").agg(
        F.min_by(F.struct("code", "company_name", "street", "city", "state", "country", "zip"), "code").alias("c")
    )
    rows = first.select("owner", "c.*")
    name = F.trim(F.coalesce("company_name", F.lit("")))
    title = F.when(name != "", name).otherwise(F.concat(F.lit("Unknown ("), F.col("owner"), F.lit(")")))
    state = F.trim(F.coalesce("state", F.lit("")))
    codes = F.create_map(*[F.lit(x) for pair in state_codes.items() for x in pair])
    home = F.coalesce("country", F.lit("")).isin("", "USA", "United States")
    rows = rows.withColumn("title", title).withColumn("base", slugify(title))
    used = docs.select(F.col("slug.current").alias("slug")).where(F.col("slug").isNotNull()).distinct()
    named = rows.join(unique_slugs(rows.select("owner", "base"), used), "owner")
    return named.select(
        "owner",
        "code",
        "title",
        "slug",
        "street",
        "city",
        F.coalesce(codes[state], state).alias("state"),
        F.when(home, "United States").otherwise(F.col("country")).alias("country"),
        "zip",
    )
