"""Directory documents, memberships, listings and dormant owners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.constants import HIDDEN_SLUGS
from rollbook.operators import directory, flows, ranks, rollup
from rollbook.plans.base import (
    AGES_SQL,
    DICTIONARY_SQL,
    DOCS_SQL,
    EDGES_SQL,
    GROUP_OVERRIDES,
    GROUPS_SQL,
    HIDDEN_OVERRIDE,
    MEMBERSHIP_SQL,
    ROLLUP_SQL,
    category_docs,
    dated,
    doc_versions,
    group_docs,
    group_membership,
    membership,
    owner_docs,
    query,
    snapshot,
    with_snap,
)
from rollbook.plans.rank_queries import LATEST_SQL, MATCH_SQL, _enrichment, _rollup
from rollbook.session import scratch_path

DOCS = f"WITH{DOCS_SQL}\n"


def _inventory(spark, d):
    return rollup.owner_inventory(rollup.latest_snapshot(*dated(spark, d)))


def _hidden(spark, d):
    return directory.hidden_owners(owner_docs(spark, d), category_docs(spark), HIDDEN_OVERRIDE, hidden_slugs=HIDDEN_SLUGS)


@query(
    "scan_directory_json",
    DOCS + "SELECT doc_no, _id, title, alias, code, slug, website, street1, city, len(categories) AS n_categories, len(groups) AS n_groups FROM docs",
)
def _(spark, d):
    """Documents written as files of one JSON array each and read back with the declared schema."""
    docs = owner_docs(spark, d)
    file_no = F.lpad(F.floor(F.col("doc_no") / 1000).cast("string"), 8, "0").alias("file_no")
    body = docs.select(file_no, "doc_no", F.to_json(F.struct(*docs.columns)).alias("text"))
    last = F.lead("doc_no").over(Window.partitionBy("file_no").orderBy("doc_no")).isNull()
    head = F.when(F.row_number().over(Window.partitionBy("file_no").orderBy("doc_no")) == 1, "[").otherwise("")
    lines = body.select("file_no", "doc_no", F.concat(head, F.col("text"), F.when(last, "]").otherwise(",")).alias("value"))
    path = scratch_path(spark, "directory")
    lines.repartition("file_no").sortWithinPartitions("file_no", "doc_no").select("file_no", "value").write.partitionBy("file_no").text(path)
    return directory.read_directory(spark, f"{path}/*").where("corrupt is null").select(
        "doc_no",
        "_id",
        "title",
        "alias",
        "code",
        F.col("slug.current").alias("slug"),
        "website",
        "address.street1",
        "address.city",
        F.size("categories").alias("n_categories"),
        F.size("groups").alias("n_groups"),
    )


@query("latest_version", DOCS + "SELECT doc_no, _id, title FROM docs")
def _(spark, d):
    return directory.latest_version(doc_versions(spark, d)).select("doc_no", "_id", "title")


@query(
    "dedupe_summary",
    """SELECT count(*) AS total_unique, count(*) FILTER (WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0) AS published_only,
    count(*) FILTER (WHERE s_suppkey % 3 = 0) AS draft_only, count(*) FILTER (WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 = 0) AS both FROM supplier""",
)
def _(spark, d):
    return directory.dedupe_summary(doc_versions(spark, d))


@query("explode_refs", DOCS + "SELECT doc_no, owner, ref FROM catref")
def _(spark, d):
    return directory.explode_refs(owner_docs(spark, d), "categories")


@query("membership_join", DOCS + "SELECT DISTINCT owner, slug, title FROM catref JOIN cats ON ref = id")
def _(spark, d):
    return directory.doc_membership(owner_docs(spark, d), category_docs(spark), "categories")


@query(
    "membership_join_inventory",
    with_snap(
        f"{LATEST_SQL},{DOCS_SQL}",
        "SELECT slug, count(*) AS members, CAST(sum(n) AS BIGINT) AS inventory FROM (SELECT DISTINCT owner, slug FROM catref JOIN cats ON ref = id) JOIN (SELECT owner, count(*) AS n FROM latest GROUP BY 1) USING (owner) GROUP BY 1",
    ),
)
def _(spark, d):
    members = directory.doc_membership(owner_docs(spark, d), category_docs(spark), "categories")
    return members.join(_inventory(spark, d), "owner").groupBy("slug").agg(
        F.count("*").alias("members"), F.sum("inventory").alias("inventory")
    )


@query("hidden_owners", DOCS + "SELECT owner FROM hid")
def _(spark, d):
    return _hidden(spark, d)


@query(
    "hidden_filter",
    with_snap(f"{LATEST_SQL},{DOCS_SQL}", "SELECT owner, count(*) AS inventory FROM latest WHERE owner NOT IN (SELECT owner FROM hid) GROUP BY 1"),
)
def _(spark, d):
    return directory.hidden_filter(_inventory(spark, d), _hidden(spark, d))


@query(
    "directory_filter",
    DOCS
    + """SELECT owner, doc_no, title, code FROM fdoc f WHERE EXISTS (SELECT 1 FROM catref c WHERE c.doc_no = f.doc_no AND ref = 'cat-' || (f.doc_no % 5))
    AND doc_no % 5 = 1 AND NOT (owner LIKE '1%' OR doc_no % 25 = 0)
    AND contains(lower(coalesce(title, '?') || ' ' || coalesce(alias, '') || ' ' || code), '0')""",
)
def _(spark, d):
    rows = directory.directory_filter(owner_docs(spark, d), category_docs(spark), "reseller", "no", "0", hidden_slugs=HIDDEN_SLUGS)
    return rows.select("owner", "doc_no", "title", "code")


@query(
    "directory_search",
    DOCS
    + """SELECT 'owner' AS kind, owner AS id, title FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY doc_no) AS rn FROM docs
      WHERE contains(lower(title), 'er') OR contains(lower(alias), 'er') OR contains(lower(code), 'er')) WHERE rn = 1 AND owner NOT IN (SELECT owner FROM hid)
    UNION ALL SELECT 'group', slug, title FROM grps WHERE contains(lower(title), 'er')
    UNION ALL SELECT 'category', slug, title FROM cats WHERE contains(lower(title), 'er')""",
)
def _(spark, d):
    return directory.directory_search(
        owner_docs(spark, d), category_docs(spark), group_docs(spark, d), _hidden(spark, d), "ER"
    )


@query(
    "own_website_filter",
    DOCS + "SELECT doc_no, CASE WHEN NOT contains(lower(website), 'registry.example') AND NOT contains(lower(website), 'site1.example') THEN website END AS website FROM docs",
)
def _(spark, d):
    site = directory.own_website(F.col("website"), ["registry.example", "site1.example"])
    return owner_docs(spark, d).select("doc_no", site.alias("website"))


@query(
    "enrichment_eligible",
    DOCS
    + """SELECT doc_no, _id FROM docs WHERE coalesce(website, '') <> '' AND NOT list_has_any(categories, ['cat-unknown', 'cat-hidden', 'cat-dead'])
    AND _id NOT IN (SELECT 'org-' || s_suppkey FROM supplier WHERE s_acctbal > 8000)""",
)
def _(spark, d):
    from rollbook.plans.base import table

    done = table(spark, d, "supplier").where(F.col("s_acctbal") > 8000)
    done = done.select(F.concat(F.lit("org-"), F.col("s_suppkey").cast("string")).alias("_id"))
    rows = directory.enrichment_eligible(
        owner_docs(spark, d), category_docs(spark), ["Unknown", "Hidden", "Dormant"], done
    )
    return rows.select("doc_no", "_id")


@query(
    "owner_doc_resolution",
    DOCS
    + """SELECT f.owner, f.title, f.alias, coalesce(c.s, '') AS category_slugs, coalesce(g.s, '') AS group_slugs FROM fdoc f
    LEFT JOIN (SELECT owner, string_agg(slug, '|' ORDER BY slug) AS s FROM (SELECT DISTINCT owner, slug FROM catref JOIN cats ON ref = id) GROUP BY 1) c USING (owner)
    LEFT JOIN (SELECT owner, string_agg(slug, '|' ORDER BY slug) AS s FROM (SELECT DISTINCT owner, slug FROM grpref JOIN grps ON ref = id) GROUP BY 1) g USING (owner)""",
)
def _(spark, d):
    return directory.owner_resolution(owner_docs(spark, d), category_docs(spark), group_docs(spark, d))


def _names(spark, d):
    declared = directory.doc_membership(owner_docs(spark, d), group_docs(spark, d), "groups").select("owner", "title")
    named = [(o, g) for g, owners in GROUP_OVERRIDES.items() for o in owners]
    extra = spark.createDataFrame(named, "owner string, title string")
    return directory.owner_names(owner_docs(spark, d), declared.unionByName(extra))


NAMES_SQL = """
gt AS (SELECT DISTINCT owner, title FROM grpref JOIN grps ON ref = id UNION SELECT * FROM (VALUES ('00', 'EUROPE'), ('01', 'EUROPE'), ('24', 'ASIA')) AS t(o, g)),
nm AS (SELECT f.owner, f.title AS name, f.title || coalesce(' (' || string_agg(g.title, ', ' ORDER BY g.title) || ')', '') AS display
  FROM fdoc f LEFT JOIN gt g ON g.owner = f.owner AND lower(g.title) <> lower(f.title) GROUP BY 1, 2)"""


@query("owner_names", f"WITH{DOCS_SQL},{NAMES_SQL}\nSELECT * FROM nm")
def _(spark, d):
    return _names(spark, d)


@query(
    "partner_names",
    with_snap(
        f"{EDGES_SQL},{DOCS_SQL},{NAMES_SQL}",
        """SELECT curr_period, e.from_node AS partner, to_node, edge_type, n, former_owner, coalesce(display, from_node) AS partner_name
        FROM edges e LEFT JOIN nm ON nm.owner = from_node""",
    ),
)
def _(spark, d):
    edges = flows.flow_edges(*dated(spark, d)).withColumnRenamed("from_node", "partner")
    return directory.partner_names(edges, _names(spark, d))


# Documents of suppliers with a low balance do not count as published here.
GAP_CTES = f"{LATEST_SQL},{DOCS_SQL},\npub AS (SELECT * FROM docs WHERE owner NOT IN (SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') FROM supplier WHERE s_acctbal < 500))"


def _published(spark, d):
    from rollbook.plans.base import table

    low = table(spark, d, "supplier").where(F.col("s_acctbal") < 500)
    low = low.select(F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("owner")).distinct()
    docs = owner_docs(spark, d).withColumn("owner", directory.owner_of(F.col("code")))
    return docs.join(low, "owner", "left_anti").drop("owner")


@query(
    "directory_gap_anti",
    with_snap(
        GAP_CTES,
        """SELECT owner, count(*) AS inventory, count(*) FILTER (WHERE status = 1) AS working, count(*) FILTER (WHERE status = 2) AS transit,
        count(*) FILTER (WHERE status = 3) AS disconn, array_to_string(list_slice(list_sort(list_distinct(list(sub_owner))), 1, 5), '|') AS sample_codes
        FROM latest WHERE owner NOT IN (SELECT owner FROM pub) GROUP BY 1""",
    ),
)
def _(spark, d):
    return directory.directory_gap(rollup.latest_snapshot(*dated(spark, d)), _published(spark, d))


@query(
    "directory_coverage",
    with_snap(
        GAP_CTES,
        """SELECT CAST(sum(coalesce(n_docs, 0)) AS BIGINT) AS n_docs, count(n_docs) AS n_owners, count(*) FILTER (WHERE n_docs > 1) AS n_multi,
        count(*) FILTER (WHERE n_docs IS NULL) AS n_missing, CAST(sum(CASE WHEN n_docs IS NULL THEN inventory ELSE 0 END) AS BIGINT) AS missing_inventory,
        sum(CASE WHEN n_docs IS NULL THEN inventory ELSE 0 END) / sum(inventory) AS missing_share
        FROM (SELECT owner, count(*) AS n_docs FROM pub GROUP BY 1) FULL JOIN (SELECT owner, count(*) AS inventory FROM latest GROUP BY 1) USING (owner)""",
    ),
)
def _(spark, d):
    return directory.directory_coverage(rollup.latest_snapshot(*dated(spark, d)), _published(spark, d))


# --- trajectories and summaries -------------------------------------------------------

PUBLIC_SQL = f"""{DOCS_SQL},
seen AS (SELECT * FROM docs WHERE owner NOT LIKE '1%' AND NOT list_contains(categories, 'cat-hidden'))"""


@query(
    "category_trajectory",
    with_snap(
        f"{ROLLUP_SQL},{PUBLIC_SQL}",
        """SELECT slug, title, period, CAST(sum(inventory) AS BIGINT) AS inventory FROM roll JOIN (SELECT DISTINCT s.owner, slug, title
        FROM (SELECT owner, unnest(categories) AS ref FROM seen) s JOIN cats ON ref = id) USING (owner) GROUP BY 1, 2, 3""",
    ),
)
def _(spark, d):
    docs, cats = owner_docs(spark, d), category_docs(spark)
    members = directory.public_membership(docs, cats, cats, "categories", hidden_slugs=HIDDEN_SLUGS)
    traj = directory.member_trajectory(_rollup(spark, d), members, "slug")
    return traj.join(F.broadcast(cats.select("slug", "title")), "slug")


@query(
    "group_trajectory",
    with_snap(
        f"{ROLLUP_SQL},{PUBLIC_SQL}",
        """SELECT slug, period, CAST(sum(inventory) AS BIGINT) AS inventory FROM roll JOIN (SELECT DISTINCT s.owner, slug
        FROM (SELECT owner, unnest(groups) AS ref FROM seen) s JOIN grps ON ref = id
        UNION SELECT * FROM (VALUES ('00', 'europe'), ('01', 'europe'), ('24', 'asia')) AS t(o, g)) USING (owner) GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    members = directory.public_membership(owner_docs(spark, d), group_docs(spark, d), category_docs(spark), "groups", hidden_slugs=HIDDEN_SLUGS)
    named = [(o, g.lower()) for g, owners in GROUP_OVERRIDES.items() for o in owners]
    extra = spark.createDataFrame(named, "owner string, slug string")
    return directory.member_trajectory(_rollup(spark, d), members.select("owner", "slug").unionByName(extra), "slug")


SUMMARY_SQL = """
cp AS (SELECT coalesce(category, '(uncategorized)') AS category, period, sum(inventory) AS inventory, sum(harvested_cross_owner) AS harvested, sum(acquired) AS acquired
  FROM roll LEFT JOIN (SELECT DISTINCT * FROM member WHERE owner <> '03') USING (owner) GROUP BY 1, 2),
cs AS (SELECT category, CAST(coalesce(sum(inventory) FILTER (WHERE period = (SELECT min(period) FROM cp)), 0) AS BIGINT) AS start,
  CAST(coalesce(sum(inventory) FILTER (WHERE period = (SELECT max(period) FROM cp)), 0) AS BIGINT) AS "end",
  CAST(sum(harvested) AS BIGINT) AS harvested, CAST(sum(acquired) AS BIGINT) AS acquired FROM cp GROUP BY 1)"""
SUMMARY_SELECT = """SELECT *, "end" - start AS delta, coalesce(("end" - start) / nullif(start, 0) * 100, 0.0) AS pct,
  coalesce(harvested / nullif(acquired, 0), 0.0) AS opportunism FROM cs"""


@query("category_summary", with_snap(f"{ROLLUP_SQL},{MEMBERSHIP_SQL},{SUMMARY_SQL}", SUMMARY_SELECT))
def _(spark, d):
    """Owner 03 is left out of the membership, so that it falls into the rest."""
    return directory.category_summary(_rollup(spark, d), membership(spark, d).where(F.col("owner") != "03"))


@query(
    "category_growth",
    with_snap(f"{ROLLUP_SQL},{MEMBERSHIP_SQL},{SUMMARY_SQL}", f"SELECT category, start, \"end\", pct FROM ({SUMMARY_SELECT}) WHERE start >= 50"),
)
def _(spark, d):
    sums = directory.category_summary(_rollup(spark, d), membership(spark, d).where(F.col("owner") != "03"))
    return sums.where(F.col("start") >= 50).select("category", "start", "end", "pct")


INV_SQL = f"{LATEST_SQL},\ninv AS (SELECT owner, count(*) AS inventory FROM latest GROUP BY owner)"
FLOW_SQL = "flow AS (SELECT owner, sum(acquired) AS acquired, sum(harvested_cross_owner) AS harvested FROM roll GROUP BY owner)"


@query(
    "group_summary",
    with_snap(
        f"{ROLLUP_SQL},{INV_SQL},{FLOW_SQL},{GROUPS_SQL}",
        """SELECT "group", count(*) AS members, CAST(coalesce(sum(inventory), 0) AS BIGINT) AS inventory, CAST(coalesce(sum(acquired), 0) AS BIGINT) AS acquired,
        CAST(coalesce(sum(harvested), 0) AS BIGINT) AS harvested, coalesce(sum(harvested) / nullif(sum(acquired), 0), 0.0) AS opportunism
        FROM gmember LEFT JOIN inv USING (owner) LEFT JOIN flow USING (owner) GROUP BY 1""",
    ),
)
def _(spark, d):
    return directory.group_summary(_inventory(spark, d), _rollup(spark, d), group_membership(spark, d))


@query(
    "group_validation",
    with_snap(
        f"{INV_SQL},{GROUPS_SQL}",
        """SELECT "group", count(*) AS members, CAST(coalesce(sum(inventory), 0) AS BIGINT) AS inventory, string_agg(owner, '|' ORDER BY owner) AS owners
        FROM gmember LEFT JOIN inv USING (owner) GROUP BY 1 HAVING count(*) >= 2""",
    ),
)
def _(spark, d):
    return directory.group_validation(_inventory(spark, d), group_membership(spark, d))


@query(
    "category_index",
    with_snap(
        f"{INV_SQL},{MEMBERSHIP_SQL},{AGES_SQL},{DICTIONARY_SQL},{MATCH_SQL},\nci AS (SELECT category, count(*) AS members, CAST(coalesce(sum(inventory), 0) AS BIGINT) AS inventory, sum(match_count) / nullif(sum(working_count), 0) AS match_rate FROM member LEFT JOIN inv USING (owner) LEFT JOIN enr USING (owner) GROUP BY 1)",
        "SELECT *, inventory / sum(inventory) OVER () AS share FROM ci",
    ),
)
def _(spark, d):
    return directory.category_index(_inventory(spark, d), _enrichment(spark, d), membership(spark, d))


MONTH_SELECT = """SELECT {by}, period, CAST(sum(inventory) AS BIGINT) AS inventory, CAST(sum(acquired) AS BIGINT) AS acquired, CAST(sum(lost) AS BIGINT) AS lost,
  CAST(sum(harvested_cross_owner) AS BIGINT) AS harvested, CAST(sum(appeared_from_spare) AS BIGINT) AS from_spare,
  CAST(sum(disappeared_to_spare) AS BIGINT) AS to_spare FROM roll JOIN {members} USING (owner) GROUP BY 1, 2"""


@query("group_month_series", with_snap(f"{ROLLUP_SQL},{GROUPS_SQL}", MONTH_SELECT.format(by='"group"', members="gmember")))
def _(spark, d):
    return directory.member_series(_rollup(spark, d), group_membership(spark, d), "group")


@query("category_month_series", with_snap(f"{ROLLUP_SQL},{MEMBERSHIP_SQL}", MONTH_SELECT.format(by="category", members="member")))
def _(spark, d):
    return directory.member_series(_rollup(spark, d), membership(spark, d), "category")


@query(
    "membership_semi",
    with_snap(
        f"{ROLLUP_SQL},{MEMBERSHIP_SQL}",
        "SELECT period, count(*) AS n, CAST(sum(inventory) AS BIGINT) AS inventory FROM roll WHERE owner IN (SELECT owner FROM member WHERE category = 'BUILDING') GROUP BY 1",
    ),
)
def _(spark, d):
    building = membership(spark, d).where(F.col("category") == "BUILDING")
    rows = directory.members_only(_rollup(spark, d), building)
    return rows.groupBy("period").agg(F.count("*").alias("n"), F.sum("inventory").alias("inventory"))


@query(
    "sibling_inventory",
    with_snap(
        f"{ROLLUP_SQL},{GROUPS_SQL}",
        """SELECT "group", owner, coalesce(max(inventory) FILTER (WHERE period = '1995-Q1'), 0) AS prev_inventory, coalesce(max(inventory) FILTER (WHERE period = '1995-Q2'), 0) AS curr_inventory,
        coalesce(max(inventory) FILTER (WHERE period = '1995-Q2'), 0) - coalesce(max(inventory) FILTER (WHERE period = '1995-Q1'), 0) AS delta
        FROM gmember LEFT JOIN roll USING (owner) GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    return directory.sibling_inventory(
        _rollup(spark, d), group_membership(spark, d), F.lit("1995-Q1"), F.lit("1995-Q2")
    )


@query(
    "segment_holders",
    with_snap(
        f"{DOCS_SQL},\nh AS (SELECT segment, owner, count(*) AS n FROM snap WHERE status = 1 GROUP BY 1, 2),\nc AS (SELECT *, sum(n) OVER (PARTITION BY segment) AS total, row_number() OVER (PARTITION BY segment ORDER BY n DESC, owner) AS place FROM h)",
        """SELECT segment, owner, n, ord, n / total AS share FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, owner) AS ord
        FROM c WHERE place <= 15 AND owner NOT IN (SELECT owner FROM hid)) WHERE ord <= 10""",
        segment=True,
    ),
)
def _(spark, d):
    return directory.segment_holders(snapshot(spark, d, segment=True), _hidden(spark, d))


MEMBERS_SQL = f"{ROLLUP_SQL},{INV_SQL},{FLOW_SQL},{MEMBERSHIP_SQL}"


@query(
    "category_members",
    with_snap(
        MEMBERS_SQL,
        """SELECT category, owner, coalesce(inventory, 0) AS inventory, CAST(coalesce(acquired, 0) AS BIGINT) AS acquired, CAST(coalesce(harvested, 0) AS BIGINT) AS harvested,
        coalesce(harvested / nullif(acquired, 0), 0.0) AS opportunism, row_number() OVER (PARTITION BY category ORDER BY coalesce(inventory, 0) DESC, owner) AS ord
        FROM member LEFT JOIN inv USING (owner) LEFT JOIN flow USING (owner)""",
    ),
)
def _(spark, d):
    return directory.category_members(_inventory(spark, d), _rollup(spark, d), membership(spark, d))


@query(
    "other_bucket",
    with_snap(
        f"{INV_SQL},{MEMBERSHIP_SQL},\nrk AS (SELECT category, owner, inventory, row_number() OVER (PARTITION BY category ORDER BY inventory DESC, owner) AS ord FROM member JOIN inv USING (owner)),\nsl AS (SELECT category, CASE WHEN ord <= 8 THEN owner ELSE '(others)' END AS slot, CAST(sum(inventory) AS BIGINT) AS value, count(*) AS n_owners FROM rk GROUP BY 1, 2)",
        "SELECT *, value / sum(value) OVER (PARTITION BY category) AS share FROM sl",
    ),
)
def _(spark, d):
    members = membership(spark, d).join(_inventory(spark, d), "owner")
    return ranks.other_bucket(members)


@query(
    "directory_listing",
    with_snap(
        f"{INV_SQL},{AGES_SQL},{DICTIONARY_SQL},{MATCH_SQL},{DOCS_SQL}",
        """SELECT i.owner, inventory, coalesce(title, '(not in directory)') AS name, match_rate, median_age_months
        FROM inv i LEFT JOIN fdoc f USING (owner) LEFT JOIN enr e USING (owner) WHERE i.owner NOT IN (SELECT owner FROM hid)""",
    ),
)
def _(spark, d):
    return directory.directory_listing(_inventory(spark, d), _enrichment(spark, d), _names(spark, d), _hidden(spark, d))


@query(
    "group_members_listing",
    with_snap(
        f"{INV_SQL},{AGES_SQL},{DICTIONARY_SQL},{MATCH_SQL},{GROUPS_SQL}",
        """SELECT "group", owner, coalesce(inventory, 0) AS inventory, match_rate, median_age_months,
        CAST(floor(30 + coalesce(sqrt(coalesce(inventory, 0) / nullif(max(coalesce(inventory, 0)) OVER (PARTITION BY "group"), 0)), 0) * 90) AS BIGINT) AS size
        FROM gmember LEFT JOIN inv USING (owner) LEFT JOIN enr USING (owner)""",
    ),
)
def _(spark, d):
    return directory.members_listing(
        _inventory(spark, d), _enrichment(spark, d), group_membership(spark, d), "group"
    )


# --- dormant owners -------------------------------------------------------------------

# The limits fit the small inventories of the derived snapshot.
DORMANT_SQL = f"""{ROLLUP_SQL},{DOCS_SQL},
rec AS (SELECT owner, max(inventory) AS largest FROM roll WHERE period IN (SELECT DISTINCT period FROM roll ORDER BY period DESC LIMIT 3) GROUP BY 1),
cand AS (SELECT d.owner, list_contains(d.categories, 'cat-dead') AS already_tagged FROM docs d LEFT JOIN rec USING (owner)
  WHERE d.owner NOT LIKE '1%' AND coalesce(largest, 0) <= 40 AND d.doc_no IN (SELECT max(doc_no) FROM docs GROUP BY owner))"""


@query("dormant_owners", with_snap(DORMANT_SQL, "SELECT owner FROM cand WHERE NOT already_tagged"))
def _(spark, d):
    return directory.dormant_owners(_rollup(spark, d), owner_docs(spark, d), "cat-dead", 3, 40)


@query("set_difference_reports", with_snap(DORMANT_SQL, "SELECT * FROM cand"))
def _(spark, d):
    return directory.set_difference_reports(_rollup(spark, d), owner_docs(spark, d), "cat-dead", 3, 40)


@query(
    "dormant_profile",
    with_snap(
        f"{ROLLUP_SQL},{INV_SQL},{DOCS_SQL}",
        """SELECT * FROM (SELECT owner, max(CASE WHEN inventory > 25 THEN period END) AS last_active_period FROM roll GROUP BY 1) a
        JOIN (SELECT owner, coalesce(i.inventory, 0) AS inventory, owner IN (SELECT owner FROM catref WHERE ref = 'cat-dead') AS is_tagged
          FROM (SELECT DISTINCT owner FROM roll) LEFT JOIN inv i USING (owner)) b USING (owner) WHERE inventory <= 25 OR is_tagged""",
    ),
)
def _(spark, d):
    tagged = directory.explode_refs(owner_docs(spark, d), "categories").where(F.col("ref") == "cat-dead")
    return directory.dormant_profile(_inventory(spark, d), _rollup(spark, d), tagged, 25)


@query(
    "unknown_and_real",
    DOCS
    + """SELECT doc_no, array_to_string([x FOR x IN categories IF x <> 'cat-unknown'], '|') AS new_refs FROM docs
    WHERE list_contains(categories, 'cat-unknown') AND list_has_any(categories, ['cat-0', 'cat-1', 'cat-2', 'cat-3', 'cat-4', 'cat-dead'])""",
)
def _(spark, d):
    return directory.unknown_and_real(owner_docs(spark, d), category_docs(spark))
