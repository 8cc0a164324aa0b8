"""Snapshot aggregates, ranks, leaderboards, series, episodes and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import dictionary as words
from rollbook.operators import directory, episodes, ranks, rollup
from rollbook.plans.base import (
    AGES_SQL,
    DICTIONARY_SQL,
    GROUPS_SQL,
    MEMBERSHIP_SQL,
    ROLLUP_SQL,
    dated,
    dictionary,
    group_membership,
    key_ages,
    membership,
    query,
    snapshot,
    with_snap,
)

LATEST_SQL = "latest AS (SELECT * FROM snap WHERE period = (SELECT max(period) FROM snap))"


def _rollup(spark, d):
    return rollup.owner_period_rollup(*dated(spark, d))


@query(
    "latest_snapshot",
    with_snap(LATEST_SQL, "SELECT key, period, segment, status, owner, sub_owner, CAST(changed_at AS VARCHAR) AS changed_at FROM latest", segment=True),
)
def _(spark, d):
    return rollup.latest_snapshot(*dated(spark, d, segment=True))


@query(
    "owner_snapshot",
    with_snap("", "SELECT period, owner, segment, status, count(*) AS n FROM snap GROUP BY ALL", segment=True),
)
def _(spark, d):
    """The snapshot aggregate of every period."""
    rows = snapshot(spark, d, segment=True)
    return rows.groupBy("period", "owner", "segment", "status").agg(F.count("*").alias("n"))


@query(
    "owner_subcodes",
    with_snap(
        LATEST_SQL,
        """SELECT owner, sub_owner, count(*) AS n, row_number() OVER (PARTITION BY owner ORDER BY count(*) DESC, sub_owner) AS ord
        FROM latest GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    from pyspark.sql import Window

    codes = rollup.owner_subcodes(rollup.latest_snapshot(*dated(spark, d)))
    w = Window.partitionBy("owner").orderBy(F.desc("n"), "sub_owner")
    return codes.withColumn("ord", F.row_number().over(w))


@query("owner_inventory", with_snap(LATEST_SQL, "SELECT owner, count(*) AS inventory FROM latest GROUP BY owner"))
def _(spark, d):
    return rollup.owner_inventory(rollup.latest_snapshot(*dated(spark, d)))


@query("distinct_owner_count", with_snap("", "SELECT count(DISTINCT owner) AS n_owners FROM snap"))
def _(spark, d):
    return rollup.distinct_owner_count(snapshot(spark, d))


@query("status_filter", with_snap("", "SELECT period, owner, count(*) AS n FROM snap WHERE status = 1 GROUP BY 1, 2"))
def _(spark, d):
    return words.working_keys(snapshot(spark, d)).groupBy("period", "owner").agg(F.count("*").alias("n"))


@query(
    "segment_breakdown",
    with_snap(
        LATEST_SQL + """,
c AS (SELECT o.owner, g.segment, count(l.key) AS n FROM (SELECT DISTINCT owner FROM latest) o
  CROSS JOIN (SELECT unnest([800,833,844,855,866,877,888]) AS segment) g
  LEFT JOIN latest l ON l.owner = o.owner AND l.segment = g.segment GROUP BY 1, 2)""",
        """SELECT owner, CAST(segment AS BIGINT) AS segment, n, n / nullif(max(n) OVER (PARTITION BY owner), 0) AS share_of_max,
        n / nullif(sum(n) OVER (PARTITION BY owner), 0) AS share_of_total FROM c""",
        segment=True,
    ),
)
def _(spark, d):
    return rollup.segment_breakdown(rollup.latest_snapshot(*dated(spark, d, segment=True)))


@query(
    "status_correction",
    with_snap(
        """c AS (SELECT owner, status + 2 AS status, count(*) - CASE WHEN status + 2 = 5 THEN 14 ELSE 0 END AS n FROM snap
        GROUP BY owner, status)""",
        "SELECT owner, status, n, n / sum(n) OVER (PARTITION BY owner) AS share FROM c WHERE n > 0",
    ),
)
def _(spark, d):
    """Status codes moved up by two, so that the disconnected keys stand for UNAVAIL."""
    rows = snapshot(spark, d).withColumn("status", F.col("status") + 2)
    return rollup.status_shares(rows, 14)


OPP_SQL = """,
opp AS (SELECT owner, CAST(sum(acquired) AS BIGINT) AS acquired, CAST(sum(harvested_cross_owner) AS BIGINT) AS harvested,
  CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(appeared_from_spare) AS BIGINT) AS appeared,
  CAST(sum(harvested_cross_owner) AS DOUBLE) / nullif(sum(acquired), 0) AS opportunism FROM roll {where} GROUP BY owner)"""


@query("opportunism_index", with_snap(ROLLUP_SQL + OPP_SQL.format(where=""), "SELECT * FROM opp WHERE acquired > 1000"))
def _(spark, d):
    return rollup.opportunism(_rollup(spark, d))


EXCLUDED = ["1998-Q2"]
KEPT_SQL = "WHERE period NOT IN ('1998-Q2') AND period <> (SELECT min(period) FROM roll)"


@query(
    "excluded_months",
    with_snap(ROLLUP_SQL, f"SELECT period, count(*) AS n, CAST(sum(acquired) AS BIGINT) AS acquired FROM roll {KEPT_SQL} GROUP BY period"),
)
def _(spark, d):
    kept = rollup.excluded_periods(_rollup(spark, d), EXCLUDED)
    return kept.groupBy("period").agg(F.count("*").alias("n"), F.sum("acquired").alias("acquired"))


@query(
    "opportunism_leaderboard",
    with_snap(
        ROLLUP_SQL + OPP_SQL.format(where=KEPT_SQL),
        "SELECT * FROM opp WHERE acquired > 100 ORDER BY opportunism DESC, owner LIMIT 30",
    ),
)
def _(spark, d):
    kept = rollup.excluded_periods(_rollup(spark, d), EXCLUDED)
    return rollup.opportunism(kept, 100).orderBy(F.desc("opportunism"), "owner").limit(30)


@query(
    "cleanest",
    with_snap(
        ROLLUP_SQL + OPP_SQL.format(where=KEPT_SQL),
        "SELECT * FROM opp WHERE acquired > 1000 ORDER BY opportunism, owner LIMIT 15",
    ),
)
def _(spark, d):
    kept = rollup.excluded_periods(_rollup(spark, d), EXCLUDED)
    return rollup.opportunism(kept, 1000).orderBy("opportunism", "owner").limit(15)


ENDS_SQL = """,
ends AS (SELECT owner, min(period) AS first_period, arg_min(inventory, period) AS start_inventory, max(period) AS last_period,
  arg_max(inventory, period) AS end_inventory FROM roll WHERE inventory > 0 GROUP BY owner),
moved AS (SELECT *, end_inventory - start_inventory AS delta,
  (end_inventory - start_inventory) / nullif(start_inventory, 0) * 100 AS pct FROM ends)"""


@query("first_last_row", with_snap(ROLLUP_SQL + ENDS_SQL, "SELECT * FROM moved"))
def _(spark, d):
    return ranks.first_last(_rollup(spark, d))


@query(
    "first_last_self_join",
    with_snap(
        ROLLUP_SQL + """,
m AS (SELECT owner, period, inventory, row_number() OVER (PARTITION BY owner ORDER BY period) AS rn_a,
  row_number() OVER (PARTITION BY owner ORDER BY period DESC) AS rn_d FROM roll WHERE inventory > 0)""",
        """SELECT f.owner, f.inventory AS start_inventory, l.inventory AS end_inventory, l.inventory - f.inventory AS delta
        FROM m f JOIN m l USING (owner) WHERE f.rn_a = 1 AND l.rn_d = 1 AND f.inventory > 10""",
    ),
)
def _(spark, d):
    moved = ranks.first_last(_rollup(spark, d)).where(F.col("start_inventory") > 10)
    return moved.select("owner", "start_inventory", "end_inventory", "delta")


@query(
    "trajectory_leaders",
    with_snap(
        ROLLUP_SQL + ENDS_SQL,
        """SELECT * FROM (SELECT *, 'growers' AS side FROM moved WHERE start_inventory > 10 ORDER BY delta DESC, owner LIMIT 15)
        UNION ALL SELECT * FROM (SELECT *, 'shrinkers' FROM moved WHERE start_inventory > 10 ORDER BY delta, owner DESC LIMIT 15)""",
    ),
)
def _(spark, d):
    return ranks.trajectory_leaders(_rollup(spark, d), 10)


@query(
    "owner_trajectory",
    with_snap(
        ROLLUP_SQL + """,
t AS (SELECT owner, count(*) AS n_periods, CAST(sum(acquired) AS BIGINT) AS acquired, CAST(sum(harvested_cross_owner) AS BIGINT) AS harvested,
  CAST(sum(lost) AS BIGINT) AS lost, min(period) AS first_period, max(period) AS last_period,
  arg_min(inventory, period) AS first_inventory, arg_max(inventory, period) AS last_inventory FROM roll GROUP BY owner)""",
        """SELECT *, coalesce(harvested / nullif(acquired, 0), 0.0) AS opportunism, last_inventory - first_inventory AS delta,
        coalesce((last_inventory - first_inventory) / nullif(first_inventory, 0) * 100, 0.0) AS pct FROM t""",
    ),
)
def _(spark, d):
    return ranks.owner_trajectory(_rollup(spark, d))


@query(
    "sampled_trajectory",
    with_snap(
        ROLLUP_SQL,
        """SELECT owner, period, inventory, acquired FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY period) - 1 AS i,
        count(*) OVER (PARTITION BY owner) AS n FROM roll) WHERE i % greatest(1, n // 14) = 0 OR i = n - 1""",
    ),
)
def _(spark, d):
    return ranks.sampled_trajectory(_rollup(spark, d)).select("owner", "period", "inventory", "acquired")


SERIES_SQL = ROLLUP_SQL + f""",{MEMBERSHIP_SQL},
traj AS (SELECT category, period, CAST(sum(inventory) AS BIGINT) AS inventory FROM roll JOIN (SELECT DISTINCT * FROM member) USING (owner)
  GROUP BY 1, 2)"""


def _series(spark, d):
    traj = directory.member_trajectory(_rollup(spark, d), membership(spark, d), "category")
    return traj.select(F.col("category").alias("label"), "period", F.col("inventory").alias("value"))


@query(
    "net_change",
    with_snap(
        SERIES_SQL,
        """SELECT category AS label, arg_min(inventory, period) AS baseline,
        CAST(coalesce(sum(inventory) FILTER (WHERE period = (SELECT max(period) FROM traj)), 0) AS BIGINT) AS final,
        CAST(coalesce(sum(inventory) FILTER (WHERE period = (SELECT max(period) FROM traj)), 0) - arg_min(inventory, period) AS BIGINT) AS delta
        FROM traj GROUP BY 1""",
    ),
)
def _(spark, d):
    return ranks.net_change(_series(spark, d))


@query(
    "indexed_series",
    with_snap(
        SERIES_SQL,
        """SELECT category AS label, period, 100.0::DOUBLE * inventory / base AS pct FROM traj JOIN
        (SELECT category, arg_min(inventory, period) AS base FROM traj WHERE inventory > 0 GROUP BY 1) USING (category)""",
    ),
)
def _(spark, d):
    return ranks.indexed_series(_series(spark, d))


SEGMENT_NAMES = ["MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE"]


@query(
    "stacked_series",
    with_snap(
        SERIES_SQL + """,
l AS (SELECT unnest(['MACHINERY','HOUSEHOLD','FURNITURE','BUILDING','AUTOMOBILE']) AS label, generate_subscripts(['MACHINERY','HOUSEHOLD','FURNITURE','BUILDING','AUTOMOBILE'], 1) AS pos)""",
        """SELECT l.label, p.period, coalesce(t.inventory, 0) AS value,
        CAST(sum(coalesce(t.inventory, 0)) OVER (PARTITION BY p.period ORDER BY pos) AS BIGINT) AS top
        FROM (SELECT DISTINCT period FROM traj) p CROSS JOIN l LEFT JOIN traj t ON t.category = l.label AND t.period = p.period""",
    ),
)
def _(spark, d):
    return ranks.stacked_series(_series(spark, d), SEGMENT_NAMES)


MATCH_SQL = """
enr AS (SELECT * FROM (SELECT owner, count(*) AS working_count, count(hit) AS match_count, count(hit) / count(*) AS match_rate
    FROM (SELECT * FROM ages WHERE status = 1) a LEFT JOIN (SELECT DISTINCT digits, 1 AS hit FROM dict) USING (digits) GROUP BY owner)
  JOIN (SELECT owner, count(*) FILTER (WHERE age_months < 1) AS b_under_1m, count(*) FILTER (WHERE age_months BETWEEN 1 AND 2) AS b_1_3m,
    count(*) FILTER (WHERE age_months BETWEEN 3 AND 11) AS b_3_12m, count(*) FILTER (WHERE age_months BETWEEN 12 AND 23) AS b_1_2y,
    count(*) FILTER (WHERE age_months BETWEEN 24 AND 59) AS b_2_5y, count(*) FILTER (WHERE age_months >= 60) AS b_5y_plus,
    CAST(round_even(median(age_months), 0) AS BIGINT) AS median_age_months FROM ages WHERE status = 1 GROUP BY owner) USING (owner))"""


def _enrichment(spark, d):
    return words.enrichment(words.working_keys(key_ages(spark, d)), dictionary(spark, d))


RANKS_SQL = f"""{ROLLUP_SQL},{AGES_SQL},{DICTIONARY_SQL},{MATCH_SQL},{LATEST_SQL}{ENDS_SQL},
r1 AS (SELECT owner, rank() OVER (ORDER BY v DESC) AS inv_rank, count(*) OVER () AS inv_total FROM (SELECT owner, count(*) AS v FROM latest GROUP BY 1)),
r2 AS (SELECT owner, rank() OVER (ORDER BY v DESC) AS opp_rank, count(*) OVER () AS opp_total FROM (SELECT owner,
  CAST(sum(harvested_cross_owner) AS DOUBLE) / sum(acquired) AS v FROM roll GROUP BY 1 HAVING sum(acquired) > 1000)),
r3 AS (SELECT owner, rank() OVER (ORDER BY delta DESC) AS growth_rank, count(*) OVER () AS growth_total FROM moved WHERE start_inventory > 10),
r4 AS (SELECT owner, rank() OVER (ORDER BY match_count / working_count DESC) AS match_rank, count(*) OVER () AS match_total FROM enr WHERE working_count > 500),
r5 AS (SELECT owner, rank() OVER (ORDER BY median_age_months DESC) AS age_rank, count(*) OVER () AS age_total FROM enr WHERE working_count > 500)"""
RANKS_SELECT = """SELECT * FROM r1 FULL JOIN r2 USING (owner) FULL JOIN r3 USING (owner) FULL JOIN r4 USING (owner) FULL JOIN r5 USING (owner)"""


@query("five_way_full_outer", with_snap(RANKS_SQL, RANKS_SELECT))
def _(spark, d):
    return ranks.ranks(ranks.measures(_rollup(spark, d), _enrichment(spark, d), 1000, 10, 500))


@query("rank_with_total", with_snap(RANKS_SQL, "SELECT * FROM r3"))
def _(spark, d):
    grown = ranks.first_last(_rollup(spark, d)).where(F.col("start_inventory") > 10)
    return ranks.rank_with_total(grown.select("owner", F.col("delta").alias("value")), "growth")


RUNS_SQL = """
runs AS (SELECT key, owner, count(*) AS duration, min(q) AS start FROM (
  SELECT key, owner, q, q - row_number() OVER (PARTITION BY key, owner ORDER BY q) AS g FROM (
    SELECT key, owner, CAST(substr(period, 1, 4) AS BIGINT) * 4 + CAST(substr(period, 7, 1) AS BIGINT) AS q FROM snap WHERE status = 3))
  GROUP BY key, owner, g)"""


@query("disconnect_runs", with_snap(RUNS_SQL, "SELECT * FROM runs", "R"))
def _(spark, d):
    return episodes.disconnect_runs(snapshot(spark, d, "R"))


@query("episode_histogram", with_snap(RUNS_SQL, "SELECT owner, duration, count(*) AS n_events FROM runs GROUP BY 1, 2", "R"))
def _(spark, d):
    return episodes.episode_histogram(episodes.disconnect_runs(snapshot(spark, d, "R")))


@query(
    "episode_summary",
    with_snap(
        RUNS_SQL + """,
s AS (SELECT owner, count(*) FILTER (WHERE duration <= 2) AS n_abbreviated, count(*) FILTER (WHERE duration >= 3) AS n_standard, count(*) AS n_total
  FROM runs GROUP BY owner)""",
        """SELECT *, n_abbreviated / n_total AS abbrev_rate, CASE WHEN n_abbreviated / n_total > 0.6 THEN 'early'
        WHEN n_abbreviated / n_total < 0.3 THEN 'normal' END AS label FROM s""",
        "R",
    ),
)
def _(spark, d):
    return episodes.episode_summary(episodes.disconnect_runs(snapshot(spark, d, "R")))


@query(
    "history_timeline",
    with_snap(
        """f AS (SELECT *, CASE WHEN lag(owner) OVER w = owner AND lag(status) OVER w = status THEN 0 ELSE 1 END AS starts FROM snap
          WINDOW w AS (PARTITION BY key ORDER BY period)),
        p AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY key ORDER BY period) AS BIGINT) AS part FROM f),
        g AS (SELECT key, part, min(period) AS start_period, max(period) AS end_period, any_value(owner) AS owner,
          arg_min(sub_owner, period) AS sub_owner, any_value(CASE status WHEN 1 THEN 'WORKING' WHEN 2 THEN 'TRANSIT' ELSE 'DISCONN' END) AS status,
          CAST(arg_min(changed_at, period) AS VARCHAR) AS last_change FROM p GROUP BY key, part)""",
        "SELECT *, part = max(part) OVER (PARTITION BY key) AS is_current FROM g",
        "R",
    ),
)
def _(spark, d):
    """Histories of all keys at once."""
    return episodes.history_timeline(snapshot(spark, d, "R"))


TRAJ_GROUP_SQL = ROLLUP_SQL + f",{GROUPS_SQL}"


@query(
    "group_rank",
    with_snap(
        f"{LATEST_SQL},{GROUPS_SQL}",
        """SELECT "group", n AS inventory, row_number() OVER (ORDER BY n DESC, "group") AS rank, count(*) OVER () AS total,
        n / nullif(max(n) OVER (), 0) AS pct FROM (SELECT "group", count(l.owner) AS n FROM gmember g LEFT JOIN latest l ON l.owner = g.owner GROUP BY 1)""",
    ),
)
def _(spark, d):
    latest = rollup.owner_inventory(rollup.latest_snapshot(*dated(spark, d)))
    return directory.group_rank(latest, group_membership(spark, d))
