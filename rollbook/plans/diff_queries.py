"""Snapshot differences, roll-ups and the flow graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.operators import diff, flows, maintain, rollup
from rollbook.plans.base import (
    CHANGES_SQL,
    EDGES_SQL,
    GROUPS_SQL,
    ROLLUP_SQL,
    dated,
    group_membership,
    query,
    snapshot,
    with_snap,
)
from rollbook.session import materialise, scratch_path
from rollbook.sources import sinks

PAIR_SELECT = """SELECT q.period AS prev_period, p.period AS curr_period, p.mno - q.mno AS months_covered,
  count(*) FILTER (WHERE a_owner <> b_owner) AS transfers,
  count(*) FILTER (WHERE a_owner <> b_owner AND a_st = 3) AS landings,
  count(*) FILTER (WHERE a_owner = b_owner AND a_st = 3 AND b_st = 1) AS reactivations,
  count(*) FILTER (WHERE a_owner IS NULL) AS appeared,
  count(*) FILTER (WHERE b_owner IS NULL) AS disappeared,
  count(*) FILTER (WHERE a_owner = b_owner AND a_st = b_st) AS unchanged
FROM chg JOIN per p USING (idx) JOIN per q ON q.idx = p.idx - 1 GROUP BY 1, 2, 3"""


@query("pair_totals", with_snap(CHANGES_SQL, PAIR_SELECT, "R"))
def _(spark, d):
    return diff.pair_totals(*dated(spark, d, "R"))


@query("pair_totals_by_nation", with_snap(CHANGES_SQL, PAIR_SELECT, "N"))
def _(spark, d):
    return diff.pair_totals(*dated(spark, d, "N"))


FULL_OUTER_SQL = with_snap(
    CHANGES_SQL,
    """SELECT idx, count(*) AS n, count(a_owner) AS n_prev, count(b_owner) AS n_curr,
    count(*) FILTER (WHERE a_owner IS NOT NULL AND b_owner IS NOT NULL) AS n_both FROM chg GROUP BY idx""",
    "R",
)


def full_outer_counts(rows: DataFrame) -> DataFrame:
    """Rows of every pair of periods by the side they are on, by a join of the pairs."""
    both = diff.full_diff(diff.shifted(rows), rows.where(F.col("idx") > 1), ["key", "idx"])
    return both.groupBy("idx").agg(
        F.count("*").alias("n"),
        F.count("prev_owner").alias("n_prev"),
        F.count("owner").alias("n_curr"),
        F.count_if(F.col("prev_owner").isNotNull() & F.col("owner").isNotNull()).alias("n_both"),
    )


@query("snapshot_diff_full_outer", FULL_OUTER_SQL)
def _(spark, d):
    return full_outer_counts(diff.with_period_index(*dated(spark, d, "R")))


def bucketed(spark: SparkSession, d: str, owner: str) -> DataFrame:
    """The snapshot as a table in buckets by key, as a load would keep it. As many buckets as
    the cluster has shuffle partitions."""
    name, buckets = f"snapshot_{uuid.uuid4().hex[:12]}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    sinks.write_bucketed(snapshot(spark, d, owner), name, buckets, scratch_path(spark, name))
    return sinks.bucketed_table(spark, name)


@query("snapshot_diff_bucketed", FULL_OUTER_SQL)
def _(spark, d):
    return full_outer_counts(diff.with_period_index(bucketed(spark, d, "R")))


@query("pair_totals_bucketed", with_snap(CHANGES_SQL, PAIR_SELECT, "R"))
def _(spark, d):
    return diff.pair_totals(bucketed(spark, d, "R"))


@query("flow_edges_bucketed", with_snap(EDGES_SQL, "SELECT * FROM edges", "R"))
def _(spark, d):
    return flows.flow_edges(bucketed(spark, d, "R"))


@query(
    "transfers_inner",
    with_snap(
        "",
        """SELECT b.idx, a.owner AS from_owner, b.owner AS to_owner, count(*) AS n
        FROM snap a JOIN snap b ON a.key = b.key AND a.idx + 1 = b.idx AND a.owner <> b.owner GROUP BY 1, 2, 3""",
    ),
)
def _(spark, d):
    rows = diff.with_period_index(*dated(spark, d))
    moved = diff.transfers(diff.shifted(rows), rows, ["key", "idx"])
    return moved.groupBy("idx", F.col("prev_owner").alias("from_owner"), F.col("owner").alias("to_owner")).agg(
        F.count("*").alias("n")
    )


@query(
    "appeared_anti",
    with_snap(
        "",
        """SELECT b.idx, b.owner, count(*) AS n FROM snap b WHERE b.idx > 1
        AND NOT EXISTS (SELECT 1 FROM snap a WHERE a.key = b.key AND a.idx + 1 = b.idx) GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    rows = diff.with_period_index(*dated(spark, d))
    new = diff.appeared(diff.shifted(rows), rows.where(F.col("idx") > 1), ["key", "idx"])
    return new.groupBy("idx", "owner").agg(F.count("*").alias("n"))


FATE_SQL = """
fate AS (SELECT a.idx + 1 AS idx, a.key, a.owner AS prev_owner, a.status AS prev_status, b.owner, b.status
  FROM snap a LEFT JOIN snap b ON a.key = b.key AND a.idx + 1 = b.idx WHERE a.idx < (SELECT max(idx) FROM snap))"""


@query(
    "owner_fate_left",
    with_snap(
        FATE_SQL,
        """SELECT prev_owner, prev_status, count(*) AS n, count(owner) AS n_found,
        count(*) FILTER (WHERE owner <> prev_owner) AS n_moved FROM fate GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    rows = diff.with_period_index(*dated(spark, d))
    fate = diff.owner_fate(diff.shifted(rows), rows, ["key", "idx"])
    return fate.groupBy("prev_owner", "prev_status").agg(
        F.count("*").alias("n"),
        F.count("owner").alias("n_found"),
        F.count_if(F.col("owner") != F.col("prev_owner")).alias("n_moved"),
    )


@query(
    "fate_breakdown",
    with_snap(
        FATE_SQL,
        """SELECT idx, prev_owner, CASE WHEN owner IS NULL THEN '(vanished)' WHEN owner = prev_owner THEN '(still)' ELSE owner END AS destination,
        count(*) AS n, count(*) FILTER (WHERE prev_status = 3) AS from_disconn, count(*) FILTER (WHERE prev_status = 1) AS from_working,
        count(*) FILTER (WHERE status = 3) AS to_disconn, count(*) FILTER (WHERE status = 1) AS to_working
        FROM fate GROUP BY 1, 2, 3""",
        "R",
    ),
)
def _(spark, d):
    rows = diff.with_period_index(*dated(spark, d, "R"))
    return diff.fate_breakdown(diff.owner_fate(diff.shifted(rows), rows, ["key", "idx"]), "idx")


@query(
    "changed_only",
    with_snap(
        CHANGES_SQL,
        """SELECT idx, count(*) AS n FROM chg
        WHERE NOT coalesce(a_owner = b_owner AND a_st = b_st, false) GROUP BY idx""",
        "R",
    ),
)
def _(spark, d):
    changed = diff.changed_only(diff.pair_changes(*dated(spark, d, "R")))
    return changed.groupBy("idx").agg(F.count("*").alias("n"))


@query("owner_month_rollup", with_snap(ROLLUP_SQL, "SELECT * FROM roll"))
def _(spark, d):
    return rollup.owner_period_rollup(*dated(spark, d))


@query("flow_edges", with_snap(EDGES_SQL, "SELECT * FROM edges", "R"))
def _(spark, d):
    return flows.flow_edges(*dated(spark, d, "R"))


def loaded_in_steps(spark: SparkSession, d: str, owner: str, build: maintain.Build, period_col: str) -> DataFrame:
    """A derived table after two loads. The first lacks a period in the middle and the last
    one and holds a third in another state; the second brings these three."""
    rows = materialise(snapshot(spark, d, owner), "loads")
    calendar = sorted(r["period"] for r in rows.select("period").distinct().collect())
    late, replaced, last = calendar[len(calendar) // 2], calendar[len(calendar) // 3], calendar[-1]
    snapshots, target = scratch_path(spark, "snapshots"), scratch_path(spark, "derived")
    earlier = F.col("period") == replaced
    stale = rows.withColumns({"owner": F.when(earlier, F.lit("??")).otherwise(F.col("owner")), "status": F.when(earlier, 3).otherwise(F.col("status"))})
    sinks.replace_periods(stale.where(~F.col("period").isin(late, last)), snapshots)
    maintain.refresh(spark, snapshots, target, build, [p for p in calendar if p not in (late, last)], period_col)
    sinks.replace_periods(rows.where(F.col("period").isin(late, replaced, last)), snapshots)
    maintain.refresh(spark, snapshots, target, build, [late, replaced, last], period_col)
    return spark.read.parquet(target)


@query("incremental_rollup", with_snap(ROLLUP_SQL, "SELECT * FROM roll"))
def _(spark, d):
    return loaded_in_steps(spark, d, "N", rollup.owner_period_rollup, "period")


@query("incremental_flow_edges", with_snap(EDGES_SQL, "SELECT * FROM edges", "R"))
def _(spark, d):
    return loaded_in_steps(spark, d, "R", flows.flow_edges, "curr_period")


@query("incremental_pair_totals", with_snap(CHANGES_SQL, PAIR_SELECT, "R"))
def _(spark, d):
    return loaded_in_steps(spark, d, "R", diff.pair_totals, "curr_period")


@query(
    "partner_flows",
    with_snap(
        CHANGES_SQL,
        """SELECT p.period AS curr_period, a_owner AS from_owner, b_owner AS to_owner, count(*) AS n_transfers,
        count(*) FILTER (WHERE a_st = 3) AS n_from_disconn
        FROM chg JOIN per p USING (idx) WHERE a_owner <> b_owner GROUP BY 1, 2, 3""",
    ),
)
def _(spark, d):
    return flows.partner_flows(*dated(spark, d))


TOTALS_SELECT = """SELECT owner,
  CAST(coalesce(sum(n) FILTER (WHERE side = 'in' AND edge_type = 'TRANSFER'), 0) AS BIGINT) AS inbound_transfer,
  CAST(coalesce(sum(n) FILTER (WHERE side = 'in' AND edge_type = 'HARVEST'), 0) AS BIGINT) AS inbound_harvest,
  CAST(coalesce(sum(n) FILTER (WHERE side = 'in' AND edge_type = 'FIRST_ASSIGN'), 0) AS BIGINT) AS inbound_first_assign,
  CAST(coalesce(sum(n) FILTER (WHERE side = 'in' AND edge_type = 'REACTIVATE'), 0) AS BIGINT) AS inbound_reactivate,
  CAST(coalesce(sum(n) FILTER (WHERE side = 'out' AND edge_type = 'TRANSFER'), 0) AS BIGINT) AS outbound_transfer,
  CAST(coalesce(sum(n) FILTER (WHERE side = 'out' AND edge_type = 'DISCONNECT'), 0) AS BIGINT) AS outbound_disconnect,
  CAST(coalesce(sum(n) FILTER (WHERE side = 'out' AND edge_type = 'TO_SPARE'), 0) AS BIGINT) AS outbound_to_spare
FROM (SELECT to_node AS owner, 'in' AS side, edge_type, n FROM edges
      UNION ALL SELECT from_node, 'out', edge_type, n FROM edges) GROUP BY owner"""


@query("flow_totals", with_snap(EDGES_SQL, TOTALS_SELECT))
def _(spark, d):
    return flows.flow_totals(flows.flow_edges(*dated(spark, d)))


@query("flow_totals_join", with_snap(EDGES_SQL, TOTALS_SELECT, "R"))
def _(spark, d):
    return flows.flow_totals_join(flows.flow_edges(*dated(spark, d, "R")))


@query(
    "node_union",
    with_snap(EDGES_SQL, "SELECT from_node AS owner FROM edges UNION SELECT to_node FROM edges", "R"),
)
def _(spark, d):
    return flows.node_union(flows.flow_edges(*dated(spark, d, "R")))


DIRECTIONS_SQL = """,
dirs AS (SELECT direction, owner, partner, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'in' AS direction, to_node AS owner, from_node AS partner, n FROM edges WHERE edge_type = 'TRANSFER'
  UNION ALL SELECT 'out', from_node, to_node, n FROM edges WHERE edge_type = 'TRANSFER') GROUP BY 1, 2, 3)"""


@query("direction_union", with_snap(EDGES_SQL + DIRECTIONS_SQL, "SELECT * FROM dirs"))
def _(spark, d):
    return flows.direction_union(flows.flow_edges(*dated(spark, d)))


@query(
    "topk_partners",
    with_snap(
        EDGES_SQL + DIRECTIONS_SQL,
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction, owner ORDER BY n DESC, partner) AS ord FROM dirs)
        WHERE ord <= 10""",
    ),
)
def _(spark, d):
    return flows.top_partners(flows.flow_edges(*dated(spark, d)))


@query(
    "harvest_origins",
    with_snap(
        EDGES_SQL,
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, former_owner) AS ord FROM (
          SELECT to_node AS owner, former_owner, CAST(sum(n) AS BIGINT) AS n FROM edges
          WHERE edge_type = 'HARVEST' AND former_owner IS NOT NULL GROUP BY 1, 2)) WHERE ord <= 10""",
    ),
)
def _(spark, d):
    return flows.harvest_origins(flows.flow_edges(*dated(spark, d)))


EXTERNAL_SQL = GROUPS_SQL + """,
ends AS (
  SELECT 'in' AS direction, to_node AS owner, from_node AS partner, n FROM edges WHERE edge_type = 'TRANSFER'
  UNION ALL SELECT 'out', from_node, to_node, n FROM edges WHERE edge_type = 'TRANSFER'
  UNION ALL SELECT 'harvest', to_node, former_owner, n FROM edges WHERE edge_type = 'HARVEST'),
ext AS (SELECT direction, "group", partner, CAST(sum(n) AS BIGINT) AS n FROM ends JOIN gmember g USING (owner)
  WHERE NOT EXISTS (SELECT 1 FROM gmember h WHERE h."group" = g."group" AND h.owner = partner) GROUP BY 1, 2, 3)"""


@query("external_edges", with_snap(f"{EDGES_SQL},{EXTERNAL_SQL}", "SELECT * FROM ext"))
def _(spark, d):
    return flows.external_flows(flows.flow_edges(*dated(spark, d)), group_membership(spark, d))


@query(
    "external_partners",
    with_snap(
        f"{EDGES_SQL},{EXTERNAL_SQL}",
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction, "group" ORDER BY n DESC, partner) AS ord FROM ext)
        WHERE ord <= 12""",
    ),
)
def _(spark, d):
    return flows.top_external(flows.flow_edges(*dated(spark, d)), group_membership(spark, d))


@query(
    "segment_level_diff",
    with_snap(
        CHANGES_SQL,
        """SELECT q.period AS prev_period, p.period AS curr_period, p.mno - q.mno AS months_covered,
        count(*) FILTER (WHERE a_sub <> b_sub) AS transfers,
        count(*) FILTER (WHERE a_sub <> b_sub AND a_st = 3 AND a_owner <> b_owner) AS landings,
        count(*) FILTER (WHERE a_sub = b_sub AND a_st = 3 AND b_st = 1) AS reactivations,
        count(*) FILTER (WHERE a_sub IS NULL) AS appeared, count(*) FILTER (WHERE b_sub IS NULL) AS disappeared,
        count(*) FILTER (WHERE a_sub = b_sub AND a_st <> b_st) AS status_changed,
        count(*) FILTER (WHERE a_sub = b_sub AND a_st = b_st) AS unchanged
        FROM chg JOIN per p USING (idx) JOIN per q ON q.idx = p.idx - 1 GROUP BY 1, 2, 3""",
    ),
)
def _(spark, d):
    return diff.code_level_totals(*dated(spark, d))


@query(
    "segment_level_status_pairs",
    with_snap(
        CHANGES_SQL,
        "SELECT a_st AS prev_status, b_st AS status, count(*) AS n FROM chg WHERE a_sub = b_sub AND a_st <> b_st GROUP BY 1, 2",
    ),
)
def _(spark, d):
    return diff.code_level_status_pairs(*dated(spark, d))


CODE_FLOWS_SQL = CHANGES_SQL + """,
cflow AS (SELECT idx, owner, CAST(sum(acquired) AS BIGINT) AS acquired, CAST(sum(harvested) AS BIGINT) AS harvested, CAST(sum(lost) AS BIGINT) AS lost FROM (
  SELECT idx, b_owner AS owner, 1 AS acquired, CASE WHEN a_st = 3 AND a_owner <> b_owner THEN 1 ELSE 0 END AS harvested, 0 AS lost
  FROM chg WHERE b_sub IS NOT NULL AND (a_sub IS NULL OR a_sub <> b_sub)
  UNION ALL SELECT idx, a_owner, 0, 0, 1 FROM chg WHERE a_sub IS NOT NULL AND (b_sub IS NULL OR a_sub <> b_sub)) GROUP BY 1, 2)"""


@query("segment_level_owner_flows", with_snap(CODE_FLOWS_SQL, "SELECT * FROM cflow"))
def _(spark, d):
    return diff.code_level_owner_flows(*dated(spark, d))


@query(
    "harvest_leaders",
    with_snap(
        CODE_FLOWS_SQL,
        """SELECT owner, CAST(sum(acquired) AS BIGINT) AS acquired, CAST(sum(harvested) AS BIGINT) AS harvested, CAST(sum(lost) AS BIGINT) AS lost,
        CAST(sum(harvested) AS DOUBLE) / nullif(sum(acquired), 0) AS opportunism FROM cflow GROUP BY owner
        ORDER BY harvested DESC, owner LIMIT 20""",
    ),
)
def _(spark, d):
    sums = diff.code_level_owner_flows(*dated(spark, d)).groupBy("owner").agg(
        F.sum("acquired").alias("acquired"), F.sum("harvested").alias("harvested"), F.sum("lost").alias("lost")
    )
    index = F.col("harvested").cast("double") / F.nullif(F.col("acquired"), F.lit(0))
    return sums.withColumn("opportunism", index).orderBy(F.desc("harvested"), "owner").limit(20)


@query(
    "net_flow_leaders",
    with_snap(
        CODE_FLOWS_SQL,
        """SELECT owner, net, side FROM (
        SELECT owner, net, 'top' AS side, row_number() OVER (ORDER BY net DESC, owner) AS ord FROM
          (SELECT owner, CAST(sum(acquired) - sum(lost) AS BIGINT) AS net FROM cflow GROUP BY owner)
        UNION ALL
        SELECT owner, net, 'bottom', row_number() OVER (ORDER BY net, owner DESC) FROM
          (SELECT owner, CAST(sum(acquired) - sum(lost) AS BIGINT) AS net FROM cflow GROUP BY owner)) WHERE ord <= 10""",
    ),
)
def _(spark, d):
    net = (
        diff.code_level_owner_flows(*dated(spark, d))
        .groupBy("owner")
        .agg((F.sum("acquired") - F.sum("lost")).alias("net"))
    )
    top = net.orderBy(F.desc("net"), "owner").limit(10).withColumn("side", F.lit("top"))
    bottom = net.orderBy("net", F.desc("owner")).limit(10).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


# Reports on the newest pair of snapshots.
LAST_PAIR_SQL = """
a AS (SELECT * FROM snap WHERE idx = (SELECT max(idx) - 1 FROM snap)),
b AS (SELECT * FROM snap WHERE idx = (SELECT max(idx) FROM snap))"""


def _last_pair(spark, d, owner="N", segment=False):
    rows = diff.with_period_index(*dated(spark, d, owner, segment))
    return rows.where(F.col("idx") == F.col("n_periods") - 1), rows.where(F.col("idx") == F.col("n_periods"))


@query(
    "event_totals",
    with_snap(
        LAST_PAIR_SQL,
        """SELECT count(*) FILTER (WHERE a.owner IS NULL) AS appeared, count(*) FILTER (WHERE b.owner IS NULL) AS disappeared,
        count(*) FILTER (WHERE a.owner <> b.owner) AS transfers, count(*) FILTER (WHERE a.owner <> b.owner AND a.status = 3) AS landings
        FROM a FULL OUTER JOIN b ON a.key = b.key""",
    ),
)
def _(spark, d):
    return diff.event_totals(*_last_pair(spark, d))


@query(
    "appeared_by_owner",
    with_snap(
        LAST_PAIR_SQL,
        """SELECT owner, count(*) AS n FROM b WHERE key NOT IN (SELECT key FROM a) GROUP BY owner
        ORDER BY n DESC, owner LIMIT 15""",
    ),
)
def _(spark, d):
    new = diff.appeared(*_last_pair(spark, d))
    return new.groupBy("owner").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "owner").limit(15)


@query(
    "appeared_by_segment",
    with_snap(
        LAST_PAIR_SQL,
        "SELECT segment, count(*) AS n FROM b WHERE key NOT IN (SELECT key FROM a) GROUP BY segment",
        segment=True,
    ),
)
def _(spark, d):
    new = diff.appeared(*_last_pair(spark, d, segment=True))
    return new.groupBy("segment").agg(F.count("*").alias("n"))


GAINS_SQL = LAST_PAIR_SQL + """,
gain AS (SELECT coalesce(c.owner, p.owner) AS owner, coalesce(p.n, 0) AS prev_n, coalesce(c.n, 0) AS curr_n,
  coalesce(c.n, 0) - coalesce(p.n, 0) AS delta
  FROM (SELECT owner, count(*) AS n FROM a GROUP BY owner) p FULL OUTER JOIN (SELECT owner, count(*) AS n FROM b GROUP BY owner) c
  ON p.owner = c.owner)"""


def _gains(spark, d):
    """Two counts per owner from one scan of the last two periods."""
    rows = diff.with_period_index(*dated(spark, d)).where(F.col("idx") >= F.col("n_periods") - 1)
    newest = F.col("idx") == F.col("n_periods")
    counts = rows.groupBy("owner").agg(F.count_if(~newest).alias("prev_n"), F.count_if(newest).alias("curr_n"))
    return counts.withColumn("delta", F.col("curr_n") - F.col("prev_n"))


@query("gainers_full_outer", with_snap(GAINS_SQL, "SELECT * FROM gain"))
def _(spark, d):
    return _gains(spark, d)


@query("top_gainers", with_snap(GAINS_SQL, "SELECT * FROM gain ORDER BY delta DESC, owner LIMIT 20"))
def _(spark, d):
    return _gains(spark, d).orderBy(F.desc("delta"), "owner").limit(20)


@query("top_losers", with_snap(GAINS_SQL, "SELECT * FROM gain ORDER BY delta, owner LIMIT 20"))
def _(spark, d):
    return _gains(spark, d).orderBy("delta", "owner").limit(20)


@query(
    "top_transfers",
    with_snap(
        LAST_PAIR_SQL,
        """SELECT a.owner AS from_owner, b.owner AS to_owner, count(*) AS n, count(*) FILTER (WHERE a.status = 3) AS from_disconn
        FROM a JOIN b ON a.key = b.key WHERE a.owner <> b.owner GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15""",
    ),
)
def _(spark, d):
    moved = diff.transfers(*_last_pair(spark, d))
    counts = moved.groupBy(F.col("prev_owner").alias("from_owner"), F.col("owner").alias("to_owner")).agg(
        F.count("*").alias("n"), F.count_if(F.col("prev_status") == 3).alias("from_disconn")
    )
    return counts.orderBy(F.desc("n"), "from_owner", "to_owner").limit(15)


@query(
    "month_drop_lag",
    with_snap(
        ROLLUP_SQL,
        """SELECT owner, period, prev, inventory, drop FROM (
        SELECT owner, period, prev, inventory, prev - inventory AS drop,
               row_number() OVER (PARTITION BY owner ORDER BY prev - inventory DESC, period) AS ord
        FROM (SELECT owner, period, inventory, lag(inventory) OVER (PARTITION BY owner ORDER BY period) AS prev FROM roll)
        WHERE prev IS NOT NULL) WHERE ord <= 3""",
    ),
)
def _(spark, d):
    """The three largest drops of every owner."""
    by_owner = Window.partitionBy("owner")
    series = rollup.owner_period_rollup(*dated(spark, d)).select("owner", "period", "inventory")
    drops = (
        series.withColumn("prev", F.lag("inventory").over(by_owner.orderBy("period")))
        .where(F.col("prev").isNotNull())
        .withColumn("drop", F.col("prev") - F.col("inventory"))
    )
    ranked = drops.withColumn("ord", F.row_number().over(by_owner.orderBy(F.desc("drop"), "period")))
    return ranked.where(F.col("ord") <= 3).drop("ord")
