"""Flow graph between owners, with the pool nodes DISC and SPARE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.constants import DISC_NODE, DISCONN, SPARE_NODE
from rollbook.operators import diff


def edge_type() -> Column:
    kept = F.col("prev_owner") == F.col("owner")
    falls = kept & (F.col("prev_status") != DISCONN) & (F.col("status") == DISCONN)
    return (
        F.when(diff.is_appeared(), "FIRST_ASSIGN")
        .when(diff.is_disappeared(), "TO_SPARE")
        .when(diff.is_reactivation(), "REACTIVATE")
        .when(falls, "DISCONNECT")
        .when(diff.is_landing(), "HARVEST")
        .when(diff.is_transfer(), "TRANSFER")
    )


def _named(per_idx: DataFrame, periods: DataFrame) -> DataFrame:
    names = periods.select("idx", F.col("period").alias("curr_period"))
    return per_idx.join(F.broadcast(names), "idx").drop("idx")


def flow_edges(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Counted edges per period. Keys that changed in no named way are left out."""
    named = (
        diff.changed_only(diff.pair_changes(snapshot, periods))
        .withColumn("edge_type", edge_type())
        .where(F.col("edge_type").isNotNull())
    )
    from_node = (
        F.when(F.col("edge_type") == "FIRST_ASSIGN", SPARE_NODE)
        .when(F.col("edge_type").isin("REACTIVATE", "HARVEST"), DISC_NODE)
        .otherwise(F.col("prev_owner"))
    )
    to_node = (
        F.when(F.col("edge_type") == "TO_SPARE", SPARE_NODE)
        .when(F.col("edge_type") == "DISCONNECT", DISC_NODE)
        .otherwise(F.col("owner"))
    )
    former = F.when(F.col("edge_type") == "HARVEST", F.col("prev_owner"))
    edges = named.groupBy(
        "idx", from_node.alias("from_node"), to_node.alias("to_node"), "edge_type", former.alias("former_owner")
    ).agg(F.count("*").alias("n"))
    return _named(edges, periods or diff.period_index(snapshot))


def partner_flows(snapshot: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Transfers per period and directed pair of owners, and how many left the pool."""
    flows = (
        diff.pair_changes(snapshot, periods)
        .where(diff.is_transfer())
        .groupBy("idx", F.col("prev_owner").alias("from_owner"), F.col("owner").alias("to_owner"))
        .agg(
            F.count("*").alias("n_transfers"),
            F.count_if(F.col("prev_status") == DISCONN).alias("n_from_disconn"),
        )
    )
    return _named(flows, periods or diff.period_index(snapshot))


def _side(edges: DataFrame, node: str, wanted: dict[str, str]) -> DataFrame:
    return edges.groupBy(F.col(node).alias("owner")).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("edge_type") == kind, F.col("n"))), F.lit(0)).alias(name)
            for name, kind in wanted.items()
        ]
    )


def node_union(edges: DataFrame) -> DataFrame:
    """All node names on either end."""
    return edges.select(F.explode(F.array("from_node", "to_node")).alias("owner")).distinct()


INBOUND = {
    "inbound_transfer": "TRANSFER",
    "inbound_harvest": "HARVEST",
    "inbound_first_assign": "FIRST_ASSIGN",
    "inbound_reactivate": "REACTIVATE",
}
OUTBOUND = {
    "outbound_transfer": "TRANSFER",
    "outbound_disconnect": "DISCONNECT",
    "outbound_to_spare": "TO_SPARE",
}


def flow_totals(edges: DataFrame) -> DataFrame:
    """Counts by edge type and direction per node.

    Both directions come from one aggregation over doubled rows, so a node's inbound and
    outbound sums never multiply each other as they would in a join of the two sides.
    """
    ends = F.array(
        F.struct(F.col("to_node").alias("owner"), F.lit("in").alias("side")),
        F.struct(F.col("from_node").alias("owner"), F.lit("out").alias("side")),
    )
    flat = edges.select("edge_type", "n", F.inline(ends))

    def total(side: str, kind: str) -> Column:
        hit = (F.col("side") == side) & (F.col("edge_type") == kind)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    return flat.groupBy("owner").agg(
        *[total("in", k).alias(n) for n, k in INBOUND.items()],
        *[total("out", k).alias(n) for n, k in OUTBOUND.items()],
    )


def flow_totals_join(edges: DataFrame) -> DataFrame:
    """The same by a left join of the node list with each side, one row per node and side."""
    inbound = _side(edges, "to_node", INBOUND)
    outbound = _side(edges, "from_node", OUTBOUND)
    joined = node_union(edges).join(inbound, "owner", "left").join(outbound, "owner", "left")
    return joined.na.fill(0, [*INBOUND, *OUTBOUND])


def direction_union(edges: DataFrame) -> DataFrame:
    """Transfer pairs seen from both ends: (direction, owner, partner, n)."""
    ends = F.array(
        F.struct(F.lit("in").alias("direction"), F.col("to_node").alias("owner"), F.col("from_node").alias("partner")),
        F.struct(F.lit("out").alias("direction"), F.col("from_node").alias("owner"), F.col("to_node").alias("partner")),
    )
    flat = edges.where(F.col("edge_type") == "TRANSFER").select("n", F.inline(ends))
    return flat.groupBy("direction", "owner", "partner").agg(F.sum("n").alias("n"))


def top_partners(edges: DataFrame, k: int = 10) -> DataFrame:
    """The k largest partners per node and direction."""
    w = Window.partitionBy("owner", "direction").orderBy(F.desc("n"), "partner")
    return direction_union(edges).withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)


def harvest_origins(edges: DataFrame, k: int = 10) -> DataFrame:
    """Per owner the k former owners whose disconnected keys it took most."""
    origins = (
        edges.where((F.col("edge_type") == "HARVEST") & F.col("former_owner").isNotNull())
        .groupBy(F.col("to_node").alias("owner"), "former_owner")
        .agg(F.sum("n").alias("n"))
    )
    w = Window.partitionBy("owner").orderBy(F.desc("n"), "former_owner")
    return origins.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)


def external_flows(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Edges that cross the border of a group, for every group at once.

    membership is (group, owner). Returns (direction, group, partner, n) where direction is
    'in', 'out' or 'harvest' and the partner is outside the group.
    """
    ends = F.array(
        F.when(
            F.col("edge_type") == "TRANSFER",
            F.struct(F.lit("in").alias("direction"), F.col("to_node").alias("owner"), F.col("from_node").alias("partner")),
        ),
        F.when(
            F.col("edge_type") == "TRANSFER",
            F.struct(F.lit("out").alias("direction"), F.col("from_node").alias("owner"), F.col("to_node").alias("partner")),
        ),
        F.when(
            (F.col("edge_type") == "HARVEST") & F.col("former_owner").isNotNull(),
            F.struct(
                F.lit("harvest").alias("direction"), F.col("to_node").alias("owner"), F.col("former_owner").alias("partner")
            ),
        ),
    )
    flat = edges.select("n", F.inline(F.filter(ends, lambda e: e.isNotNull())))
    pairs = flat.groupBy("direction", "owner", "partner").agg(F.sum("n").alias("n"))
    members = membership.select("group", "owner").distinct()
    inside = members.select("group", F.col("owner").alias("partner"))
    return (
        pairs.join(members, "owner")
        .join(inside, ["group", "partner"], "left_anti")
        .groupBy("direction", "group", "partner")
        .agg(F.sum("n").alias("n"))
    )


def top_external(edges: DataFrame, membership: DataFrame, k: int = 12) -> DataFrame:
    w = Window.partitionBy("direction", "group").orderBy(F.desc("n"), "partner")
    flows = external_flows(edges, membership)
    return flows.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= k)
