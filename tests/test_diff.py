"""One-pass diff, flow graph and roll-up against hand-made and random snapshots."""

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import diff, directory, episodes, flows, ranks, rollup

SCHEMA = "key long, period string, owner string, status int, sub_owner string, segment int, changed_at date"


def snap(spark, data):
    return spark.createDataFrame([(k, p, o, s, o + "A01", 800, None) for k, p, o, s in data], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    """Keys 1-9 over three months of which the second file is missing (2025-02)."""
    return snap(
        spark,
        [
            (1, "2025-01", "AA", 1), (1, "2025-03", "AA", 1),  # unchanged
            (2, "2025-01", "AA", 1), (2, "2025-03", "BB", 1),  # transfer
            (3, "2025-01", "AA", 3), (3, "2025-03", "BB", 1),  # landing
            (4, "2025-01", "AA", 3), (4, "2025-03", "AA", 1),  # reactivation
            (5, "2025-01", "AA", 1), (5, "2025-03", "AA", 3),  # disconnect
            (6, "2025-01", "AA", 3), (6, "2025-03", "AA", 4),  # other change, in no bucket
            (7, "2025-01", "CC", 1),  # gone, and its owner with it
            (8, "2025-03", "BB", 1),  # new
            (9, "2025-01", "AA", 1), (9, "2025-04", "AA", 1),  # away for one file
        ],
    )


def test_pair_totals(small):
    got = {r["curr_period"]: r for r in diff.pair_totals(small).collect()}
    march = got["2025-03"].asDict()
    assert march == {
        "prev_period": "2025-01", "curr_period": "2025-03", "months_covered": 2, "transfers": 2, "landings": 1,
        "reactivations": 1, "appeared": 1, "disappeared": 2, "unchanged": 1,
    }
    april = got["2025-04"]
    assert (april["appeared"], april["disappeared"], april["months_covered"]) == (1, 7, 1)


def test_vanished_owner_and_baseline(small):
    got = {(r["owner"], r["period"]): r for r in rollup.owner_period_rollup(small).collect()}
    assert got[("CC", "2025-03")]["inventory"] == 0
    assert got[("CC", "2025-03")]["lost"] == 1
    first = got[("AA", "2025-01")]
    assert (first["inventory"], first["acquired"], first["lost"], first["months_covered"]) == (7, 0, 0, 0)
    march = got[("BB", "2025-03")]
    assert (march["acquired"], march["transfers_in"], march["harvested_cross_owner"]) == (3, 2, 1)


def test_flow_edges(small):
    edges = flows.flow_edges(small).where("curr_period = '2025-03'")
    got = {(r["edge_type"], r["from_node"], r["to_node"], r["former_owner"]): r["n"] for r in edges.collect()}
    assert got == {
        ("TRANSFER", "AA", "BB", None): 1,
        ("HARVEST", "DISC", "BB", "AA"): 1,
        ("REACTIVATE", "DISC", "AA", None): 1,
        ("DISCONNECT", "AA", "DISC", None): 1,
        ("TO_SPARE", "AA", "SPARE", None): 1,
        ("TO_SPARE", "CC", "SPARE", None): 1,
        ("FIRST_ASSIGN", "SPARE", "BB", None): 1,
    }


def test_flow_totals_do_not_multiply(spark):
    edges = spark.createDataFrame(
        [
            ("2025-03", "X", "Y", "TRANSFER", None, 10), ("2025-03", "DISC", "Y", "HARVEST", "Z", 5),
            ("2025-03", "Y", "X", "TRANSFER", None, 3), ("2025-03", "Y", "DISC", "DISCONNECT", None, 4),
            ("2025-03", "Y", "SPARE", "TO_SPARE", None, 2),
        ],
        "curr_period string, from_node string, to_node string, edge_type string, former_owner string, n long",
    )
    for totals in (flows.flow_totals(edges), flows.flow_totals_join(edges)):
        y = totals.where("owner = 'Y'").first()
        assert (y["inbound_transfer"], y["inbound_harvest"], y["outbound_transfer"]) == (10, 5, 3)
        assert (y["outbound_disconnect"], y["outbound_to_spare"]) == (4, 2)
    assert flows.top_partners(edges, 1).where("owner = 'Y'").count() == 2


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(7)
    data = []
    for key in range(300):
        for month in range(1, 9):
            if rng.random() < 0.6:
                data.append((key, f"2024-{month:02d}", rng.choice(["AA", "BB", "CC"]), rng.choice([1, 2, 3])))
    return snap(spark, data)


def test_one_pass_equals_pairwise_full_joins(noisy):
    changes = diff.pair_changes(noisy).select("key", "idx", "prev_owner", "prev_status", "owner", "status")
    indexed = diff.with_period_index(noisy)
    last = indexed.first()["n_periods"]
    pairs = None
    for i in range(1, last):
        one = diff.full_diff(indexed.where(F.col("idx") == i), indexed.where(F.col("idx") == i + 1))
        one = one.select("key", F.lit(i + 1).cast("long").alias("idx"), "prev_owner", "prev_status", "owner", "status")
        pairs = one if pairs is None else pairs.unionByName(one)
    assert changes.exceptAll(pairs).count() == 0
    assert pairs.exceptAll(changes).count() == 0


def test_invariants(noisy):
    totals = diff.pair_totals(noisy).agg(F.sum("appeared") - F.sum("disappeared")).first()[0]
    ends = noisy.where("period = '2024-08'").count() - noisy.where("period = '2024-01'").count()
    assert totals == ends
    edges = flows.flow_edges(noisy)
    changed = diff.changed_only(diff.pair_changes(noisy))
    named = changed.where(flows.edge_type().isNotNull()).count()
    assert edges.agg(F.sum("n")).first()[0] == named
    both = flows.flow_totals(edges).agg(F.sum("inbound_transfer"), F.sum("outbound_transfer")).first()
    assert both[0] == both[1]
    runs = episodes.disconnect_runs(noisy)
    assert runs.agg(F.sum("duration")).first()[0] == noisy.where("status = 3").count()


def test_runs_break_at_a_gap_and_timelines_do_not(spark):
    rows = snap(spark, [(1, "2025-01", "AA", 3), (1, "2025-03", "AA", 3), (1, "2025-04", "AA", 3), (1, "2025-05", "AA", 1)])
    assert sorted(r["duration"] for r in episodes.disconnect_runs(rows).collect()) == [1, 2]
    line = episodes.history_timeline(rows).orderBy("part").collect()
    assert [(r["start_period"], r["end_period"], r["status"], r["is_current"]) for r in line] == [
        ("2025-01", "2025-04", "DISCONN", False),
        ("2025-05", "2025-05", "WORKING", True),
    ]


def test_code_level_transfer_within_an_owner(spark):
    rows = spark.createDataFrame(
        [(1, "2025-01", "AA", 3, "AA001", 800, None), (1, "2025-02", "AA", 1, "AA002", 800, None)], SCHEMA
    )
    assert diff.pair_totals(rows).first()["transfers"] == 0
    fine = diff.code_level_totals(rows).first()
    assert (fine["transfers"], fine["landings"]) == (1, 0)


def test_fate(small):
    idx = diff.with_period_index(small)
    fate = diff.owner_fate(idx.where("idx = 1"), idx.where("idx = 2"))
    got = {r["destination"]: r["n"] for r in diff.fate_breakdown(fate).where("prev_owner = 'AA'").collect()}
    assert got == {"(vanished)": 1, "(still)": 4, "BB": 2}


def test_dormant(spark):
    facts = [("AA", "2025-01", 14), ("AA", "2025-02", 14), ("BB", "2025-01", 14), ("CC", "2025-01", 15), ("CC", "2025-02", 14),
             ("DD", "2025-01", 3), ("DD", "2025-02", 3)]
    rolled = spark.createDataFrame(facts, "owner string, period string, inventory long")
    docs = spark.createDataFrame(
        [(i, o + "A01", [{"_ref": r}] if r else []) for i, (o, r) in enumerate(
            [("AA", None), ("BB", "x"), ("CC", None), ("DD", "dead"), ("EE", None), ("1Z", None)])],
        "doc_no long, code string, categories array<struct<_ref: string>>",
    )
    got = {r["owner"] for r in directory.dormant_owners(rolled, docs, "dead", 2).collect()}
    assert got == {"AA", "BB", "EE"}


def test_rank_with_ties(spark):
    values = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", None)], "owner string, value long")
    got = {r["owner"]: (r["v_rank"], r["v_total"]) for r in ranks.rank_with_total(values, "v").collect()}
    assert got == {"a": (1, 4), "b": (1, 4), "c": (3, 4), "d": (4, 4)}


def test_sampled_trajectory(spark):
    rolled = spark.createDataFrame([("a", f"{i:04d}", i) for i in range(42)], "owner string, period string, inventory long")
    kept = [r["inventory"] for r in ranks.sampled_trajectory(rolled).orderBy("period").collect()]
    assert kept == list(range(0, 42, 3)) + [41]
