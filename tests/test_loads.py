"""Streams in batches, derived tables kept up load by load, joins over buckets."""

import contextlib
import datetime
import io

import pytest
from conftest import rows
from pyspark.sql import functions as F

from rollbook.operators import diff, flows, maintain, rollup
from rollbook.plans import diff_queries
from rollbook.plans.stream_queries import observations
from rollbook.sources import sinks
from rollbook.streaming import alerts

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"
STATES = {"view": 1, "click": 2, "error": 3, "signup": 4, "purchase": 6}
START = datetime.datetime(2024, 3, 1)


def events(n=400):
    """Events of 7 keys; one in five comes some minutes after it happened."""
    out = []
    for i in range(n):
        late = (i * 7 % 5 == 0) * (i * 13 % 9)
        at = START + datetime.timedelta(minutes=2 * i - late, microseconds=i * 7 % 1000)
        out.append((i, at, i * i % 11, list(STATES)[i * i * 3 % 5]))
    return out + [(n, None, 1, "view"), (n + 1, START, None, "view"), (n + 2, START + datetime.timedelta(minutes=1), 1, "other")]


def expected(data, known):
    ms = [int((e[1] - START).total_seconds() * 1e6) // 1000 for e in data if e[1] and e[2] is not None and e[3] in STATES]
    mark, state, out = max(ms) - 600_000, dict(known), []
    for i, at, key, kind in sorted((e for e in data if e[1]), key=lambda e: (e[1], e[0])):
        if key in state and kind in STATES and int((at - START).total_seconds() * 1e6) // 1000 < mark:
            if state[key] != STATES[kind]:
                out.append((key, at, state[key], STATES[kind]))
            state[key] = STATES[kind]
    return sorted(out)


@pytest.mark.parametrize("cuts", [(400,), (100, 250, 400)])
def test_alerts_of_batches_and_restarts(spark, tmp_path, cuts):
    data, known = events(), {k: 1 + k % 4 for k in range(7)}
    held = spark.createDataFrame([(k, f"o{k}", s) for k, s in known.items()], "key long, owner string, status int")
    source, target, state = (str(tmp_path / x) for x in ("source", "target", "state"))
    begin = 0
    for cut in cuts:  # each run is a restart from the state of the one before
        stop = len(data) if cut == cuts[-1] else cut
        spark.createDataFrame(data[begin:stop], EVENTS).coalesce(1).write.mode("append").parquet(source)
        begin = stop
        stream = alerts.watched(observations(alerts.observation_stream(spark, source, EVENTS)), held)
        alerts.run_once(alerts.status_alerts(stream), target, state).awaitTermination()
    got = spark.read.parquet(target).select("key", "at", "from_status", "to_status").collect()
    assert sorted((r[0], r[1], r[2], r[3]) for r in got) == expected(data, known)
    # nothing is new: nothing comes twice
    alerts.run_once(alerts.status_alerts(alerts.watched(observations(alerts.observation_stream(spark, source, EVENTS)), held)), target, state).awaitTermination()
    assert spark.read.parquet(target).count() == len(got)


def test_alerts_of_many_keys(spark, tmp_path):
    """More keys than groups: the function is called for groups, not for each key. Owners may be
    null, and a key with two owners is watched for both."""
    n, step = 5000, datetime.timedelta(milliseconds=700)
    known = {k: 1 + k % 4 for k in range(n)}
    data = [(i, START + i * step + (i % 3) * 50 * step, i * 7 % n, list(STATES)[i * i % 5]) for i in range(2 * n)]
    owners = [(k, o, s) for k, s in known.items() for o in ((None,) if k % 3 == 0 else ("a", "b") if k % 3 == 1 else ("a",))]
    held = spark.createDataFrame(owners, "key long, owner string, status int")
    source, target, state = (str(tmp_path / x) for x in ("source", "target", "state"))
    spark.createDataFrame(data, EVENTS).coalesce(1).write.parquet(source)
    run = alerts.run_once(alerts.status_alerts(alerts.watched(observations(alerts.observation_stream(spark, source, EVENTS)), held)), target, state)
    run.awaitTermination()
    assert run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 4096 < n
    got = sorted((r.key, r.at, r.from_status, r.to_status, r.owner or "") for r in spark.read.parquet(target).collect())
    by_key = {}
    for k, o, _ in owners:
        by_key.setdefault(k, []).append(o or "")
    assert got == sorted((*r, o) for r in expected(data, known) for o in by_key[r[0]])


def test_windows_in_two_runs(spark, tmp_path):
    data, known = events(), {k: 1 + k % 4 for k in range(7)}
    held = spark.createDataFrame([(k, "o", s) for k, s in known.items()], "key long, owner string, status int")
    source, target, state = (str(tmp_path / x) for x in ("source", "target", "state"))
    for part in (data[:200], data[200:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = alerts.watched(observations(alerts.observation_stream(spark, source, EVENTS)), held)
        alerts.run_once(alerts.window_counts(stream), target, state).awaitTermination()
    got = {(r.window_start, r.status): (r.n, r.n_differ) for r in spark.read.parquet(target).collect()}
    mark, want = max(e[1] for e in data if e[1]) - datetime.timedelta(minutes=10), {}
    for _, at, key, kind in data:
        if at and key in known and kind in STATES and at.replace(minute=0, second=0, microsecond=0) + datetime.timedelta(hours=1) <= mark:
            cell = want.setdefault((at.replace(minute=0, second=0, microsecond=0), STATES[kind]), [0, 0])
            cell[0] += 1
            cell[1] += STATES[kind] != known[key]
    assert got == {k: tuple(v) for k, v in want.items()}


def snapshots(spark, skip=(), owner_of=lambda k, p: (k * 7 + p * (k % 3)) % 5):
    out = [(k, f"2024-{p:02d}", f"o{owner_of(k, p)}", 1 + (k + p) % 3) for p in range(1, 9) if p not in skip for k in range(60) if (k * p + k * k + p) % 7]
    return spark.createDataFrame(out, "key long, period string, owner string, status int")


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("changed", [[8], [4], [1], [2, 3], [5, 8], []])
def test_refresh_is_a_rebuild(spark, tmp_path, changed):
    """Periods that are late, first, last, in a row or replaced."""
    snaps, target, edges = (str(tmp_path / x) for x in ("snaps", "rollup", "edges"))
    full, names = snapshots(spark), [f"2024-{p:02d}" for p in changed]
    builds = ((target, rollup.owner_period_rollup, "period"), (edges, flows.flow_edges, "curr_period"))
    sinks.replace_periods(snapshots(spark, changed, lambda k, p: 9 if p == 6 else (k * 7 + p * (k % 3)) % 5), snaps)
    for path, build, column in builds:
        maintain.refresh(spark, snaps, path, build, [f"2024-{p:02d}" for p in range(1, 9)], column)
    sinks.replace_periods(full.where(F.col("period").isin(*names, "2024-06")), snaps)
    for path, build, column in builds:
        done = maintain.refresh(spark, snaps, path, build, [*names, "2024-06"], column)
        assert set(done) == {f"2024-{p:02d}" for q in (*changed, 6) for p in (q, q + 1) if p < 9}
        whole = build(full, diff.period_index(full))
        assert rows(spark.read.parquet(path), *whole.columns) == rows(whole, *whole.columns)


def test_removed_periods(spark, tmp_path):
    snaps, target = str(tmp_path / "snaps"), str(tmp_path / "edges")
    sinks.replace_periods(snapshots(spark), snaps)
    maintain.refresh(spark, snaps, target, flows.flow_edges, [f"2024-{p:02d}" for p in range(1, 9)], "curr_period")
    sinks.drop_partitions(spark, snaps, "period", ["2024-03", "2024-04", "2024-08", "none"])
    assert maintain.refresh(spark, snaps, target, flows.flow_edges, ["2024-03", "2024-04", "2024-08"], "curr_period") == ["2024-05"]
    left = snapshots(spark, (3, 4, 8))
    whole = flows.flow_edges(left)
    assert rows(spark.read.parquet(target), *whole.columns) == rows(whole, *whole.columns)


def test_refresh_reads_touched_periods_only(spark, tmp_path):
    snaps, seen = str(tmp_path / "snaps"), []

    def build(snapshot, periods):
        seen.append((plan_of(snapshot), {r.period for r in snapshot.select("period").distinct().collect()}))
        return rollup.owner_period_rollup(snapshot, periods)

    sinks.replace_periods(snapshots(spark), snaps)
    maintain.refresh(spark, snaps, str(tmp_path / "t"), build, ["2024-08"])
    maintain.refresh(spark, snaps, str(tmp_path / "u"), build, ["2024-03"])
    assert [s[1] for s in seen] == [{"2024-07", "2024-08"}, {"2024-02", "2024-03", "2024-04"}]
    assert all("PartitionFilters: [period" in s[0] for s in seen)


@pytest.mark.parametrize("query", [lambda t: diff_queries.full_outer_counts(diff.with_period_index(t)), diff.pair_totals, flows.flow_edges])
def test_no_key_is_shuffled_over_buckets(spark, tmp_path, query):
    full = snapshots(spark)
    name = f"bucketed_{abs(hash(str(tmp_path))) % 10**9}"
    sinks.write_bucketed(full, name, 4, str(tmp_path / "b"))
    got = query(sinks.bucketed_table(spark, name))
    want = query(full)
    assert "hashpartitioning(key" not in (p := plan_of(got)), p
    assert rows(got, *got.columns) == rows(want, *got.columns)
    spark.sql(f"DROP TABLE {name}")
