"""Streams over the events of the star schema, each run to the end of what is there."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.plans.base import CURRENT_SQL, current_keys, query, table
from rollbook.session import materialise, scratch_path
from rollbook.streaming import alerts

#: What an event tells about the state of its key.
STATES = {"view": 1, "click": 2, "error": 3, "signup": 4, "purchase": 6}


def _state() -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(STATES.items())])[F.col("event_type")]


def observations(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("number"), _state().alias("status"))


def watched_events(spark, d, snapshot: DataFrame | None = None, path: str | None = None, max_files: int = 1000) -> DataFrame:
    """The stream of events below path (the given table), each with what is known about its key."""
    held = snapshot if snapshot is not None else materialise(current_keys(spark, d).select("key", "owner", "status"), "held")
    # a pattern, because a stream takes a single file by a pattern only
    stream = alerts.observation_stream(spark, path or f"{d}/event[s].parquet", table(spark, d, "events").schema, max_files)
    return alerts.watched(observations(stream), held)


def _finished(spark, stream: DataFrame, name: str) -> DataFrame:
    target = scratch_path(spark, name)
    alerts.run_once(stream, target, scratch_path(spark, f"{name}-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


_SEEN = f"""{CURRENT_SQL},
told AS (
  SELECT event_id, user_id AS key, epoch_ms(ts) AS ms, ts,
    CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in STATES.items())} END AS status FROM events),
usable AS (SELECT *, max(ms) OVER () - 600000 AS mark FROM told WHERE key IS NOT NULL AND ts IS NOT NULL AND status IS NOT NULL),
seen AS (SELECT u.*, c.owner, c.status AS known FROM usable u JOIN cur c ON c.key = u.key)"""


@query(
    "watch_alerts",
    f"""WITH {_SEEN},
  steps AS (
    SELECT key, owner, ts, status, coalesce(lag(status) OVER (PARTITION BY key ORDER BY ts, event_id), known) AS before
    FROM seen WHERE ms < mark)
  SELECT key, owner, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(before AS BIGINT) AS from_status, CAST(status AS BIGINT) AS to_status
  FROM steps WHERE status <> before""",
)
def _(spark, d):
    return _finished(spark, alerts.status_alerts(watched_events(spark, d)), "alerts")


@query(
    "watch_windows",
    f"""WITH {_SEEN}
  SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, owner, CAST(status AS BIGINT) AS status,
    count(*) AS n, count(*) FILTER (WHERE status <> known) AS n_differ
  FROM seen WHERE epoch_ms(date_trunc('hour', ts)) + 3600000 <= mark GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return _finished(spark, alerts.window_counts(watched_events(spark, d)), "windows")
