"""Alerts on watched keys from a stream of observations.

An observation says in which state a key was seen at a time. It is joined with the last
snapshot (a static table), which says who holds the key and in which state it was known. The
state of a key is what it was last known to be, and what was seen but may still be preceded by
late observations: those wait until the watermark has passed them and are then taken in the
order of their time. Spark hands over group by group, which costs some milliseconds each; so
keys are dealt by hash to groups of keys whose states lie in one row and are brought up to date
together. An alert is a change against the state before. So the alerts do not depend
on how the stream is cut into batches, as long as nothing is later than the watermark allows.
Observations at or after the last watermark stay in the state for the next run.

The second output counts observations in tumbling windows, with built-in aggregation state.

Cases: rows without key or time, and keys that are not in the snapshot, are left out. A null
state is an unknown one and tells nothing. Observations of one time go by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an observation may be.
DELAY = "10 minutes"
#: Groups that the keys are dealt to: more make each smaller, and cost time for each. A checkpoint
#: is bound to the number it was begun with.
GROUPS = 4096
_ALERT = "key long, owner string, us long, from_status int, to_status int"
#: The keys of a group, and what waits: the place of its key among them, time, number and status.
_STATE = "key array<long>, owner array<string>, known array<int>, place array<int>, us array<long>, number array<long>, status array<int>"


def observation_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Rows of the files below path, in the order in which the files came."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def watched(observed: DataFrame, snapshot: DataFrame, delay: str = DELAY) -> DataFrame:
    """Observations (key, at, number, status) of keys of the snapshot (key, owner, status), with
    the owner and the state known there. `at` carries the watermark."""
    known = snapshot.select("key", "owner", F.col("status").cast("int").alias("known"))
    usable = observed.where("key is not null and at is not null and status is not null")
    return usable.withWatermark("at", delay).join(known, "key")


def _changes(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    mark = state.getCurrentWatermarkMs()
    key, owner, known, *waiting = state.get if state.exists else [[]] * 7
    places = {pair: i for i, pair in enumerate(zip(key, owner, strict=True))}
    known, place, us, number, status = (list(x) for x in (known, *waiting))
    for batch in batches:
        pairs = list(zip(batch["key"].tolist(), batch["owner"].tolist(), strict=True))
        for pair, first in zip(pairs, batch["known"].tolist(), strict=True):
            if pair not in places:
                places[pair] = len(places)
                known.append(int(first))
        place += [places[pair] for pair in pairs]
        for column, name in ((us, "us"), (number, "number"), (status, "status")):
            column += batch[name].tolist()

    place, us, number, status, known = (np.array(x, "int64") for x in (place, us, number, status, known))
    order = np.lexsort((status, number, us, place))
    is_due = us[order] // 1000 < mark
    due, rest = order[is_due], order[~is_due]
    of, to = place[due], status[due]
    first = np.append(True, of[1:] != of[:-1])[: len(of)]
    last = np.append(of[1:] != of[:-1], True)[: len(of)]
    before = np.where(first, known[of], np.roll(to, 1))
    known[of[last]] = to[last]

    key, owner = ([pair[i] for pair in places] for i in (0, 1))
    state.update((key, owner, known.tolist(), *[x[rest].tolist() for x in (place, us, number, status)]))
    if len(rest):
        state.setTimeoutTimestamp(max(int(us[rest].min()) // 1000, mark))
    changed = np.flatnonzero(to != before)
    if len(changed):
        at = of[changed].tolist()
        found = {"key": [key[i] for i in at], "owner": [owner[i] for i in at], "us": us[due][changed]}
        yield pd.DataFrame(found | {"from_status": before[changed], "to_status": to[changed]})


def status_alerts(observed: DataFrame, groups: int = GROUPS) -> DataFrame:
    """key, owner, at, from_status, to_status of every change, from the rows of `watched`.

    The state of a group of keys is one row; what waits in it is bounded by the delay. Keys are
    dealt to the groups by hash, so all groups grow alike with the number of keys and rows.
    """
    told = ["key", "owner", "at", F.unix_micros("at").alias("us"), "number", F.col("status").cast("int").alias("status"), "known"]
    rows = observed.select(F.pmod(F.xxhash64("key"), F.lit(groups)).alias("dealt"), *told)
    found = rows.groupBy("dealt").applyInPandasWithState(_changes, _ALERT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("key", "owner", F.timestamp_micros("us").alias("at"), "from_status", "to_status")


def window_counts(observed: DataFrame, width: str = "1 hour") -> DataFrame:
    """window_start, owner, status, n, n_differ of every tumbling window that the watermark has closed."""
    grouped = observed.groupBy(F.window("at", width).alias("w"), "owner", "status")
    counts = grouped.agg(F.count("*").alias("n"), F.count_if(F.col("status") != F.col("known")).alias("n_differ"))
    return counts.select(F.col("w.start").alias("window_start"), "owner", "status", "n", "n_differ")


def run_once(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Takes all that is new to the checkpoint, then stops. Rows reach the table once, also when
    a run fails and is started again. Both paths lie in shared storage."""
    writer = stream.writeStream.format("parquet").option("path", target).option("compression", "zstd")
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
