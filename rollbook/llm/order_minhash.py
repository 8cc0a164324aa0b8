"""Document fingerprints by Order MinHash.

The k-mers of a text (runs of six code points; a shorter text is one) are numbered by their
occurrence, so a repeated k-mer counts as often as it stands there. Each of 32 coordinates
orders them by a permutation of its own, takes the two least, puts these back into the
order of the text, and hashes the pair. Two texts agree on a coordinate about as often as
their k-mers agree both in number and in order, which follows their edit distance rather
than the overlap of their sets.

`fingerprints_with_next` also needs the following document in descending id. Ids are dealt
to blocks of neighbouring ranges, a few for each shuffle partition; the first row of the
next block is sent along to each block, and a block is read as a sorted stream that holds
two documents at a time. Texts are shuffled once and nothing but block borders is collected.

Cases: a null text is an empty one. An empty text has an all-zero fingerprint, equal only
to itself. Rows without an id come last. Rows with one id follow each other by text. A
single document is followed by itself. Texts of any length are read whole, in pieces of
fixed memory per coordinate. An empty table gives an empty result. Only the id and the text
column are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import importable, text_of

K, COORDINATES = 6, 32
#: k-mers permuted at once for all coordinates.
PIECE = 1024
BLOCKS_PER_PARTITION = 4

_U32, _U64 = np.uint32, np.uint64
_PLACE = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(K)], np.uint64)
_TIMES = np.array([pow(0x2C9277B5, 2 * i + 1, 2**32) for i in range(COORDINATES)], np.uint32)[:, None]
_PLUS = (np.arange(COORDINATES, dtype=np.uint32) * _U32(0x9E3779B1))[:, None]

#: Room for one piece; a fresh array of this size for each step would cost more than the step.
_A, _B = np.empty((2, COORDINATES, PIECE), np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def kmers(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    k = min(K, len(points))
    n = len(points) - k + 1 if k else 0
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += (points[i : i + n] + _U64(1)) * _PLACE[i]
    return _mix(total)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How often the same k-mer stands before each place."""
    n = len(hashes)
    bits = _U64(max(n - 1, 1).bit_length())
    low = (_U64(1) << bits) - _U64(1)
    ordered = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
    group = ordered >> bits
    index = np.arange(n)
    starts = np.where(np.concatenate([[True], group[1:] != group[:-1]]), index, 0)
    out = np.empty(n, np.uint64)
    out[(ordered & low).astype(np.int64)] = index - np.maximum.accumulate(starts)
    return out


def fingerprint(text: str) -> np.ndarray:
    """The 32 coordinates."""
    hashes = kmers(text)
    n = len(hashes)
    if not n:
        return np.zeros(COORDINATES, np.uint32)
    numbered = _mix(hashes + (occurrences(hashes) + _U64(1)) * _PLACE[1])
    numbered = (numbered ^ (numbered >> _U64(32))).astype(np.uint32)
    rows = np.arange(COORDINATES)
    values, places = [], []
    for at in range(0, n, PIECE):
        piece = numbered[None, at : at + PIECE]
        permuted, shifted = _A[:, : piece.shape[1]], _B[:, : piece.shape[1]]
        np.multiply(piece, _TIMES, out=permuted)
        permuted += _PLUS
        permuted ^= np.right_shift(permuted, 15, out=shifted)
        permuted *= _U32(0x85EBCA6B)
        permuted ^= np.right_shift(permuted, 13, out=shifted)
        for _ in range(min(2, permuted.shape[1])):
            least = permuted.argmin(axis=1)
            values.append(permuted[rows, least].astype(np.uint64))
            places.append(least + at)
            permuted[rows, least] = 0xFFFFFFFF
    best = np.argsort(np.array(values), axis=0, kind="stable")[:2]
    chosen = np.sort(np.take_along_axis(np.array(places), best, axis=0), axis=0)
    pair = hashes[chosen]
    joined = _mix(pair[0] * _PLACE[2] + _mix(pair[-1]) * _PLACE[3])
    return (joined >> _U64(32)).astype(np.uint32) | _U32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third replaced by the beginning of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_FIELDS = (
    ("doc_id", "long", pa.int64()), ("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()),
    ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64()),
)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, then order; the rows that only follow come last in their block."""
    waiting = None  # block, id, text, fingerprint of the row whose follower has not come yet
    for batch in batches:
        rows = []
        for n in range(batch.num_rows):
            block, only_follows, doc_id, text = (batch.column(c)[n].as_py() for c in ("block", "only_follows", "doc_id", "text"))
            same = waiting is not None and waiting[0] == block
            if only_follows and not same:
                continue
            own = fingerprint(text)
            if same:
                _, old_id, old, old_print = waiting
                changed = edited(old, text)
                changed_print = fingerprint(changed)
                sha = hashlib.sha256(changed.encode("utf-8")).hexdigest()
                rows.append((old_id, len(old), sha, old_print.tobytes().hex(), changed_print.tobytes().hex(), likeness(old_print, changed_print), likeness(old_print, own)))
            waiting = None if only_follows else (block, doc_id, text, own)
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, _, kind) in zip(columns, _FIELDS, strict=True)], [f[0] for f in _FIELDS])


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness, with that to the next document."""
    spark = docs.sparkSession
    importable(spark)
    id_ = F.col(id_col).cast("long")
    ids = docs.select(F.coalesce(id_, F.lit(-(2**63))).alias("place"))
    blocks = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = np.unique(np.array(ids.approxQuantile("place", [i / blocks for i in range(1, blocks)], 0.25 / blocks), np.float64))

    @F.pandas_udf("int")
    def block_of(place: pd.Series) -> pd.Series:
        return pd.Series(len(borders) - np.searchsorted(borders, place.to_numpy().astype(np.float64), "left")).astype("int32")

    # one row per block: who comes first there, and which block that row follows
    heads = [(r["block"], r["head"]) for r in ids.select("place", block_of("place").alias("block")).groupBy("block").agg(F.max("place").alias("head")).orderBy("block").collect()]
    ahead = spark.createDataFrame([(heads[n - 1][0], head) for n, (_, head) in enumerate(heads)], "block int, place long")
    rows = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(2**63))).alias("place"), text_of(text_col).alias("text"))
    own = rows.select(block_of("place").alias("block"), F.lit(False).alias("only_follows"), "doc_id", "place", "text")
    follow = rows.join(F.broadcast(ahead), "place").select("block", F.lit(True), "doc_id", "place", "text")
    dealt = own.union(follow).repartition("block").sortWithinPartitions("block", "only_follows", F.col("place").desc(), "text")
    schema = ", ".join(f"{name} {kind}" for name, kind, _ in _FIELDS)
    return dealt.select("block", "only_follows", "doc_id", "text").mapInArrow(_stream, schema)
