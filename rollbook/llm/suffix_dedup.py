"""Suffix-array dedup of repeated substrings, blockwise over a cover sample.

A byte goes if a string of 200 bytes over it starts anywhere else, in the same document or
another one. Sorting all suffixes at once would need the whole corpus in one order. Instead:

* Cover sample. In each window of 200 bytes the 32-gram of least hash is a sample position.
  It depends on nothing but the window, so two equal windows have a sample position at the
  same distance from their starts, which is the property of a difference cover, with one
  position in about 85. (A cover by residues would hold for unequal windows as well, but
  needs seven times as many positions.)
* Buckets. The suffixes at sample positions fall into buckets by their first 32 bytes. A
  window can only be repeated if its bucket has two members, so all others are left out by
  counting hashes. The windows of a remaining bucket are sent to it, as the bytes around its
  sample position.
* Blockwise sort. A task sorts one block of buckets at a time: the sample suffixes once,
  which gives their ranks and common prefixes, and the bytes before them once, reversed. The
  window that starts x bytes before its sample position is then placed by its first x bytes,
  and the long tie behind them is resolved by the rank of the sample position. Equal windows
  stand together; memory is that of one block.
* A bucket of more than `HOT` texts (a passage in very many texts) is not sorted in one task:
  its windows are grouped by 128 bits of their bytes instead, with partial counts before the
  shuffle.

A text that occurs several times is repeated as a whole and goes without any sorting; the
rest of the work is done once for it.

Cases: a null text is an empty one. Texts under 200 bytes stay whole unless `size` is less.
Runs of one byte or of a short period have one row per distinct surrounding. Repeated rows
count as copies. Texts of any length are read whole. Empty tables give empty results. Only
the id and the text column are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, content_key, importable, text_of, written

#: Bytes of a repeated string, and of the gram that names a bucket.
SIZE, GRAM = 200, 32
#: Texts with members in a bucket beyond which its windows are counted by hash, and members
#: sorted at once. A text has one row for equal surroundings, so the texts are what counts.
HOT, BLOCK = 16_384, 8_192
#: Window starts of a text that are sampled at once.
PIECE = 1 << 22

_U64 = np.uint64


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    h = (data.astype(np.uint64) + _U64(1)) * _U64(0x9E3779B97F4A7C15)
    n, done = 1, None
    rest, at = gram, 0
    # grams of any length from those of powers of two
    while True:
        if rest & 1:
            part = h[at:]
            if done is None:
                done = part
            else:
                m = min(len(done), len(part))
                done = done[:m] * _U64(pow(0x100000001B3, n, 2**64)) + part[:m]
            at += n
        rest >>= 1
        if not rest:
            break
        h = h[:-n] * _U64(pow(0x100000001B3, n, 2**64)) + h[n:] if len(h) > n else h[:0]
        n *= 2
    done = done[: max(len(data) - gram + 1, 0)]
    done = (done ^ (done >> _U64(31))) * _U64(0xFF51AFD7ED558CCD)
    return done ^ (done >> _U64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    rest = width - n
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def samples(data: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(bucket, position, first, last): the sample positions and the window starts each serves."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for at in range(0, len(data) - size + 1, PIECE):
        part = data[at : at + PIECE + size - 1]
        hashes = _gram_hashes(part, gram)
        places = _U64((1 << 23) - 1)
        packed = _least((hashes & ~places) | np.arange(len(hashes), dtype=np.uint64), size - gram + 1)
        place = (packed & places).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        for x, values in zip(out, (hashes[place[first]], place[first] + at, first + at, last + at), strict=True):
            x.append(values)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, the key of the text and its bytes.

    The id has a name of its own: an alias that only repeats a name is taken out of some copies of
    this plan and not of others, and the texts would be dealt once for each kind.
    """
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("own_id"), *content_key(text), F.encode(text, "UTF-8").alias("data"))


def buckets_of(keyed: DataFrame, size: int, gram: int) -> DataFrame:
    """(h, k1, k2, own_id, n): the buckets a text has members in, and how many."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, counts, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for n, data in enumerate(batch.column("data")):
                found, count = np.unique(samples(np.frombuffer(data.as_buffer(), np.uint8), size, gram)[0], return_counts=True)
                hashes.append(found.astype(np.uint64).view(np.int64))
                counts.append(count)
                rows.append(np.full(len(found), n))
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            columns = [pa.array(np.concatenate(hashes)), *(batch.column(c).take(take) for c in ("k1", "k2", "own_id")), pa.array(np.concatenate(counts))]
            return pa.RecordBatch.from_arrays(columns, ["h", "k1", "k2", "own_id", "n"])

        return each

    long_ = keyed.where(F.length("data") >= size).select("own_id", "k1", "k2", "data")
    return arrow_rows(long_, make, "h long, k1 long, k2 long, own_id long, n long")


def _contexts(size: int, gram: int):
    """One row for each distinct surrounding of a sample position in a text, with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for n in range(batch.num_rows):
                if batch.column("own_id")[n].as_py() != batch.column("chosen")[n].as_py():
                    continue
                key = batch.column("k1")[n].as_py(), batch.column("k2")[n].as_py()
                data = batch.column("data")[n].as_py()
                wanted = np.array(batch.column("hs")[n].as_py(), np.int64).view(np.uint64)
                bucket, place, first, last = samples(np.frombuffer(data, np.uint8), size, gram)
                found: dict[tuple, list[int]] = {}
                for j in np.flatnonzero(np.isin(bucket, wanted)).tolist():
                    a, b = int(first[j]), int(last[j])
                    found.setdefault((int(bucket[j]), int(place[j]) - a, data[a : b + size]), []).append(a)
                for (h, before, context), starts in found.items():
                    rows.append((h - 2**64 if h >= 2**63 else h, *key, before, context, starts))
                    held += len(context) + 8 * len(starts)
                if held > 1 << 23:
                    yield _context_batch(rows)
                    rows, held = [], 0
            if rows:
                yield _context_batch(rows)

    return run


_CONTEXT = pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("before", pa.int64()), ("context", pa.binary()), ("starts", pa.list_(pa.int64()))])
_CONTEXT_DDL = "h long, k1 long, k2 long, before long, context binary, starts array<long>"


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CONTEXT, strict=True)], schema=_CONTEXT)


def _common(matrix: np.ndarray, order: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in the order; -1 where a bucket begins."""
    ordered = matrix[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    common[bucket[order][1:] != bucket[order][:-1]] = -1
    return np.concatenate([[-1], common])


def _order(matrix: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Rows by bucket, then bytes."""
    wide = np.zeros((len(matrix), -(-matrix.shape[1] // 8) * 8), np.uint8)
    wide[:, : matrix.shape[1]] = matrix
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort((*words.T[::-1], bucket))


def repeated(bucket: np.ndarray, before: np.ndarray, contexts: list[bytes], counts: np.ndarray, size: int, gram: int) -> np.ndarray:
    """For each context and window start in it: does the window occur twice in its bucket?

    `before` has the bytes before the sample position, `counts` how often a context stands.
    """
    n, most = len(contexts), size - gram + 1
    length = np.array([len(c) for c in contexts])
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(length) - length
    at = begin + before

    def gather(index: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, flat[np.where(there, index, 0)], 0).astype(np.uint8)

    step = np.arange(size)
    suffix = gather(at[:, None] + step, step < (length - before)[:, None])
    step = np.arange(most - 1)
    prefix = gather(at[:, None] - 1 - step, step < before[:, None])
    by_suffix, by_prefix = _order(suffix, bucket), _order(prefix, bucket)
    common_suffix, common_prefix = _common(suffix, by_suffix, bucket), _common(prefix, by_prefix, bucket)
    out = np.zeros((n, most), bool)
    rank, place = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(int(before.max()) + 1):
        # the window that starts x bytes before the sample position
        own = np.flatnonzero((x <= before) & (x >= before - (length - size)))
        if len(own) < 2 and (not len(own) or counts[own[0]] < 2):
            if not len(own):
                continue
        rank[by_suffix] = np.cumsum(common_suffix < size - x)
        place[by_prefix] = np.cumsum(common_prefix < x)
        _, which, times = np.unique(place[own] * (n + 1) + rank[own], return_inverse=True, return_counts=True)
        total = np.bincount(which, weights=counts[own])
        out[own, before[own] - x] = total[which] > 1
    return out


def _sort_blocks(size: int, gram: int):
    """Rows sorted by bucket: repeated window starts as runs (k1, k2, s, e)."""

    def block(tables: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(tables)
        bucket = rows["h"].to_numpy()
        k1, k2, before = (rows[c].to_numpy() for c in ("k1", "k2", "before"))
        contexts, starts = rows["context"].to_pylist(), rows["starts"].to_pylist()
        # rows with one id and one text have been read twice: theirs are the same
        seen: set[tuple] = set()
        keep = [i for i, key in enumerate(zip(bucket.tolist(), k1.tolist(), k2.tolist(), (s[0] for s in starts), strict=True)) if key not in seen and not seen.add(key)]
        bucket, k1, k2, before = bucket[keep], k1[keep], k2[keep], before[keep]
        contexts, starts = [contexts[i] for i in keep], [starts[i] for i in keep]
        counts = np.array([len(s) for s in starts])
        twice = np.pad(repeated(bucket, before, contexts, counts, size, gram), ((0, 0), (1, 1))).astype(np.int8)
        edges = np.diff(twice, axis=1)
        who, first = np.nonzero(edges == 1)
        last = np.nonzero(edges == -1)[1] - 1
        times = counts[who]
        offset = np.concatenate([np.array(starts[i], np.int64) for i in who.tolist()]) if len(who) else np.zeros(0, np.int64)
        who, first, last = np.repeat(who, times), np.repeat(first, times), np.repeat(last, times)
        return pa.RecordBatch.from_arrays([pa.array(k1[who]), pa.array(k2[who]), pa.array(offset + first), pa.array(offset + last)], ["k1", "k2", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = BLOCK - sum(b.num_rows for b in held)
                if batch.num_rows <= room:
                    held.append(batch)
                    break
                # close the block at a border of buckets, the last one before it is full
                h = batch.column("h").to_numpy()
                ends = np.flatnonzero(np.concatenate([[not held or held[-1].column("h")[-1].as_py() != h[0]], h[1:] != h[:-1]]))
                inside = ends[ends <= max(room, 0)]
                cut = int(inside[-1]) if len(inside) and (inside[-1] or held) else int(ends[ends > 0][0]) if (ends > 0).any() else None
                if cut is None:
                    held.append(batch)
                    break
                if cut:
                    held.append(batch.slice(0, cut))
                yield block(held)
                held, batch = [], batch.slice(cut)
        if held:
            yield block(held)

    return run


def _hot_windows(size: int, gram: int):
    """Windows of hot buckets: (w1, w2, k1, k2, p)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                for start in row["starts"]:
                    for i in range(len(row["context"]) - size + 1):
                        digest = xxhash.xxh3_128_digest(row["context"][i : i + size])
                        rows.append((int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), row["k1"], row["k2"], start + i))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["w1", "w2", "k1", "k2", "p"])

        return each

    return make


def duplicate_starts(keyed: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(k1, k2, s, e): runs of window starts whose window starts somewhere else too."""
    spark = keyed.sparkSession
    importable(spark)
    found = buckets_of(keyed, size, gram)
    several = "a1 != b1 or a2 != b2 or n > 1"
    counted = found.groupBy("h").agg(
        F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2"), F.max("n").alias("n"), F.count("*").alias("c")
    )
    shared = written(counted.where(several).select("h", (F.col("c") > hot).alias("hot")), "shared")
    # of the copies of a text one is read
    cold, heated = (F.collect_set(F.when(c, F.col("h"))) for c in (~F.col("hot"), F.col("hot")))
    member = found.select("h", "k1", "k2", "own_id").join(shared, "h")
    per_text = written(member.groupBy("k1", "k2").agg(cold.alias("cold"), heated.alias("heated"), F.min("own_id").alias("chosen")), "members")

    def contexts(buckets: str) -> DataFrame:
        # the texts are dealt as for the last join of `deduplicate`, so once for both: a
        # broadcast in one of the two would have them read and dealt again for the other
        wanted = per_text.where(F.size(buckets) > 0).select("k1", "k2", F.col(buckets).alias("hs"), "chosen")
        return keyed.join(wanted.hint("merge"), ["k1", "k2"]).select("own_id", "k1", "k2", "data", "hs", "chosen").mapInArrow(_contexts(size, gram), _CONTEXT_DDL)

    dealt = contexts("cold").repartition("h").sortWithinPartitions("h")
    runs = dealt.mapInArrow(_sort_blocks(size, gram), "k1 long, k2 long, s long, e long")
    if not shared.where("hot").isEmpty():
        windows = arrow_rows(contexts("heated"), _hot_windows(size, gram), "w1 long, w2 long, k1 long, k2 long, p long")
        twice = windows.groupBy("w1", "w2").agg(
            F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2"), F.min("p").alias("p0"), F.max("p").alias("p1")
        )
        single = windows.join(twice.where("a1 != b1 or a2 != b2 or p0 != p1").select("w1", "w2"), ["w1", "w2"])
        runs = runs.union(single.select("k1", "k2", F.col("p"), F.col("p")))
    whole = keyed.select("k1", "k2", F.length("data").cast("long").alias("n")).groupBy("k1", "k2", "n").agg(F.count("*").alias("c"))
    whole = whole.where((F.col("c") > 1) & (F.col("n") >= size)).select("k1", "k2", F.lit(0).cast("long"), F.col("n") - size)
    return runs.union(whole)


def removed_runs(starts: np.ndarray, size: int = SIZE) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) covered by the windows of runs (s, e) of starts."""
    out: list[list[int]] = []
    for s, e in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + size)
        else:
            out.append([s, e + size])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes' removed runs."""
    keyed = _keyed(docs, id_col, text_col)
    starts = duplicate_starts(keyed, size, gram, hot)
    per_text = starts.groupBy("k1", "k2").agg(F.collect_set(F.struct("s", "e")).alias("runs"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for data, runs in zip(batch.column("data").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                gone = removed_runs([(r["s"], r["e"]) for r in runs or ()], size)
                kept = hashlib.sha256()
                at = 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                row = len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [x for run in gone for x in run]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())
            out = [batch.column("own_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

        return each

    joined = keyed.join(per_text.hint("merge"), ["k1", "k2"], "left").select("own_id", "data", "runs")
    return arrow_rows(joined, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")
