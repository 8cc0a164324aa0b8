"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased, ASCII punctuation counts as space. A seed is a fixed mask over
neighbouring words: its hash covers some positions and ignores the others, so it survives a
substituted word there. Documents and benchmark items are hashed under the masks at every
position and the hashes joined; each meeting fixes a diagonal, on which the whole item is
laid over the document and compared word by word.

An item of 13 words or more has leaked where some 13 neighbouring words of it stand in the
document with at most two substituted; a shorter one of five words or more where at least
80 % of it does. The masks are lossless for that: whatever words are substituted, one
position of one mask touches none of them (a test tries all cases). Items of fewer than
five words are too common to prove a leak and never match.

The benchmark is the query set. It is dealt to blocks of a bounded number of words, and each
block is broadcast and joined inside a scan of the documents, so no text is shuffled and a
document of any length is compared whole. One block holds what usual benchmarks have.

Cases: null and empty texts have no words. Repeated rows and items match alike; of several
places of one item in one document the best is named. Empty tables give empty results.
`clean` keeps all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, plain_words, text_of

#: The word offsets each mask reads. The first serves long items, the others short ones.
LONG_MASKS = ((0, 1, 3, 6, 7),)
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
WINDOW, SPARED = 13, 2
SHORTEST = 5
#: Words of the benchmark in one broadcast block.
BLOCK_WORDS = 400_000
#: Words of the documents that are hashed at once.
CHUNK = 200_000

_U64 = np.uint64
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_BITS = 20


def _hashes(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = max(len(ids) - mask[-1], 0)
    total = np.full(n, mask[-1], np.uint64)
    for place, offset in zip(_PLACE, mask, strict=False):
        total += ids[offset : offset + n] * place
        total ^= total >> _U64(29)
        total *= _PLACE[4]
    return total ^ (total >> _U64(32))


class Index:
    """One block of the benchmark: its words numbered, and where each hash stands in it."""

    def __init__(self, items: list[tuple[int, str | None]]):
        numbers: dict[bytes, int] = {}
        self.item_ids, flat, starts = [], [], [0]
        for item_id, text in items:
            words = plain_words(text)
            if len(words) >= SHORTEST:
                flat += [numbers.setdefault(w, len(numbers) + 1) for w in words]
                starts.append(len(flat))
                self.item_ids.append(item_id)
        self.numbers = numbers
        self.flat, self.starts = np.array(flat, np.uint64), np.array(starts, np.int64)
        found: list[list[np.ndarray]] = [[], [], []]
        for item, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
            for number, mask in enumerate(LONG_MASKS if b - a >= WINDOW else SHORT_MASKS):
                hashes = _hashes(self.flat[a:b], mask)
                found[0].append(hashes ^ self._salt(mask))
                found[1].append(np.full(len(hashes), item))
                found[2].append(np.arange(len(hashes)))
        hashes, item, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order].astype(np.uint64), item[order], at[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.hashes >> _U64(64 - _BITS)] = True

    @staticmethod
    def _salt(mask: tuple[int, ...]) -> np.uint64:
        return _U64(int(_PLACE[len(mask) % 5]) * (sum(mask) + 1) % 2**64)

    def diagonals(self, ids: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int]]:
        """Distinct (document, item, place of the item's first word in it) that share a hash."""
        found = []
        for mask in LONG_MASKS + SHORT_MASKS:
            hashes = _hashes(ids, mask) ^ self._salt(mask)
            at = np.flatnonzero(self.bits[hashes >> _U64(64 - _BITS)])
            low = np.searchsorted(self.hashes, hashes[at], "left")
            count = np.searchsorted(self.hashes, hashes[at], "right") - low
            hit = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            document = np.repeat(np.searchsorted(begins, at, "right") - 1, count)
            place = np.repeat(at, count) - self.at[hit] - begins[document]
            found.append(np.stack([document, self.item[hit], place]))
        return np.unique(np.concatenate(found, axis=1), axis=1).T.tolist()

    def overlap(self, ids: np.ndarray, item: int, place: int) -> int:
        """Words that agree when the item is laid at a place of a document; 0 if that is no leak."""
        own = self.flat[self.starts[item] : self.starts[item + 1]]
        n, a, b = len(own), max(place, 0), min(place + len(own), len(ids))
        if a >= b:
            return 0
        sums = np.zeros(n + 1, np.int64)
        sums[a - place + 1 : b - place + 1] = own[a - place : b - place] == ids[a:b]
        sums = sums.cumsum()
        leaked = sums[-1] >= n - n // 5 if n < WINDOW else (sums[WINDOW:] - sums[:-WINDOW]).max() >= WINDOW - SPARED
        return int(sums[-1]) if leaked else 0

    def leaks(self, texts) -> dict[int, dict[int, tuple[int, int]]]:
        """By number of the text, then item: most words matched, and the word they start at."""
        out: dict[int, dict[int, tuple[int, int]]] = {}
        gap, get = np.zeros(WINDOW, np.uint64), self.numbers.get
        parts: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            begins = np.cumsum([0, *(len(ids) + WINDOW for _, ids in parts[:-1])])
            chunk = np.concatenate([x for _, ids in parts for x in (ids, gap)])
            for document, item, place in self.diagonals(chunk, begins):
                owner, ids = parts[document]
                matched = self.overlap(ids, item, place)
                if matched > out.get(owner, {}).get(item, (0, 0))[0]:
                    out.setdefault(owner, {})[item] = matched, place
            parts.clear()

        size = 0
        for n, text in enumerate(texts):
            ids = np.array([get(w, 0) for w in plain_words(text)], np.uint64)
            if np.count_nonzero(ids) >= SHORTEST - 1:
                parts.append((n, ids))
                size += len(ids)
            if size >= CHUNK:
                flush()
                size = 0
        if parts:
            flush()
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = BLOCK_WORDS) -> list:
    """The benchmark as broadcasts of about `words` words each."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), text_of(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    count = max(1, -(-total // (6 * words)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast([(r["item_id"], r["text"]) for r in items.where(block == n).collect()]) for n in range(count)]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, item_words, matched (words), at (word of the document) of every leak."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = None
    for block in blocks(benchmark, words=words):

        def make(block=block):
            index = Index(block.value)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                ids = batch.column("doc_id").to_pylist()
                rows = [
                    (ids[n], index.item_ids[item], int(index.starts[item + 1] - index.starts[item]), matched, at)
                    for n, items in index.leaks(x.as_py() for x in batch.column("text")).items()
                    for item, (matched, at) in items.items()
                ]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "item_words", "matched", "at"])

            return each

        found = arrow_rows(source, make, "doc_id long, item_id long, item_words long, matched long, at long")
        out = found if out is None else out.union(found)
    best = F.max(F.struct("matched", "item_words", (-F.col("at")).alias("back")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.item_words", "x.matched", (-F.col("x.back")).alias("at"))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", words: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no item of the benchmark has leaked, with all their columns."""
    place = docs.columns.index(text_col)
    for block in blocks(benchmark, words=words):

        def make(block=block):
            index = Index(block.value)

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                leaked = index.leaks(x.as_py() for x in batch.column(place))
                return batch.filter(pa.array([n not in leaked for n in range(batch.num_rows)], pa.bool_()))

            return each

        docs = arrow_rows(docs, make, docs.schema)
    return docs
