"""Token ids packed into matrices of fixed width by best-fit decreasing.

Texts become ids of a public byte-level vocabulary, each closed by an end mark. A document
longer than a row is split without loss: its full parts are rows of their own, and the rest
is packed like a short document. Within a block of a bounded number of tokens the pieces are
placed by descending length, each into the row with the least room that still takes it; a
segment tree over the capacities finds that row in logarithmic time.

A row holds its ids as 16-bit little-endian numbers, padded to the width; the cumulative
lengths of its segments; the places at which positions start from nought again; and for each
segment the document and the place in that document's ids, so any document can be put
together again. Blocks lie within the partitions of the input: nothing is shuffled, and a
lost task makes the same rows again.

Cases: a null or empty text is its end mark alone. Repeated rows are packed each by itself.
Pieces of one length are placed in the order of their rows. A text of any length and kind is
encoded whole. An empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.bpe import codec, parse_ranks, read_ranks
from rollbook.llm.common import importable, text_of

WIDTH, END = 2048, 50256
#: Tokens packed together; more waste less room at the end of a block and take more memory.
BLOCK = 1 << 21

SCHEMA = "part int, block int, row int, ids binary, used int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>"
_KINDS = pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())


class Capacities:
    """Rows by the room they have left, with a segment tree over the amounts of room."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room of `least` or more, and that room."""
        node = least + self.leaves
        if not self.count[node]:
            # climb until a right neighbour holds a row, then go down to its leftmost one
            while node & 1 or not self.count[node + 1]:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; the pieces of a row fit its width."""
    rows: list[list[int]] = []
    free = Capacities(width)
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = free.take(sizes[piece])
        if found is None:
            found = len(rows), width
            rows.append([])
        row, room = found
        rows[row].append(piece)
        if room > sizes[piece]:
            free.add(row, room - sizes[piece])
    return rows


def packed_block(ids: list[np.ndarray], docs: list, width: int, end: int) -> list[tuple]:
    """Rows (ids, used, cu_seqlens, resets, doc ids, offsets) of the documents of a block."""
    pieces = [(n, at, x[at : at + width]) for n, x in enumerate(ids) for at in range(0, len(x), width)]
    out = []
    for row in best_fit([len(p[2]) for p in pieces], width):
        line = np.full(width, end, "<u2")
        lengths = [len(pieces[i][2]) for i in row]
        cumulated = [0, *np.cumsum(lengths).tolist()]
        line[: cumulated[-1]] = np.concatenate([pieces[i][2] for i in row])
        out.append((line.tobytes(), cumulated[-1], cumulated, cumulated[:-1], [docs[pieces[i][0]] for i in row], [pieces[i][1] for i in row]))
    return out


def _encoder(raw: bytes, pattern: str) -> Callable[[str], list[int]]:
    """Encodes with the tiktoken library. Its pattern search gives up on very long runs of one
    kind, as a million blanks; such a text is encoded by the codec of `bpe`, to the same ids."""
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        try:
            return fast(text)
        except BaseException as e:  # its panic is no Exception
            if type(e).__name__ != "PanicException":
                raise
        return codec(raw, pattern).encode(text)  # kept by the worker once built

    return encode


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end: int = END, block: int = BLOCK) -> DataFrame:
    """The rows of all packed matrices, see the columns in `SCHEMA`."""
    spark = docs.sparkSession
    importable(spark)
    raw = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(raw.value, pattern)
        context = TaskContext.get()
        part, number, held = context.partitionId() if context else 0, 0, 0
        ids: list[np.ndarray] = []
        owners: list = []

        def flush() -> pa.RecordBatch:
            rows = [(part, number, n, *row) for n, row in enumerate(packed_block(ids, owners, width, end))]
            ids.clear()
            owners.clear()
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                found = np.array([*encode(text.as_py()), end], np.uint16)
                ids.append(found)
                owners.append(doc_id.as_py())
                held += len(found)
                if held >= block:
                    yield flush()
                    number, held = number + 1, 0
        if ids:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return source.mapInArrow(run, SCHEMA)


def write(packed: DataFrame, path: str) -> None:
    """Writes the matrices, one file for each partition, rows in the order of their blocks."""
    packed.write.parquet(path)


def positions(cu_seqlens: list[int], width: int = WIDTH) -> np.ndarray:
    """Position ids of a row; padding has position nought."""
    out = np.zeros(width, np.int32)
    for a, b in zip(cu_seqlens, cu_seqlens[1:], strict=False):
        out[a:b] = np.arange(b - a)
    return out
