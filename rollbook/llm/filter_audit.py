"""What a filter takes away depending on its place among the others: an audit by decision diagrams.

Every document has a mask of the filters it fails. Spark counts the masks of each part of the
table, once for all documents, once for good and once for toxic ones; of k filters that are at
most 2^k rows a part. One diagram a part holds them: a level for each filter, a node for each
different rest of the counts, a branch for passing and one for failing, and at every node the
sum of what lies below it. Another order of the filters is the same diagram with two
neighbouring levels swapped, which touches the nodes of these two levels only; swapping
through all orders takes k! - 1 swaps. In a diagram, the path of passing all filters is the
order at work: at its i-th node, the sum on the failing branch is what step i removes, and the
sum on the passing branch what it keeps.

A copy filter fails a document whose text stands under a smaller id as well, anywhere in the
table and removed or not. Texts are compared by 128 bits of hashes; copies are counted before
they are shuffled, so a text of any number of copies is a few rows.

Cases: a null text is empty, a null part the empty string. Repeated rows of one id count each,
and none of them is a copy of the other. A row without an id is no copy and makes none. Labels
of one document are joined by `or`; a missing or null label is 0. An empty table gives no rows.
Texts of any length are read whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, content_key, text_of

COUNTS = ("n", "good", "toxic")


_NOT_CAPITAL = bytes(set(range(256)) - set(range(ord("A"), ord("Z") + 1)))
_SIGNS = re.compile(rb"[#$%&*|]")


def sample_fails(text: str) -> int:
    """Bits of four failed filters: A under 100 words, B repetitive, C shouting, D with odd signs."""
    data = text.encode("utf-8")
    words = data.split()  # bytes are split at ASCII white space only
    n, capitals = len(words), len(data.translate(None, _NOT_CAPITAL))
    return (n < 100) | (100 * len(set(words)) < 80 * n) << 1 | (100 * capitals > 10 * len(text)) << 2 | bool(_SIGNS.search(data)) << 3


def masks(docs: DataFrame, labels: DataFrame, fails: Callable[[str], int], copy_bit: int | None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail.

    `fails` gives the bits of the filters that a text fails, `copy_bit` the place of the bit
    for copies, if they are a filter.
    """
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    source = docs.select(F.col(id_col).cast("long").alias("id"), part, *content_key(text_of(text_col)), text_of(text_col).alias("text"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            mask = pa.array([fails(x.as_py()) for x in batch.column("text")], pa.int32())
            return pa.RecordBatch.from_arrays([*batch.columns[:4], mask], ["id", "part", "k1", "k2", "mask"])

        return each

    rows = arrow_rows(source, make, "id long, part string, k1 long, k2 long, mask int")
    rows = rows.groupBy("id", "part", "mask", "k1", "k2").agg(F.count("*").alias("n"))
    marked = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = marked.where("l_id is not null").select("l_id", F.lit(False).alias("l_none"), "good", "toxic")
    # rows without an id have no label; their key is spread, so they do not meet in one task
    spread = rows.select("*", F.coalesce("id", "k1").alias("at"), F.col("id").isNull().alias("none"))
    joined = spread.join(marked, (F.col("at") == F.col("l_id")) & (F.col("none") == F.col("l_none")), "left")
    own = joined.select("id", "part", "mask", "k1", "k2", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    if copy_bit is not None:
        own = _with_copies(own, 1 << copy_bit)
    return own.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def _with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """Adds `bit` to the masks of copies. Of each text only the row of least id lacks it, so the
    rows of a text are counted by (part, mask, labels), each with its least id and the rows that have it."""
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    alike = rows.groupBy("k1", "k2", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without"), first.alias("first"))
    least = alike.groupBy("k1", "k2").agg(F.min("first.id").alias("least"))
    both = alike.join(least, ["k1", "k2"])
    originals = F.col("without") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    kinds = F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - originals).alias("n")))
    return both.select("part", "good", "toxic", F.explode(kinds).alias("x")).select("part", "good", "toxic", "x.*").where("n > 0")


class Diagram:
    """A decision diagram with one level for each filter, in an order that can be changed.

    Level i is a list of (pass, fail), places in level i + 1; the last level holds counts.
    `sums` has what lies below every node. Nodes of a level differ from each other.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], names: str):
        self.order = list(names)
        k, zero = len(names), (0,) * len(next(iter(counts.values()), COUNTS))
        values = [counts.get(m, zero) for m in range(1 << k)]
        self.levels: list[list[tuple[int, int]]] = [[] for _ in range(k)]
        self.sums: list[list[tuple[int, ...]]] = [[] for _ in range(k + 1)]
        ends: dict[tuple[int, ...], int] = {}
        at = [ends.setdefault(v, len(ends)) for v in values]
        self.sums[k] = list(ends)
        # the last filter is the highest bit: fold the halves from there up
        for level in reversed(range(k)):
            seen: dict[tuple[int, int], int] = {}
            half = len(at) // 2
            at = self._fold(at, seen, half)
            self._set(level, seen)

    @staticmethod
    def _fold(at: list[int], seen: dict[tuple[int, int], int], half: int) -> list[int]:
        return [seen.setdefault((at[i], at[i + half]), len(seen)) for i in range(half)]

    def _set(self, level: int, seen: dict[tuple[int, int], int]) -> None:
        self.levels[level] = list(seen)
        below = self.sums[level + 1]
        self.sums[level] = [tuple(a + b for a, b in zip(below[p], below[f], strict=True)) for p, f in seen]

    def swap(self, i: int) -> None:
        """Exchanges the filters of levels i and i + 1; all other levels stay as they are."""
        upper, lower, seen = self.levels[i], self.levels[i + 1], {}

        def node(a: int, b: int) -> int:
            return seen.setdefault((a, b), len(seen))

        self.levels[i] = [(node(lower[p][0], lower[f][0]), node(lower[p][1], lower[f][1])) for p, f in upper]
        self._set(i + 1, seen)
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
        """(filter, counts kept, counts removed, those removed that pass all later filters) along the path of passing all."""
        out, node = [], 0
        for i, name in enumerate(self.order):
            kept, removed = self.levels[i][node]
            alone = removed
            for level in self.levels[i + 1 :]:
                alone = level[alone][0]
            out.append((name, self.sums[i + 1][kept], self.sums[i + 1][removed], self.sums[-1][alone][0]))
            node = kept
        return out


def neighbour_swaps(k: int):
    """Places of the neighbours to exchange, one after the other, to run through all k! orders."""
    if k < 2:
        return
    inner, down = neighbour_swaps(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        place = next(inner, None)
        if place is None:
            return
        # the largest element now stands in front of the others or behind them
        yield place + 1 if down else place
        down = not down


def audit_part(counts: dict[int, tuple[int, ...]], names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders."""
    diagram, found = Diagram(counts, names), []
    fails, alone, shapley = {}, {}, dict.fromkeys(names, 0)
    swaps = neighbour_swaps(len(names))
    while True:
        for step, (name, kept, removed, only) in enumerate(diagram.steps(), 1):
            found.append(("".join(diagram.order), step, name, kept[0], removed))
            shapley[name] += removed[0]
            if step == 1:  # nothing was removed before, so all that fail are here
                fails[name], alone[name] = removed[0], only
        place = next(swaps, None)
        if place is None:
            break
        diagram.swap(place)
    return [(order, step, kept, gone[0], fails[x] - gone[0], alone[x], gone[1], gone[2], shapley[x]) for order, step, x, kept, gone in found]


def audit(counted: DataFrame, names: str) -> DataFrame:
    """The audit of the rows of `masks`: one row per part, order of the filters and step."""
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    # bounded: a part has at most one row for each mask
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("masks"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for part, found in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                counts = {x["mask"]: tuple(x[c] for c in COUNTS) for x in found}
                out += [(part, *row) for row in audit_part(counts, names)]
            values = list(zip(*out, strict=True))
            types = (pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(columns))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["part", "filter_order", "step", *columns])

        return each

    return arrow_rows(parts, make, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))
