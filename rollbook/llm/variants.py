"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A word is a vector of 32 letter counts: one place for each of a-z, six for the letters from
U+00C0 to U+00FF. Replacing a letter takes one count down and another up, adding one takes one
up. So words one edit apart have vectors at an L1 distance of two at most, and a range search
over words of one length asks for one count up and one down, over words of the next length for
one count up alone. Counts are kept as thermometer codes of four levels in two 64-bit numbers:
what two vectors, or a vector and the corner of a box, differ by is a number of set bits.
Counts above four count as four, which only makes distances smaller.

Spark deals the words to the boxes of one k-d tree per length. Its planes are fitted on at most
about SAMPLE words (chosen by hash) and only decide how even the boxes are: every word is put
into its box, and is sent to every other box that its range reaches. A box is searched by a
task which builds a tree over the box's words (8,192 as planned), lets the other words stream
by in batches, prunes its boxes, and verifies the order of the letters of what is left. A box
with more words than planned, and one that more than PROBES words are sent to, is cut into
several tasks by the hash of the words.

Of each word only the number of near words and the best one leave a task, so pairs are never
written. Chains of forms are followed by pointer doubling.

Cases: a null or empty text has no words; a null id counts as an empty string where the noise
is dealt. Repeated rows count each time. Ties of the best form go to the least word in
code-point order. Texts and words of any length are read whole. An empty table has no words.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, importable, text_of, written

#: Words of a box and of a task, words the planes are fitted on, words of a leaf of the inner tree.
BLOCK, PROBES, SAMPLE, LEAF = 8_192, 120_000, 60_000, 24
#: Pairs whose letters are compared at a time, in bytes.
CHUNK = 4_000_000

_U64 = np.uint64
_LEVELS = 4
#: Place of a letter in the vector by its code point; the letters are all below U+0100.
_PLACE = np.zeros(256, np.int64)
_PLACE[ord("a") : ord("z") + 1] = np.arange(26)
_PLACE[0xC0:0x100] = 26 + np.arange(64) % 6


def words(docs: DataFrame, least_length: int = 7, least_count: int = 2, noise: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of the runs of letters with A-Z lowered, from `least_length` letters on.

    With `noise`, runs lose a letter where the crc32 of "<id>:<run>" is a multiple of it. All
    runs of one text that look alike have one fate, so they are counted before.
    """
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)
    source = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_of(text_col).alias("text"))

    def noisy(word: str, start: int) -> str:
        h = crc32(word.encode("utf-8"), start)
        if h % noise:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: Counter[str] = Counter()
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                own = runs.findall(text.as_py().encode("utf-8").lower().decode("utf-8"))
                if noise is None:
                    found.update(own)
                    continue
                start = crc32(f"{i}:".encode())
                for word, n in Counter(own).items():
                    word = noisy(word, start)
                    if len(word) >= least_length:
                        found[word] += n
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        return each

    counted = arrow_rows(source, make, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(found: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(found).encode("latin-1"), np.uint8).reshape(len(found), -1)


def codes(matrix: np.ndarray) -> np.ndarray:
    """The letter counts of each row in thermometer code, two numbers a row."""
    rows, length = matrix.shape
    counts = np.zeros((rows, 32), np.int64)
    step = max(1, CHUNK // max(1, length))
    for at in range(0, rows, step):
        part = _PLACE[matrix[at : at + step]]
        flat = (np.arange(len(part))[:, None] * 32 + part).ravel()
        counts[at : at + step] = np.bincount(flat, minlength=len(part) * 32).reshape(-1, 32)
    return pack(counts)


def pack(counts: np.ndarray) -> np.ndarray:
    nibble = (_U64(1) << np.minimum(counts, _LEVELS).astype(_U64)) - _U64(1)
    shifts = np.arange(16, dtype=_U64) * _U64(_LEVELS)
    return np.stack([(nibble[:, :16] << shifts).sum(1, dtype=_U64), (nibble[:, 16:] << shifts).sum(1, dtype=_U64)], 1)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class Tree:
    """A k-d tree over codes. `low` and `high` are the corners of the boxes of its nodes.

    A tight tree has the corners of the points in a box; one that is not tight has those of
    its planes, so its boxes hold any point once.
    """

    def __init__(self, code: np.ndarray, leaf: float, tight: bool):
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.points: list[np.ndarray] = []
        self.leaf: dict[int, int] = {}
        whole = np.array([~_U64(0)] * 2)
        self._code, self._size, self._tight = code, leaf, tight
        self._grow(np.arange(len(code)), np.zeros(2, _U64), whole)

    def _grow(self, own: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        todo = [(own, low, high, -1, 0)]
        while todo:
            own, low, high, parent, side = todo.pop()
            code, node = self._code[own], len(self.low)
            if self._tight and len(own):
                low, high = np.bitwise_and.reduce(code), np.bitwise_or.reduce(code)
            self.low.append(low)
            self.high.append(high)
            self.children.append(None)
            if parent >= 0:
                a, b = self.children[parent]
                self.children[parent] = (node, b) if side == 0 else (a, node)
            plane = self._plane(code) if len(own) > self._size else None
            if plane is None:
                self.leaf[node] = len(self.points)
                self.points.append(own)
                continue
            half, bit = plane
            mask = np.zeros(2, _U64)
            mask[half] = bit
            up = (code[:, half] & bit) != 0
            # a set level means that the levels below it are set, a missing one that those above are not
            self.children[node] = (-1, -1)
            todo.append((own[up], low | mask | self._below(half, bit), high, node, 1))
            todo.append((own[~up], low, high & ~(mask | self._above(half, bit)), node, 0))

    @staticmethod
    def _levels_of(half: int, bit: np.uint64, above: bool) -> np.ndarray:
        place = int(bit).bit_length() - 1
        start = place - place % _LEVELS
        own = range(place + 1, start + _LEVELS) if above else range(start, place)
        mask = np.zeros(2, _U64)
        mask[half] = _U64(sum(1 << p for p in own))
        return mask

    def _below(self, half: int, bit: np.uint64) -> np.ndarray:
        return self._levels_of(half, bit, False)

    def _above(self, half: int, bit: np.uint64) -> np.ndarray:
        return self._levels_of(half, bit, True)

    @staticmethod
    def _plane(code: np.ndarray) -> tuple[int, np.uint64] | None:
        """(number, level) of the plane that cuts the points most evenly; None if all are alike."""
        best, least = None, 0
        for half in (0, 1):
            set_ = np.unpackbits(np.ascontiguousarray(code[:, half]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            lesser = np.minimum(set_, len(code) - set_)
            at = int(lesser.argmax())
            if lesser[at] > least:
                best, least = (half, _U64(1 << at)), int(lesser[at])
        return best

    def search(self, code: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of `code`) where a leaf's box has points with at most `up` more and `down` fewer letters."""
        todo = [(0, np.arange(len(code)))]
        while todo:
            node, rows = todo.pop()
            own = code[rows]
            rows = rows[(_bits(self.low[node] & ~own) <= up) & (_bits(own & ~self.high[node]) <= down)]
            if not len(rows):
                continue
            if self.children[node] is None:
                yield self.leaf[node], rows
            else:
                todo += [(child, rows) for child in self.children[node]]


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words of two matrices, row by row, are one edit apart. `b` may have one letter more."""
    length = a.shape[1]
    if b.shape[1] == length:
        return (a != b).sum(1) == 1
    front = np.cumprod(a == b[:, :length], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    back = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return front + back >= length


class Box:
    """The words of one box of one length, and the best near word of each."""

    def __init__(self, found: list[str], counts: np.ndarray):
        self.words, self.counts = np.array(found, dtype=object), counts
        self.matrix = letters(found)
        self.codes = codes(self.matrix)
        self.tree = Tree(self.codes, LEAF, tight=True)
        self.near = np.zeros(len(found), np.int64)
        self.best: dict[int, tuple[int, str]] = {}

    def meet(self, found: list[str], counts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, str]]]:
        """Number of near words and the best one (-n, word) of each given word, all of one length.

        Words of this box (`own`) meet those after them only; both sides are told.
        """
        matrix = letters(found)
        code, longer = codes(matrix), self.matrix.shape[1] - matrix.shape[1]
        near, best = np.zeros(len(found), np.int64), {}
        others = np.array(found, dtype=object)
        i, j = self._pairs(matrix, code, longer)
        keep = ~own[i] | (others[i] < self.words[j])
        i, j = i[keep], j[keep]
        near += np.bincount(i, minlength=len(found))
        self.near += np.bincount(j, minlength=len(self.words))
        _better(best, i, self.counts[j], self.words[j])
        _better(self.best, j, counts[i], others[i])
        return near, best

    def _pairs(self, matrix: np.ndarray, code: np.ndarray, longer: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        step = max(1, CHUNK // (8 * max(1, matrix.shape[1])))
        for leaf, rows in self.tree.search(code, 1, 1 - longer):
            points = self.tree.points[leaf]
            # a leaf of words with equal counts may be of any size: look at a part of the pairs at a time
            width = max(1, CHUNK // (8 * len(points)))
            for at in range(0, len(rows), width):
                part = rows[at : at + width]
                differ = _bits(code[part][:, None, :] ^ self.codes[points][None, :, :])
                x, y = np.nonzero(differ <= 2 - longer)
                x, y = part[x], points[y]
                for k in range(0, len(x), step):
                    same = one_edit(matrix[x[k : k + step]], self.matrix[y[k : k + step]])
                    left.append(x[k : k + step][same])
                    right.append(y[k : k + step][same])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(left), np.concatenate(right)


def _better(best: dict[int, tuple[int, str]], at: np.ndarray, counts: np.ndarray, found: np.ndarray) -> None:
    """Keeps for each place the word of the largest count, among equals the least one."""
    if not len(at):
        return
    order = np.lexsort((-counts, at))
    at, counts, found = at[order], counts[order], found[order]
    first = np.r_[True, at[1:] != at[:-1]]
    most = counts[first][np.cumsum(first) - 1]
    for place, n, word in zip(at[counts == most].tolist(), counts[counts == most].tolist(), found[counts == most], strict=True):
        known = best.get(place)
        if known is None or (-n, word) < known:
            best[place] = (-n, word)


_TOLD = "word string, n_near long, form string, form_n long"


def _tell(found: list[str], near: np.ndarray, best: dict[int, tuple[int, str]]) -> pa.RecordBatch:
    at = [i for i in range(len(found)) if near[i]]
    columns = [[found[i] for i in at], near[at], [best[i][1] for i in at], [-best[i][0] for i in at]]
    types = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n_near", "form", "form_n"])


def _search_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task, the words of its box first: they are held, the others stream by."""
    task, held, counts, box = None, [], [], None

    def end() -> Iterator[pa.RecordBatch]:
        if box is not None:
            yield _tell(list(box.words), box.near, box.best)

    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in ("leaf", "slice", "part", "probe", "own", "word", "n")}
        keys = zip(columns["leaf"], columns["slice"], columns["part"], columns["probe"], map(len, columns["word"]), strict=True)
        start = 0
        for (*of, probe, _), same in groupby(keys):
            stop = start + sum(1 for _ in same)
            found, n = columns["word"][start:stop], np.array(columns["n"][start:stop], np.int64)
            if of != task:
                yield from end()
                task, held, counts, box = of, [], [], None
            if not probe:
                held += found
                counts.append(n)
            elif held:
                if box is None:
                    box = Box(held, np.concatenate(counts))
                yield _tell(found, *box.meet(found, n, np.array(columns["own"][start:stop], bool)))
            start = stop
    yield from end()


def _planes(vocabulary: DataFrame, block: int) -> dict[int, tuple[int, Tree]]:
    """By length of words: number of its first box and a tree over a sample of its words.

    The driver gets one row per length and about SAMPLE words; the trees have a box for every
    `block` words.
    """
    sizes = {r["length"]: r["n"] for r in vocabulary.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    share = min(1.0, SAMPLE / max(1, sum(sizes.values())))
    large = [length for length, n in sizes.items() if n > block]
    taken = vocabulary.where(F.length("word").isin(large) & (F.pmod(F.xxhash64(F.lit("sample"), "word"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    chosen: dict[int, list[str]] = {}
    for r in taken.select("word").collect() if large else ():
        chosen.setdefault(len(r["word"]), []).append(r["word"])
    out, first = {}, 0
    for length, n in sorted(sizes.items()):
        some = sorted(chosen.get(length, ()))
        code = codes(letters(some)) if some else np.zeros((0, 2), _U64)
        out[length] = (first, Tree(code, max(LEAF, len(some) * block / n), tight=False))
        first += len(out[length][1].points)
    return out


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form, form_n of every word that has a near one: how many, the most frequent of
    them and its count. `vocabulary` has word, n; the words are distinct and all letters below U+0100."""
    planes = _planes(vocabulary, block)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = batch.column("word").to_pylist()
            if not found:
                return None
            by_length: dict[int, list[int]] = {}
            for i, word in enumerate(found):
                by_length.setdefault(len(word), []).append(i)
            rows, leaves, probes, own = [], [], [], []

            def put(where: np.ndarray, leaf: int, probe: bool, home: np.ndarray) -> None:
                rows.append(where)
                leaves.append(np.full(len(where), leaf, np.int64))
                probes.append(np.full(len(where), probe))
                own.append(home)

            for length, places in by_length.items():
                at = np.array(places)
                code = codes(letters([found[i] for i in places]))
                first, tree = planes[length]
                home = np.zeros(len(at), np.int64)
                for leaf, inside in tree.search(code, 0, 0):
                    home[inside] = first + leaf
                    put(at[inside], first + leaf, False, np.ones(len(inside), bool))
                # boxes of one length meet once: the words of the lower box go to the higher one
                for leaf, inside in tree.search(code, 1, 1):
                    inside = inside[home[inside] <= first + leaf]
                    put(at[inside], first + leaf, True, home[inside] == first + leaf)
                if length + 1 in planes:
                    first, tree = planes[length + 1]
                    for leaf, inside in tree.search(code, 1, 0):
                        put(at[inside], first + leaf, True, np.zeros(len(inside), bool))
            where = pa.array(np.concatenate(rows))
            sides = [pa.array(np.concatenate(x)) for x in (leaves, probes, own)]
            return pa.RecordBatch.from_arrays([*sides, batch.column("word").take(where), batch.column("n").take(where)], ["leaf", "probe", "own", "word", "n"])

        return each

    routed = written(arrow_rows(vocabulary.select("word", "n"), make, "leaf long, probe boolean, own boolean, word string, n long"), "routed")
    sizes = routed.groupBy("leaf").agg(F.count_if(~F.col("probe")).alias("inside"), F.count_if(F.col("probe")).alias("sent"))
    # boxes turn out about as large as planned: only far larger ones are cut
    sizes = sizes.select("leaf", F.greatest(F.ceil(F.col("inside") / (4 * block)), F.lit(1)).alias("slices"), F.greatest(F.ceil(F.col("sent") / PROBES), F.lit(1)).alias("parts"))
    cut = routed.join(sizes, "leaf")

    def dealt(by: str, salt: str) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(salt), "word"), F.col(by))

    def every(of: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))

    inside = cut.where("not probe").select("leaf", dealt("slices", "slice").alias("slice"), every("parts").alias("part"), "probe", "own", "word", "n")
    sent = cut.where("probe").select("leaf", every("slices").alias("slice"), dealt("parts", "part").alias("part"), "probe", "own", "word", "n")
    tasks = inside.union(sent).repartition("leaf", "slice", "part").sortWithinPartitions("leaf", "slice", "part", "probe", F.length("word"))
    importable(vocabulary.sparkSession)
    told = tasks.mapInArrow(_search_boxes, _TOLD)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    told = told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return told.select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the forms (word, form): where following them ends. Forms have no cycles."""
    chain = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "chain")
    while not chain.where("open").isEmpty():
        # where a root has a root of its own, take that one; each round doubles the way
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = chain.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        chain = written(step, "chain")
    return chain.select("word", "root")


def variants(vocabulary: DataFrame, factor: int = 10, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n: the form is the near word of the largest n, if that is
    at least `factor` times the word's; the root is where the forms lead."""
    vocabulary = written(vocabulary.select("word", "n"), "words")
    judged = vocabulary.join(near_words(vocabulary, block), "word", "left")
    good = F.col("form_n") >= factor * F.col("n")
    judged = written(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "near")
    ends = roots(judged.where("form is not null"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
