"""Near-duplicates by circulant MinHash, banding and exact verification.

Words are runs of anything but ASCII white space with A-Z lowered, a document's set its
distinct four-word shingles. All coordinates of a signature come from two permutations of
the 32-bit numbers: the first scatters a shingle, the second is read at that place shifted
by k, and coordinate k is the least value over the set. Bands of four coordinates give the
buckets; a pair at the threshold of 0.8 misses all 24 bands with a chance of 3e-6.

Documents with one set are one class and are never expanded into pairs. Within a bucket of
any size the links are found without emitting all pairs:

* star: every class against the least one of its bucket;
* centre: in a crowd (a bucket of more than 48 classes) that is not one component yet, the
  other components against the class with the largest part of common shingles, which is
  the original or its least edited copy;
* rest: the classes outside the main component of a bucket against the other components
  there. In a crowd only pairs whose shingles allow a link meet: shingles that stand in few
  texts of the crowds bring together those that share them, and without such a one the
  intersection is at most the lesser number of common shingles. This leaves out copies too
  far from all others, which would otherwise each meet the whole crowd.

After each step the components are computed anew, and only pairs between different ones go
on, so what is left out can not change a component. A pair is verified on full sets; before
it, pairs whose sizes rule out 0.8 go, and those with fewer than 54 of 96 equal one-byte
coordinates, which a true pair has with a chance below 1e-6.

Cases: null, empty and blank texts have no shingles, are linked with nothing and kept.
Fewer than four words are one shingle. Repeated rows share a class and each get their row.
A row without an id belongs to its component but does not name it. Empty tables give empty
results. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, content_key, importable, key_filter, text_of, with_hits, written
from rollbook.llm.components import components

WORDS, BANDS, ROWS = 4, 24, 4
COORDINATES = BANDS * ROWS
LEAST_EQUAL = 54
#: Members beyond which a bucket counts as a crowd; it has the bound on shared shingles as well.
CROWD = 48
#: Classes of crowds a rare shingle stands in at most.
FEW = 16
#: Members of a star that one task compares with the centre; a larger star is dealt to several.
STAR = 2000
MEMO = 300_000

_U32, _U64 = np.uint32, np.uint64
#: Odd multipliers of the two permutations and of the word positions.
_SIGMA = (_U32(0x7FEB352D), _U32(0x846CA68B))
_PI = (_U32(0x21F0AAAD), _U32(0xD35A2D97))
_PLACE = tuple(_U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None] * _U32(0x9E3779B1)


def _permute(x: np.ndarray, by: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A bijection of the 32-bit numbers, in place."""
    x ^= x >> _U32(16)
    x *= by[0]
    x ^= x >> _U32(15)
    x *= by[1]
    x ^= x >> _U32(16)
    return x


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(33))) * _U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U64(33))) * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


class Shingler:
    def __init__(self) -> None:
        class Memo(dict):
            def __missing__(memo, word: bytes) -> int:
                if len(memo) >= MEMO:
                    memo.clear()
                value = xxhash.xxh3_64_intdigest(word)
                if len(word) <= 64:
                    memo[word] = value
                return value

        self._memo = Memo()

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the shingles."""
        words = text.encode("utf-8").lower().split()
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self._memo.__getitem__, words), np.uint64, n)
        size = min(n, WORDS)
        total = np.full(n - size + 1, size, np.uint64)
        for i in range(size):
            total += _mix64(hashes[i : n - size + 1 + i]) * _PLACE[i]
        return np.unique(_mix64(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least values of the second permutation, read at the circularly shifted first."""
    place = _permute((shingles ^ (shingles >> _U64(32))).astype(np.uint32), _SIGMA)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), 4096):
        least = np.minimum(least, _permute(place[None, at : at + 4096] + _SHIFTS, _PI).min(axis=1))
    return least


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _sketch_batch(own: Shingler):
    band = np.arange(BANDS, dtype=np.uint64) * _PLACE[0]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        classes, counts, bands, bytes_ = [], [], [], []
        for text in batch.column("text"):
            found = own.shingles(text.as_py())
            counts.append(len(found))
            if not len(found):
                classes.append(None)
                bands.append([])
                bytes_.append([])
                continue
            coordinates = signature(found)
            wide = coordinates.astype(np.uint64).reshape(BANDS, ROWS)
            keys = _mix64(band + wide[:, 0] * _PLACE[0] + _mix64(wide[:, 1] * _PLACE[1] + _mix64(wide[:, 2] * _PLACE[2] + _mix64(wide[:, 3] * _PLACE[3]))))
            classes.append(_digest(found))
            bands.append(keys.view(np.int64))
            bytes_.append((coordinates & _U32(255)).astype(np.uint8).view(np.int64))
        lists = pa.list_(pa.int64())
        out = [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(classes, pa.binary()), pa.array(counts, pa.int64()), pa.array(bands, lists), pa.array(bytes_, lists)]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "k1", "k2", "cls", "n", "bands", "sig"])

    return each


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content key, class (of equal sets), size of the set, band keys, one-byte coordinates."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *content_key(text_of(text_col)), text_of(text_col).alias("text"))
    schema = "doc_id long, k1 long, k2 long, cls binary, n long, bands array<long>, sig array<long>"
    return arrow_rows(source, lambda: _sketch_batch(Shingler()), schema)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds `equal` (coordinates) to pairs (p, m) and leaves out those that can not be links."""
    a = classes.select(F.col("cls").alias("p"), F.col("n").alias("pn"), F.col("sig").alias("ps"))
    b = classes.select(F.col("cls").alias("m"), F.col("n").alias("mn"), F.col("sig").alias("ms"))
    rows = pairs.join(a, "p").join(b, "m").where("100 * least(pn, mn) >= 80 * greatest(pn, mn)")
    differ = None
    for i in range(COORDINATES // 8):
        # bytes that differ: fold every byte of the xor onto its lowest bit and count those
        x = F.col("ps")[i].bitwiseXOR(F.col("ms")[i])
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        differ = F.bit_count(x) if differ is None else differ + F.bit_count(x)
    return rows.select("p", "m", (F.lit(COORDINATES) - differ).alias("equal")).where(F.col("equal") >= LEAST_EQUAL)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by star, the centre first: compares each member with the centre of its star."""
    own, star, centre = Shingler(), None, None
    for batch in batches:
        p, m = [], []
        for key, salt, member, text in zip(*(batch.column(c).to_pylist() for c in ("p", "salt", "m", "text")), strict=True):
            found = own.shingles(text)
            if (key, salt) != star and member is None:
                star, centre = (key, salt), found
            elif member is not None and linked(centre, found):
                p.append(key)
                m.append(member)
        if p:
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()), pa.array(m, pa.binary())], ["u", "v"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The links (u, v) among pairs (p, m). `texts` has one text of every class."""
    sizes = pairs.groupBy("p").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    member = pairs.join(sizes, "p").select("p", F.pmod(F.xxhash64("m"), F.col("parts")).cast("int").alias("salt"), "m")
    centre = sizes.select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    rows = member.join(texts.withColumnRenamed("cls", "m"), "m").select("p", "salt", "m", "text")
    rows = rows.union(centre.join(texts.withColumnRenamed("cls", "p"), "p").select("p", "salt", F.lit(None).cast("binary"), "text"))
    dealt = rows.repartition("p", "salt").sortWithinPartitions("p", "salt", F.col("m").asc_nulls_first())
    importable(pairs.sparkSession)
    return dealt.mapInArrow(_compare, "u binary, v binary")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with root, main, total (of their bucket) of the buckets that hold more than one component."""
    labelled = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    sizes = labelled.groupBy("b", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("b").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.sum("c").alias("total"), F.count("*").alias("roots"))
    return labelled.join(main.where("roots > 1").drop("roots"), "b")


def graded_shingles(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, common, few, rare): of the shingles of a class that stand in another one of the given
    classes too, the number of those in many, that of those in few, and the list of the latter."""

    def make():
        own = Shingler()

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [own.shingles(x.as_py()).view(np.int64) for x in batch.column("text")]
            cls = batch.column("cls").take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
            return pa.RecordBatch.from_arrays([cls, pa.array(np.concatenate(sets), pa.int64())], ["cls", "h"])

        return each

    rows = arrow_rows(texts.join(classes, "cls").select("cls", "text"), make, "cls binary, h long")
    often = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rare = F.collect_list(F.when(F.col("df") <= FEW, F.col("h")))
    graded = rows.join(often, "h").groupBy("cls").agg(F.count_if(F.col("df") > FEW).alias("common"), rare.alias("rare"))
    return graded.select("cls", "common", F.size("rare").alias("few"), "rare")


def _centres(open_: DataFrame) -> DataFrame:
    """(p, m): in each crowd, the class with the largest part of common shingles against the others."""
    best = F.max(F.struct((F.col("common") / F.col("n")).alias("part"), "n", F.col("cls").alias("p"), F.col("root").alias("p_root"), (F.col("common") + F.col("few")).alias("ps")))
    centre = open_.groupBy("b").agg(best.alias("x")).select("b", "x.p", "x.p_root", "x.ps", F.col("x.n").alias("pn"))
    pairs = open_.join(centre, "b").where("root != p_root and 180 * least(ps, common + few) >= 80 * (pn + n)")
    return pairs.select("p", F.col("cls").alias("m")).distinct()


def _apart(open_: DataFrame) -> DataFrame:
    """(p, m): each class outside the main component of a bucket with the other components there."""
    p = open_.where("root != main").select("b", F.col("cls").alias("p"), F.col("root").alias("p_root"))
    m = open_.select("b", F.col("cls").alias("m"), F.col("root").alias("m_root"), (F.col("root") == F.col("main")).alias("in_main"))
    # two classes that are both apart meet twice: keep one direction
    return p.join(m, "b").where("p_root != m_root and (in_main or p < m)").select("p", "m").distinct()


def _apart_in_crowds(open_: DataFrame, graded: DataFrame) -> DataFrame:
    """The pairs of `_apart` that may link, without a look at the others.

    Two classes have at most the lesser number of common shingles of either in common, and
    the rare ones they share. Pairs that share rare ones meet on those; pairs that share
    none can only link if sizes and common shingles allow it, so they meet by size.
    """
    apart = open_.where("root != main and 180 * (common + few) >= 144 * n")
    step = 0.03
    most = F.least(1.25 * F.col("n"), 2.25 * F.col("common") - F.col("n"))
    sizes = F.sequence(F.floor(F.log(0.8 * F.col("n")) / step).cast("int"), F.floor(F.log(most) / step).cast("int"))
    p = apart.where("180 * common >= 144 * n").select("b", F.col("cls").alias("p"), F.col("root").alias("p_root"), F.col("n").alias("pn"), F.col("common").alias("pc"), F.col("bands").alias("p_bands"), F.explode(sizes).alias("size"))
    m = open_.select("b", F.col("cls").alias("m"), F.col("root").alias("m_root"), F.col("n").alias("mn"), F.col("common").alias("mc"), F.col("bands").alias("m_bands"), (F.col("root") == F.col("main")).alias("in_main"), F.floor(F.log("n") / step).cast("int").alias("size"))
    # of the buckets two classes share, the first one brings them together
    meet = "p_root != m_root and (in_main or p < m) and 180 * least(pc, mc) >= 80 * (pn + mn) and b = array_min(array_intersect(p_bands, m_bands))"
    by_size = p.join(m, ["b", "size"]).where(meet).select("p", "m")

    def rare(rows: DataFrame, side: str) -> DataFrame:
        own = rows.select("cls", "root").distinct().join(graded, "cls")
        return own.select(F.explode("rare").alias("h"), *[F.col(c).alias(f"{side}_{c}") for c in ("cls", "root", "n", "common")])

    met = rare(apart, "p").join(rare(open_, "m"), "h").where("p_root != m_root")
    met = met.groupBy("p_cls", "m_cls", "p_n", "m_n", "p_common", "m_common").agg(F.count("*").alias("t"))
    by_rare = met.where("180 * (least(p_common, m_common) + t) >= 80 * (p_n + m_n)").select(F.col("p_cls").alias("p"), F.col("m_cls").alias("m"))
    both = by_size.union(by_rare)
    return both.select(F.least("p", "m").alias("p"), F.greatest("p", "m").alias("m")).distinct()


def link_stars(docs: DataFrame, sketched: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(node, root) of every class that is linked with another one."""
    banded = sketched.where("cls is not null").select("cls", F.xxhash64("cls").alias("c"), F.explode("bands").alias("b"))
    shared = banded.groupBy("b").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("b")
    members = written(banded.join(shared, "b").select("b", "cls").distinct(), "buckets")
    classes = sketched.join(members.select("cls").distinct(), "cls").groupBy("cls").agg(F.min(F.struct("doc_id", "k1", "k2", "n", "sig", "bands")).alias("x"))
    classes = written(classes.select("cls", "x.*"), "classes")
    # one document stands for a class; further rows of it with one id would only repeat a link
    chosen = classes.select("cls", "k1", "k2", F.col("doc_id").alias("chosen"))
    # most texts are in no shared bucket: the filter keeps them out of the shuffle
    keyed = with_hits(docs.select("doc_id", *content_key(F.col("text")), "text"), "k1", key_filter(chosen, "k1"), "hit").where("hit")
    texts = keyed.join(chosen, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("chosen")))
    texts = written(texts.select("cls", "text"), "texts")

    def linked_again(pairs: DataFrame, before: DataFrame) -> DataFrame:
        known = before.select(F.col("node").alias("u"), F.col("root").alias("v"))
        return components(known.union(verified(pairs.select("p", "m"), texts)))

    centre = members.groupBy("b").agg(F.min("cls").alias("p"))
    star = members.join(centre, "b").where("cls != p").select("p", F.col("cls").alias("m")).distinct()
    tried = written(_likely(star, classes), "pairs")
    roots = components(verified(tried.select("p", "m"), texts))

    # only buckets that are not one component yet are looked at again, and each step only if there are any
    left = written(_open(members, roots).select("b", "cls", "total"), "open")
    crowd_rows = left.where(F.col("total") > crowd).select("b", "cls")
    rest = None
    if not crowd_rows.isEmpty():
        graded = graded_shingles(texts, crowd_rows.select("cls").distinct())
        graded = written(graded.join(classes.select("cls", "n", "bands"), "cls"), "graded")
        crowds = written(crowd_rows.join(graded.drop("rare"), "cls"), "crowds")
        central = written(_likely(_centres(_open(crowds, roots)), classes), "pairs")
        if not central.isEmpty():
            roots = linked_again(central, roots)
        rest = _apart_in_crowds(_open(crowds, roots), graded)
    small = left.where(F.col("total") <= crowd).select("b", "cls")
    if not small.isEmpty():
        few = _apart(_open(small, roots))
        rest = few if rest is None else few.union(rest).distinct()
    if rest is None:
        return roots
    done = tried.select("p", "m").union(tried.select(F.col("m").alias("p"), F.col("p").alias("m")))
    rest = written(_likely(rest, classes).join(done, ["p", "m"], "left_anti"), "pairs")
    return roots if rest.isEmpty() else linked_again(rest, roots)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, k1, k2 (content key), n_shingles, component_id, kept of every row."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    sketched = written(sketches(source), "sketches")
    roots = link_stars(source, sketched, crowd)
    named = sketched.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    rooted = named.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(heads, "root").select("cls", "component_id")
    rows = sketched.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "cls").join(by_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return rows.select("doc_id", "k1", "k2", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return judged(docs, id_col, text_col, crowd).select("doc_id", "n_shingles", "component_id", "kept")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group with all its columns; of equal rows one stays.

    What goes is written first. Of the texts, only those that may be among it are shuffled.
    """
    rows = judged(docs, id_col, text_col)
    rows = rows.groupBy("doc_id", "k1", "k2").agg(F.first("kept").alias("kept"), F.count("*").alias("c"))
    marked = written(rows.where("not kept or c > 1"), "gone")
    k1, k2 = content_key(text_of(text_col))
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), "__k1": k1, "__k2": k2})
    keyed = with_hits(keyed, "__k1", key_filter(marked, "k1"), "__hit")

    def same(table: DataFrame) -> F.Column:
        return keyed["__id"].eqNullSafe(table["doc_id"]) & (keyed["__k1"] == table["k1"]) & (keyed["__k2"] == table["k2"])

    hit = keyed.where("__hit")
    single = keyed.where("not __hit").union(hit.join(marked, same(marked), "left_anti"))
    several = marked.where("kept")
    if not several.isEmpty():
        single = single.union(hit.join(several, same(several), "left_semi").dropDuplicates(["__id", "__k1", "__k2"]))
    return single.drop("__id", "__k1", "__k2", "__hit")
