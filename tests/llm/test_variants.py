"""Spelling variants against a comparison of all words."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import odd
import pytest

from rollbook.llm import variants


def near(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, noise=31):
    found = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def plain(words):
    around = collections.defaultdict(list)
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            around[a].append(b)
            around[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(around[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), words.get(form[w])))
    return sorted(out, key=repr)


def vocabulary(seed, size):
    rng, words = random.Random(seed), set()
    while len(words) < size:
        words.add("".join(rng.choice(["th", "on", "re", "a", "ée", "ing", "é", "aaa", "x", "þÿ"]) for _ in range(rng.randint(3, 5))))
    for w in sorted(words)[: size // 3]:
        i = rng.randrange(len(w))
        words.add(w[:i] + rng.choice(["a", "b", "ÿ", "", "xy"]) + w[i + 1 :])
    chain = {"abcdefgh": 2, "abcdefgx": 30, "abcdefyx": 400, "abcdefyxx": 4000}
    return {w: int(2 + 3 ** rng.randint(0, 9)) for w in sorted(words)} | chain


@pytest.mark.parametrize("block", [8192, 40])
def test_same_as_all_pairs(spark, block):
    words = vocabulary(block, 500)
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = variants.variants(df, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == plain(words)
    assert any(r.root not in (r.word, r.form) for r in got)


def test_cut_boxes(spark, monkeypatch):
    """Boxes of words with equal counts can not be divided; they and what is sent to them are cut by hash."""
    words = {"".join(p): 2 + i % 50 for i, p in enumerate(itertools.permutations("abcdefg", 7)) if i % 9 == 0}
    words |= {"".join(p): 3 for i, p in enumerate(itertools.permutations("abcdefh", 7)) if i % 11 == 0}
    monkeypatch.setattr(variants, "PROBES", 100)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = variants.variants(df, block=20).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == plain(words)


def test_tree_holds_every_point_once():
    rng = np.random.default_rng(1)
    code = variants.codes(rng.choice(np.frombuffer(b"abcdeghijklmnop", np.uint8), (4000, 9)))
    for tight in (False, True):
        tree = variants.Tree(code[:2000], 50, tight)
        assert sorted(np.concatenate(tree.points)) == list(range(2000))
    tree = variants.Tree(code[:2000], 50, tight=False)
    assert sorted(np.concatenate([rows for _, rows in tree.search(code, 0, 0)])) == list(range(4000))


def test_chains_of_forms(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w9"), ("b", "c")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "a": "w11", "b": "c"}


def test_words_of_odd_rows(spark):
    rows = odd.rows() + [(40 + i, "Straßenbahn strassenbahn ÀÉîõü ÀÉÎÕÜXY Àéîõüxy " + "z" * 4000 + " " + "z" * 3999, "en", "s", 1) for i in range(40)]
    docs = odd.frame(spark, rows, extra=True)
    got = variants.words(docs, noise=31).collect()
    want = counted(rows)
    assert {r.word: r.n for r in got} == want and len(got) == len(want)
    full = variants.variants(variants.words(docs, noise=31)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, full), key=repr) == plain(want)
    assert variants.variants(variants.words(odd.frame(spark, []), noise=31)).count() == 0
