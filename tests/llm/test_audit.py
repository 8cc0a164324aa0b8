"""The filter audit against a plain run of every order."""

import itertools
import math
import random
import re

import odd

from rollbook.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, mask int"


def fails(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bad = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), copy]
    return {x for x, b in zip("ABCDE", bad, strict=True) if b}


def plain(rows, labels):
    """Runs the filters over the documents in every order."""
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    docs = []
    for i, t, lang, *_ in rows:
        copy = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, *_ in rows)
        docs.append((lang or "", fails(t or "", copy), i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, taken, found = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                taken[x] += len(gone)
                alone = sum(d[1] == {x} for d in own)
                found.append((part, "".join(order), step, len(left), len(gone), sum(x in d[1] for d in own) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)))
        out += [(*f, taken[f[1][f[2] - 1]]) for f in found]
    return sorted(out)


def audited(docs, labels):
    counted = filter_audit.masks(docs, labels, filter_audit.sample_fails, 4)
    return sorted(map(tuple, filter_audit.audit(counted, "ABCDE").collect()))


def test_neighbour_swaps_reach_every_order():
    for k in range(1, 7):
        order, seen = list("ABCDEF"[:k]), set()
        seen.add(tuple(order))
        for place in filter_audit.neighbour_swaps(k):
            order[place], order[place + 1] = order[place + 1], order[place]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(k)


def test_swaps_keep_the_counts():
    rng = random.Random(3)
    counts = {rng.randrange(32): (rng.randrange(9), rng.randrange(3), 1) for _ in range(20)}
    diagram = filter_audit.Diagram(counts, "ABCDE")
    for _ in range(200):
        diagram.swap(rng.randrange(4))
        for mask in range(32):
            node = 0
            for i, name in enumerate(diagram.order):
                node = diagram.levels[i][node][mask >> "ABCDE".index(name) & 1]
            assert diagram.sums[-1][node] == counts.get(mask, (0, 0, 0))
        assert all(len(set(level)) == len(level) for level in diagram.levels)


def test_audit_of_odd_rows(spark):
    rows = odd.rows()
    rows += [(20 + i, f"{odd.prose(100 + i, i)} {'# ' * (i % 2)}{'ABC ' * (i * 3 % 50)}", ("de", None, "")[i % 3], "s", 1) for i in range(20)]
    rows += [(60 + i, rows[-1 - i % 3][1], "fr", "s", 1) for i in range(6)]
    # labels more than once, without an id, without a value, of no document
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (61, 1, 0), (None, 1, 1), (22, None, 1), (21, 0, None), (999, 1, 1), (8, 1, 0)]
    docs = odd.frame(spark, rows, extra=True)
    assert audited(docs, spark.createDataFrame([(*x, 5) for x in labels], LABELS)) == plain(rows, labels)
    assert audited(docs, spark.createDataFrame([], LABELS)) == plain(rows, [])
    assert audited(odd.frame(spark, []), spark.createDataFrame([], LABELS)) == []


def test_many_copies(spark):
    rows = [(i, "same text", "en", "s", 9) for i in range(3000)] + [(i, f"own {i}", "en", "s", 9) for i in range(3000, 3010)]
    got = audited(odd.frame(spark, rows), spark.createDataFrame([(0, 1, 1, 0), (7, 1, 1, 0)], LABELS))
    first = [r for r in got if r[1] == "EABCD"][0]
    assert first[2:] == (1, 11, 2999, 0, 0, 1, 1, 2999 * 60)
