"""Duplicates, leaks, toxicity and fingerprints against plain versions."""

import hashlib
import random
from itertools import combinations

import numpy as np
import odd
import pytest

from rollbook.llm import decontaminate, minhash, order_minhash, suffix_dedup, toxicity


def families(seed, sizes, words=150):
    rng = random.Random(seed)
    out = []
    for f, size in enumerate(sizes):
        base = odd.prose(words, seed * 100 + f).split()
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
                own[rng.randrange(len(own))] = rng.choice(odd.WORD)
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("crowd", [2, 48])
def test_near_duplicates(spark, crowd):
    texts = families(5, [60, 12, 3, 2, 1, 1])
    docs = odd.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, crowd=crowd).collect()}
    assert [got[i].component_id for i in range(len(texts))] == odd.components(texts)
    assert all(got[i].n_shingles == len(odd.shingles(t)) and got[i].kept == (got[i].component_id == i) for i, t in enumerate(texts))


def test_stars_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STAR", 5)
    texts = families(6, [40])
    docs = odd.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert [r.component_id for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == odd.components(texts)


def test_near_duplicates_of_odd_rows(spark):
    data = odd.rows()
    got = minhash.near_duplicates(odd.frame(spark, extra=True)).collect()
    assert len(got) == len(data)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[1].kept and of[2].component_id == 1 and of[9].component_id == 1 and not of[9].kept
    assert all(of[i].kept and of[i].n_shingles == 0 for i in (3, 4, 5))
    assert [r.component_id for r in got if r.doc_id is None and r.n_shingles] == [1]
    kept = minhash.distinct_documents(odd.frame(spark, extra=True))
    assert kept.columns == odd.frame(spark, extra=True).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14]
    assert minhash.near_duplicates(odd.frame(spark, [])).count() == 0


def test_signature_is_circulant():
    own = minhash.Shingler().shingles(odd.prose(80, 4))
    place = minhash._permute((own ^ (own >> np.uint64(32))).astype(np.uint32), minhash._SIGMA)
    shift = minhash._SHIFTS[5]
    assert minhash.signature(own)[5] == minhash._permute(place + shift, minhash._PI).min()


def plain_dedup(texts, size):
    datas = [(t or "").encode() for t in texts]
    seen = {}
    for n, d in enumerate(datas):
        for i in range(len(d) - size + 1):
            seen.setdefault(d[i : i + size], []).append((n, i))
    out = []
    for n, d in enumerate(datas):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if len(seen[d[i : i + size]]) > 1:
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [0, 16_384])
@pytest.mark.parametrize("size,gram", [(40, 8), (200, 32), (33, 5)])
def test_suffix_dedup(spark, size, gram, hot):
    rng = random.Random(size)
    passage = odd.prose(60, 9)
    texts = [t for _, t, *_ in odd.rows() if t is None or len(t) < 20_000]
    texts += [odd.prose(rng.randrange(5, 80), 50 + n) + passage[rng.randrange(200) : rng.randrange(200, 500)] + chr(rng.randrange(97, 123)) * rng.randrange(90) for n in range(12)]
    texts += ["\x00" * 90 + "ab" * 60, "\x00" * 77 + "é" * 130]
    docs = odd.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)], extra=True)
    got = suffix_dedup.deduplicate(docs, size=size, gram=gram, hot=hot).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain_dedup(texts, size)


def test_suffix_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3)
    texts = [odd.prose(50, n % 4) + "!" * n for n in range(20)]
    docs = odd.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    got = suffix_dedup.deduplicate(docs).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == plain_dedup(texts, 200)
    assert suffix_dedup.deduplicate(odd.frame(spark, [])).count() == 0


def test_seeds_are_lossless():
    def hit(masks, n, bad):
        return any(not any(s + o in bad for o in m) for m in masks for s in range(n - m[-1]))

    for bad in combinations(range(decontaminate.WINDOW), decontaminate.SPARED):
        assert hit(decontaminate.LONG_MASKS, decontaminate.WINDOW, bad)
    for n in range(decontaminate.SHORTEST, decontaminate.WINDOW):
        assert all(hit(decontaminate.SHORT_MASKS, n, bad) for bad in combinations(range(n), n // 5))


def plain_leaks(text, items):
    w, out = decontaminate.plain_words(text), set()
    for item_id, item in items:
        b = decontaminate.plain_words(item)
        for at in range(-len(b), len(w)):
            same = [0 <= at + k < len(w) and w[at + k] == x for k, x in enumerate(b)]
            if len(b) >= 13 and any(sum(same[k : k + 13]) >= 11 for k in range(len(b) - 12)) or 5 <= len(b) < 13 and sum(same) >= len(b) - len(b) // 5:
                out.add(item_id)
    return out


def test_leaks(spark):
    rng = random.Random(3)
    items = [(n, odd.prose(n % 40 + 1, 300 + n)) for n in range(60)] + [(60, None), (61, "")]
    docs = []
    for n in range(120):
        words = items[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = "other"
        docs.append((1000 + n, odd.prose(rng.randrange(20), n) + " " + ", ".join(words[rng.randrange(3) :]).upper() + ". " + odd.prose(5, n), "en", "s", 1))
    docs += odd.rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t, *_ in docs if d is not None for i in plain_leaks(t, items)}
    for words in (decontaminate.BLOCK_WORDS, 100):
        got = decontaminate.find(odd.frame(spark, docs, extra=True), benchmark, words=words).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.doc_id is not None} == want
    leaked = {d for d, _ in want}
    clean = decontaminate.clean(odd.frame(spark, docs, extra=True), benchmark, words=100)
    assert clean.columns == odd.frame(spark, docs, extra=True).columns
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted(d for d, *_ in docs if d is not None and d not in leaked)
    assert decontaminate.find(odd.frame(spark, []), benchmark).count() == 0
    assert decontaminate.find(odd.frame(spark), benchmark.limit(0)).count() == 0


def test_occurrences():
    for text in ("a" * 30, "abcabcabcabcabc", odd.prose(40, 1), "é漢字🙂" * 9):
        seen, want = {}, []
        for i in range(len(text) - order_minhash.K + 1):
            k = text[i : i + order_minhash.K]
            want.append(seen.get(k, 0))
            seen[k] = want[-1] + 1
        assert order_minhash.occurrences(order_minhash.kmers(text)).tolist() == want


def test_fingerprint_follows_edits(monkeypatch):
    text = odd.prose(300, 8)
    whole = order_minhash.fingerprint(text)
    monkeypatch.setattr(order_minhash, "PIECE", 100)
    assert (order_minhash.fingerprint(text) == whole).all()
    few = order_minhash.likeness(whole, order_minhash.fingerprint(text[:500] + "x" + text[500:]))
    swapped = order_minhash.likeness(whole, order_minhash.fingerprint(text[len(text) // 2 :] + " " + text[: len(text) // 2]))
    other = order_minhash.likeness(whole, order_minhash.fingerprint(odd.prose(300, 9)))
    assert few > 0.8 and few > swapped > other
    assert order_minhash.likeness(order_minhash.fingerprint(""), order_minhash.fingerprint("a")) == 0


def test_next_documents(spark):
    data = odd.rows()
    got = order_minhash.fingerprints_with_next(odd.frame(spark, extra=True)).collect()
    ordered = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for n, (doc_id, text, *_) in enumerate(ordered):
        text, following = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        changed = order_minhash.edited(text, following)
        own, new, nxt = (order_minhash.fingerprint(x) for x in (text, changed, following))
        sha = hashlib.sha256(changed.encode()).hexdigest()
        want.append((doc_id, len(text), sha, own.tobytes().hex(), new.tobytes().hex(), order_minhash.likeness(own, new), order_minhash.likeness(own, nxt)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert order_minhash.fingerprints_with_next(odd.frame(spark, [])).count() == 0
    alone = order_minhash.fingerprints_with_next(odd.frame(spark, [(5, "abcdefghi", "en", "s", 9)])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest()


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "REAL", np.float64)
    model = toxicity.Model({b"a": 1, b"bc": 2})
    windows, labels = [[b"a", b"bc", b"xyz"], [b"bc", b"qq"]], np.array([1.0, 0.0])
    grads = {k: np.zeros_like(v) for k, v in model.weights.items()}
    model.step(windows, labels, grads)

    def loss():
        total = 0.0
        for words, label in zip(windows, labels, strict=True):
            inputs = np.concatenate([model.inputs(words), np.zeros((toxicity.WINDOW - len(words), 6 * toxicity.HIDDEN))])[None]
            p = 1 / (1 + np.exp(-model.odds(model.words.read(inputs, (np.arange(toxicity.WINDOW) < len(words))[None]))[0]))
            total -= label * np.log(p) + (1 - label) * np.log(1 - p)
        return total / 2

    for k, v in model.weights.items():
        at = {"letter": (ord("b"), 3), "word": (2, 1)}.get(k, tuple(n // 2 for n in v.shape))
        v[at] += 1e-5
        above = loss()
        v[at] -= 2e-5
        below = loss()
        v[at] += 1e-5
        assert k == "cut" or grads[k][at] == pytest.approx((above - below) / 2e-5, rel=1e-4, abs=1e-8)


def test_all_windows_are_scored():
    scorer = toxicity.Scorer(toxicity.Model({}))
    text = odd.prose(900, 2) + " " + "z" * 60
    words = toxicity.pieces(text)
    each = [scorer.windows([words[s : s + toxicity.WINDOW]])[0][0] for s in toxicity.window_starts(len(words))]
    assert scorer.scores([text])[0] == pytest.approx(max(each), abs=1e-5)


def test_long_texts_in_parts(monkeypatch):
    texts = [odd.prose(3000, 4), "", odd.prose(10, 1), odd.prose(777, 2)]
    whole = toxicity.Scorer(toxicity.Model({})).scores(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 160)
    monkeypatch.setattr(toxicity, "MEMO", 50_000)
    assert toxicity.Scorer(toxicity.Model({})).scores(texts) == pytest.approx(whole, abs=1e-5)
    assert whole[1] == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fitted(docs, labels)
    rows = toxicity.judged(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    assert right >= 0.9 and all(0 <= r.score <= 1 for r in rows)
    got = toxicity.score(odd.frame(spark, extra=True), model).collect()
    assert len(got) == len(odd.rows()) and {r.score for r in got if r.doc_id in (3, 4, 5)} == {0.0}
    kept = toxicity.accepted(odd.frame(spark, extra=True), model)
    assert kept.columns == odd.frame(spark, extra=True).columns and {3, 4, 5} <= {r.doc_id for r in kept.collect()}
    assert toxicity.score(odd.frame(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(odd.frame(spark), empty)
    assert model == b"" and {r.score for r in toxicity.score(odd.frame(spark), model).collect()} == {0.0}
