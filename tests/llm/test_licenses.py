"""Licence notices found from seeds against a search at every place."""

import random
import re

import odd
import regex

from rollbook.llm import license_scan

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    own = words(text)
    phrases = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
    return sorted((i, label) for label, p in phrases for i in range(len(own)) if own[i : i + len(p.split())] == p.split())


def everywhere(text):
    """(label, first word) of all matches of all notices, by the regex library on the whole text."""
    joined, out = " " + " ".join(words(text)) + " ", set()
    for label, phrase in (*license_scan.BASE, *license_scan.NOTICES):
        errors = min(4, len(phrase) // 10)
        exact = {w.lower() for w in phrase.split() if w.isupper() or w.isdigit()}
        for m in regex.finditer(f"(?e)(?<= )(?:{phrase.lower()}){{e<={errors}}}(?= )", joined):
            if exact <= set(m[0].split()):
                out.add((label, joined[: m.start()].count(" ") - 1))
    return out


def edited(rng, phrase, times):
    for _ in range(times):
        i, kind = rng.randrange(len(phrase)), rng.randrange(3)
        phrase = phrase[:i] + ("" if kind == 0 else rng.choice("abe é 2")) + phrase[i + (kind != 2) :]
    return phrase


def test_seeds_lose_nothing():
    rng, scanner = random.Random(4), license_scan.Scanner()
    phrases = [n.text for n in scanner.notices]
    several = 0
    for _ in range(600):
        parts = [
            rng.choice(["alpha", "Beta the", "version", "under the", "license", "é漢字", "[x]", "by cc", "public"])
            if rng.random() < 0.5
            else edited(rng, rng.choice(phrases), rng.choice([0, 0, 1, 2, 3, 5]))
            for _ in range(rng.randint(1, 6))
        ]
        text = rng.choice([" ", "  ", "-", ", "]).join(parts)
        text = text.title() if rng.random() < 0.3 else text
        n, spans, score = scanner.scan(text)
        assert n == len(words(text))
        assert sorted((x[3], x[0]) for x in spans if x[5]) == base(text)
        assert {(x[0], x[3]) for x in spans} == everywhere(text) | {(label, i) for i, label in base(text)}
        for label, start, end, word, edits, is_base in spans:
            assert words(text[start:end]) == words(text)[word : word + len(words(text[start:end]))]
            assert edits == 0 or not is_base
        assert (score == 1.0) if base(text) else 0 <= score <= 1
        several += len(spans)
    assert several > 300


def test_names_and_versions_are_exact():
    def labels(text):
        return {x[0] for x in license_scan.Scanner().scan(text)[1]}

    assert labels("released undr the MIT licence today") == {"mit"}
    assert labels("released under the MPL license today") == set()
    assert labels("Apache License, Version 1") == set() and labels("Apache Licence, Version 2.0") == {"apache-2"}
    assert labels("GNU General Public License, version 3") == {"gpl-3"}
    assert labels("cc by nd") == {"cc-by-nd"} and labels("cc by mc") == set()


def test_odd_rows(spark):
    rows = odd.rows() + [
        (30, "Under the MIT License under the mit license, CC-BY-NC; Apache License (Version 2) " * 2, "en", "s", 1),
        (31, "under the MIT licens " * 2000, "en", "s", 1),
        (32, "x" * 300_000 + " under the mit license " + "y" * 300_000, "en", "s", 1),
        (33, "under\nthe\tmit\x0blicense\x00cc by nc", "en", "s", 1),
    ]
    got = license_scan.digests(license_scan.scan(odd.frame(spark, rows, extra=True))).collect()
    want = []
    for i, t, *_ in rows:
        own = base(t)
        found = everywhere(t) | {(label, k) for k, label in own} if len(t or "") < 50_000 else {(label, k) for k, label in own}
        places = [k for k, _ in own]
        joined = [",".join(sorted({x for x in side})) for side in ((label for _, label in own), (label for label, _ in found))]
        want.append((i, len(words(t)), len(own), min(places, default=None), max(places, default=None), *joined))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert {r.doc_id: r.score for r in got}[31] == 1 - 1 / 21
    assert license_scan.digests(license_scan.scan(odd.frame(spark, []))).count() == 0
