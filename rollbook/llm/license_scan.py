"""Fuzzy search for short licence notices: exact seeds, then bounded-error matching.

A text is lowered in A-Z, and its words (digits, letters a-z and all from U+0080 on) are joined
by single spaces. A notice of m letters may differ by up to m // 10 edits, four at most.
Cut into one piece more than that, at least one piece stands unchanged in any such match: an
Aho-Corasick automaton finds all pieces of all notices in one pass. Around a piece the match
can only begin and end within the allowed edits of where it would without any; these windows,
merged where they overlap, go to the regex library, which finds the leftmost match with the
allowed edits between word borders and then improves it. The words of a notice that tell licences
apart (its name and version, in capitals or digits below) must stand unchanged in the match.

Base phrases are notices too. Their places are those pieces around which the whole phrase
stands unchanged between word borders.

A span is (label, start, end, word, edits, base): code points of the given text, end exclusive;
the number of its first word, from 0; edits against the notice; whether it is an unchanged base
phrase. The score of a document is the best likeness (1 - edits / m) of its spans, 0 without any.

Cases: a null or empty text has no words and no spans. Repeated rows each get their row. Texts
of any length are read whole. Of equal spans of one label the one with fewer edits counts, among
those the base one. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import arrow_rows, text_of

#: Label and phrase of the base notices; words in capitals and numbers are exact.
BASE = (
    ("mit", "under the MIT license"),
    ("apache-2", "APACHE license version 2"),
    ("cc-by-nc", "CC BY NC"),
)
#: Further notices.
NOTICES = (
    ("agpl-3", "gnu AFFERO general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "under the BSD license"),
    ("cc-by", "creative commons ATTRIBUTION 4 0 international license"),
    ("cc-by-nc", "creative commons attribution NONCOMMERCIAL"),
    ("cc-by-nd", "CC BY ND"),
    ("cc-by-sa", "CC BY SA"),
    ("cc0", "CC0 1 0 universal"),
    ("gpl-2", "gnu GENERAL public license version 2"),
    ("gpl-3", "gnu GENERAL public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without FEE"),
    ("lgpl", "gnu LESSER general public license"),
    ("mit", "permission is hereby granted free of charge to any person OBTAINING a copy of this software"),
    ("mpl-2", "MOZILLA public license version 2"),
    ("unlicense", "this is free and UNENCUMBERED software released into the public domain"),
)

_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPANS = "array<struct<label:string,start:long,end:long,word:long,edits:int,base:boolean>>"


def lowered(text: str) -> str:
    """A-Z lowered, all else as it is."""
    return text.encode("utf-8").lower().decode("utf-8")


class Notice:
    def __init__(self, label: str, phrase: str, base: bool, errors: int | None = None):
        self.label, self.base, self.text = label, base, phrase.lower()
        self.errors = min(4, len(phrase) // 10) if errors is None else errors
        self.exact = {w.lower() for w in phrase.split() if w.isupper() or w.isdigit()}
        self.pattern = regex.compile(f"(?e)(?<= )(?:{regex.escape(self.text, literal_spaces=True)}){{e<={self.errors}}}(?= )")

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): one more than the allowed edits."""
        n, m = self.errors + 1, len(self.text)
        cuts = [m * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def matches(self, text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the fuzzy matches in text[start:stop], which has a space on each side."""
        out = []
        for m in self.pattern.finditer(text[start - 1 : stop + 1]):
            if self.exact <= set(m[0].split(" ")):
                out.append((m.start() + start - 1, m.end() + start - 1, sum(m.fuzzy_counts)))
        return out


class Scanner:
    def __init__(self, base=BASE, notices=NOTICES):
        self.notices = [Notice(*x, True) for x in base] + [Notice(*x, False) for x in notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in notice.pieces():
                pieces.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple], float]:
        """Number of words, the spans by start, end and label, and the best likeness."""
        words = text.encode("utf-8").lower().translate(_WORDS).split()
        joined = (b" " + b" ".join(words) + b" ").decode("utf-8")
        windows: dict[int, list[list[int]]] = {}
        found: dict[tuple[int, int, str], tuple[int, bool]] = {}
        score = 0.0
        for last, (size, places) in self.automaton.iter(joined):
            for i, offset in places:
                notice = self.notices[i]
                at = last - size + 1 - offset
                if notice.base and at > 0 and joined.startswith(notice.text, at) and joined[at - 1] == " " == joined[at + len(notice.text)]:
                    found[at, at + len(notice.text), notice.label], score = (0, True), 1.0
                start, stop = max(1, at - notice.errors), min(len(joined) - 1, at + len(notice.text) + notice.errors)
                windows.setdefault(i, []).append([start, stop])
        for i, around in windows.items():
            notice, merged = self.notices[i], []
            for start, stop in sorted(around):
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            for start, stop in merged:
                for a, b, edits in notice.matches(joined, start, stop):
                    score = max(score, 1 - edits / len(notice.text))
                    known = found.get((a, b, notice.label))
                    if known is None or edits < known[0]:
                        found[a, b, notice.label] = (edits, False)
        return len(words), self._told(text, joined, found), score

    def _told(self, text: str, joined: str, found: dict) -> list[tuple]:
        if not found:
            return []
        borders = [i for i, c in enumerate(joined) if c == " "]
        places = [(m.start(), m.end()) for m in _WORD.finditer(lowered(text))]
        out = []
        for (a, b, label), (edits, base) in sorted(found.items()):
            first, last = bisect_left(borders, a) - 1, bisect_left(borders, b) - 1
            out.append((label, places[first][0], places[last][1], first, edits, base))
        return out


def scan(docs: DataFrame, base=BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans, score of every row."""
    def make():
        own = Scanner(base, notices)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, spans, scores = [], [], []
            for text in batch.column("text"):
                n, found, score = own.scan(text.as_py())
                counts.append(n)
                spans.append([dict(zip(("label", "start", "end", "word", "edits", "base"), x, strict=True)) for x in found])
                scores.append(score)
            kind = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(kind)), pa.array(scores, pa.float64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "spans", "score"])

        return each

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return arrow_rows(source, make, f"doc_id long, n_words long, spans {SPANS}, score double")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.filter("spans", lambda x: x["base"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    starts = F.transform(base, lambda x: x["word"])
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), "score",
    )
