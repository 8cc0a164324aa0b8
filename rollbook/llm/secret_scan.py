"""Secret scan over a trigram inverted index.

Every rule is a regular expression. From its syntax tree follows a Boolean query over the
trigrams of the lower-cased text that each match must hold: literals give ANDs of their
trigrams, alternatives ORs. The index maps those trigrams to the texts that contain them
(postings); per clause of a query the postings are intersected, and only the texts that
remain are read again and verified by the regular expression itself. A rule without a
mandatory trigram has no query, and every text is scanned for it.

Texts are known by 128 bits of their content, so copies share their postings, ids may be
null or repeated, and a collision could only add a candidate, never lose one.

Cases: null and empty texts have no spans. Repeated rows each get their row, an empty table
gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm import spans as sp
from rollbook.llm.common import content_key, text_of


@dataclass(frozen=True)
class Rule:
    """`shape` is given to the index, `pattern` to the scan; `least` is the least length of
    the match, or of its last group if `measured` has the pattern with that group."""

    kind: str
    pattern: str
    least: int = 1
    measured: str = ""
    clauses: tuple[frozenset[str], ...] = field(default=(), compare=False)


_NAME = "(?i:password|passwd|secret|token|api_?key)"
_JOIN = "[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]+"

#: The three base kinds and further public token formats, in the order of kinds.
BASE = (
    Rule("assign", _NAME + _JOIN + _VALUE, 12, "^" + _NAME + _JOIN + "(" + _VALUE + ")$"),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)

#: Literal alternatives that are spelled out at most; beyond it the literal is closed.
SPELLED = 16


def trigrams(literal: str) -> frozenset[str]:
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def _literals(node) -> list[str] | None:
    """The strings a node can match if they are few, else None."""
    kind, value = node
    if kind is op.LITERAL:
        return [chr(value)]
    if kind is op.SUBPATTERN:
        return _sequence(value[-1])
    if kind is op.BRANCH:
        found = [_sequence(branch) for branch in value[1]]
        return None if None in found else [x for strings in found for x in strings]
    if kind is op.IN and all(k is op.LITERAL for k, _ in value):
        return [chr(v) for _, v in value]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] <= 2:
        inner = _sequence(value[2])
        return None if inner is None else ["".join(p) for n in range(value[0], value[1] + 1) for p in product(inner, repeat=n)]
    return None


def _sequence(nodes) -> list[str] | None:
    whole = [""]
    for node in nodes:
        strings = _literals(node)
        if strings is None or len(whole) * len(strings) > SPELLED:
            return None
        whole = [a + b for a in whole for b in strings]
    return whole


def clauses(pattern: str) -> tuple[frozenset[str], ...]:
    """The trigram query of a pattern as an OR of ANDs; empty if no trigram is mandatory.

    Runs of the pattern that can be spelled out each give an OR over their spellings; all
    runs are mandatory, so the clauses of the most selective one, plus those literals of the
    others that have a single spelling, form the query.
    """
    runs: list[list[str]] = [[""]]
    for node in parser.parse(pattern):
        strings = _literals(node)
        if strings is not None and len(runs[-1]) * len(strings) <= SPELLED:
            runs[-1] = [a + b for a in runs[-1] for b in strings]
        else:
            runs.append([""])
    queries = [[trigrams(x.lower()) for x in run] for run in runs]
    queries = [q for q in queries if all(q)]
    if not queries:
        return ()
    best = max(queries, key=lambda q: min(map(len, q)))
    always = frozenset().union(*(q[0] for q in queries if len(q) == 1))
    return tuple(dict.fromkeys(clause | always for clause in best))


def planned(rules: tuple[Rule, ...]) -> list[Rule]:
    return [Rule(r.kind, r.pattern, r.least, r.measured, clauses(r.pattern)) for r in rules]


def found(text: Column, rule: Rule) -> Column:
    def keep(x: Column) -> Column:
        measured = F.regexp_extract(x["v"], rule.measured, 1) if rule.measured else x["v"]
        return F.length(measured) >= rule.least

    spans = sp.find(text, rule.pattern)
    return F.filter(spans, keep) if rule.least > 1 else spans


def index(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """Postings: (trigram, k1, k2) for the trigrams that any query asks for."""
    wanted = sorted(set().union(*(c for r in rules for c in r.clauses)))
    low = docs.select(*content_key(text_of(text_col)), F.lower(text_of(text_col)).alias("low"))
    has = [F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in wanted]
    return low.select("k1", "k2", F.explode(F.array_compact(F.array(*has))).alias("trigram"))


def candidates(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """(k1, k2, kinds): the rules whose query a text meets. The table of clauses has the size of the rules."""
    rows = [(t, r.kind, n, len(c)) for r in rules for n, c in enumerate(r.clauses) for t in sorted(c)]
    wanted = postings.sparkSession.createDataFrame(rows, "trigram string, kind string, clause int, need int")
    met = postings.join(F.broadcast(wanted), "trigram").groupBy("k1", "k2", "kind", "clause", "need").agg(F.size(F.collect_set("trigram")).alias("n"))
    return met.where("n = need").groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and `found`, an array of (s, o, e, kind) of every whole text."""
    order = {r.kind: n for n, r in enumerate(rules)}
    plan = planned(rules)
    indexed, full = [r for r in plan if r.clauses], [r for r in plan if not r.clauses]
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), *content_key(text), text.alias("text"))

    def all_of(chosen: list[Rule], given: Column | None) -> Column:
        none = F.expr(sp.NONE)
        each = [
            sp.tagged(found(F.col("text"), r) if given is None else F.when(F.array_contains(given, r.kind), found(F.col("text"), r)).otherwise(none), r.kind, order[r.kind])
            for r in chosen
        ]
        return F.flatten(F.array(*each)) if each else sp.tagged(none, "", 0)

    hits = candidates(index(docs, plan, text_col), plan)
    verified = keyed.drop("doc_id").join(hits, ["k1", "k2"]).select("k1", "k2", all_of(indexed, F.col("kinds")).alias("more"))
    verified = verified.where(F.size("more") > 0).dropDuplicates(["k1", "k2"])
    scanned = keyed.select("doc_id", "k1", "k2", all_of(full, None).alias("scanned"))
    both = F.concat("scanned", F.coalesce("more", sp.tagged(F.expr(sp.NONE), "", 0)))
    return scanned.join(verified, ["k1", "k2"], "left").select("doc_id", F.array_sort(both).alias("found"))


def digests(scanned: DataFrame) -> DataFrame:
    """The counts and digests of the base kinds, and all spans as one string."""
    base = [r.kind for r in BASE]
    only = F.filter("found", lambda x: x["kind"].isin(base))
    counts = [sp.count(F.col("found"), k).alias(f"n_{k}") for k in base]
    return scanned.select("doc_id", *counts, F.sha2(sp.spelled(only), 256).alias("base_sha256"), sp.spelled(F.col("found")).alias("spans"))
