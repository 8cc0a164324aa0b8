"""Personal data: base patterns, widened by bootstrapped contextual extraction.

The base kinds are regular expressions with checks (parts of an address, the Luhn digit,
the number of digits). Their matches are the seeds of a bootstrap that looks for
identifiers of other forms:

1. Items are the base matches and all other tokens with a digit or an at sign. Each stands
   in two lexical patterns: the two words before it, and the word on either side.
2. Patterns and instances form a bipartite graph with one edge for each distinct pair. In
   each round a pattern's confidence for a kind is the sum of its instances' confidences
   over their number plus a smoothing term, and nought below a least support; an
   instance's is the best of its patterns'. Seeds keep the confidence one for their kind.
3. A token is taken as a kind when one of its own patterns is trusted for that kind and its
   form fits the kind loosely. Base matches always stay, and nothing that overlaps one is
   added.

All of it is DataFrame work: the documents are read once, the items (a small part of the
text) are written to the shared folder, and each round is two aggregations and a join. An
edge is counted once however many copies of a text hold it, and partial sums are taken
before each shuffle, so a hot pattern is one row per task.

Cases: null and empty texts have no spans. Repeated rows and ids each get their row, an
empty table gives an empty result. Only the id and the text column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm import spans as sp
from rollbook.llm.common import content_key, text_of, written

#: The kinds in their order, with patterns of the same matches as the plain
#: ones. A look-behind keeps a search from starting anew inside a run that has failed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])[0-9](?:[\\x20-]?+[0-9]){11,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TOKEN = "(?<!\\S)\\S*[0-9@]\\S*"
#: Loose forms of what a trusted context may hold.
FORMS = {
    "email": "^[^\\s@]+(?:@|\\(at\\)|\\[at\\])[^\\s@]+$",
    "ip": "^(?:[0-9]{1,3}[.:-]){3}[0-9]{1,3}$|^(?:[0-9a-fA-F]{0,4}:){3,7}[0-9a-fA-F]{0,4}$",
    "card": "^(?:[0-9][-./]?){12,19}$",
    "phone": "^\\(?[0-9][0-9().+/-]{5,}[0-9]$",
}

#: Rounds of the bootstrap, least number of seed instances of a trusted pattern, smoothing,
#: and the confidence from which a pattern is trusted.
ROUNDS, SUPPORT, SMOOTH, TRUST = 3, 5.0, 0.5, 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The sum with every second digit from the right doubled is a multiple of ten."""
    each = F.split(F.reverse(digits), "", -1)

    def value(d: Column, i: Column) -> Column:
        n = F.coalesce(F.when(d != "", d).cast("int"), F.lit(0))
        return F.when(i % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{IP_PART}(?:\\.{IP_PART}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (s, o, e, kind) of the base kinds."""
    each = []
    for order, kind in enumerate(KINDS):
        valid = F.filter(sp.find(text, PATTERNS[kind]), lambda x: _valid(kind, x["v"]))  # noqa: B023
        if kind == "email":
            valid = F.when(F.contains(text, F.lit("@")), valid).otherwise(F.expr(sp.NONE))
        each.append(sp.tagged(valid, kind, order))
    return F.flatten(F.array(*each))


def _contexts(text: Column, item: Column) -> Column:
    """The two lexical patterns of an item; null where the words are missing."""
    before = F.lower(F.substring(text, F.greatest(item["s"] - 79, F.lit(1)), F.least(item["s"], F.lit(80))))
    after = F.lower(F.substring(text, item["e"] + 1, F.lit(40)))
    word = "([^\\s0-9@]{1,30})"
    two, one = F.regexp_extract(before, word + "\\s+" + word + "\\s*[\"'(<]?$", 0), F.regexp_extract(before, word + "\\s*[\"'(<]?$", 1)
    behind = F.regexp_extract(after, "^[\"')>.,;]?\\s*" + word + "(?:\\s|$)", 1)
    squeezed = F.trim(F.regexp_replace(two, "\\s+", " "))
    return F.array_compact(
        F.array(
            F.when(F.length(squeezed) > 0, F.concat(F.lit("L "), squeezed)),
            F.when((F.length(one) > 0) & (F.length(behind) > 0), F.concat(F.lit("B "), one, F.lit(" _ "), behind)),
        )
    )


def _without(tokens: Column, base: Column) -> Column:
    return F.filter(tokens, lambda t: ~F.exists(base, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))


def _trimmed(spans: Column) -> Column:
    """Tokens without the punctuation around them."""

    def cut(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["v"], "^[\"'(<\\[{,;:]*", 0))
        body = F.regexp_extract(x["v"], "^[\"'(<\\[{,;:]*(.*?)[\"')>\\]},;:.!?]*$", 1)
        return F.struct((x["s"] + lead).alias("s"), (x["s"] + lead + F.length(body)).alias("e"), body.alias("v"))

    return F.filter(F.transform(spans, cut), lambda x: x["e"] > x["s"])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content key, base spans and items (s, e, kind or null, v, patterns) of every text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", "text", *content_key(F.col("text")), F.array_sort(base_spans(F.col("text"))).alias("base"))
    text = F.col("text")
    seeds = F.transform("base", lambda b: F.struct(b["s"], b["e"], F.substring(text, b["s"] + 1, b["e"] - b["s"]).alias("v"), b["kind"].alias("kind")))
    others = F.transform(_without(_trimmed(sp.find(text, TOKEN)), F.col("base")), lambda t: F.struct(t["s"], t["e"], t["v"], F.lit(None).cast("string").alias("kind")))
    items = F.transform(F.concat(seeds, others), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["kind"].alias("kind"), _contexts(text, x).alias("patterns")))
    return rows.select("doc_id", "k1", "k2", "base", F.filter(items, lambda x: F.size(x["patterns"]) > 0).alias("items"))


def score_patterns(edges: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT) -> DataFrame:
    """(pattern, kind) trusted after the rounds. `edges` has distinct (pattern, v, kind or null)."""
    seed = [F.when(F.col("kind") == k, 1.0).otherwise(0.0) for k in KINDS]
    graph = edges.select("pattern", "v", *[s.alias(f"seed_{k}") for k, s in zip(KINDS, seed, strict=True)])
    own = graph.select("*", *[F.col(f"seed_{k}").alias(f"c_{k}") for k in KINDS])
    for n in range(rounds):
        sums = own.groupBy("pattern").agg(F.count("*").alias("n"), *[F.sum(f"c_{k}").alias(f"p_{k}") for k in KINDS])
        conf = sums.select("pattern", *[F.when(F.col(f"p_{k}") >= support, F.col(f"p_{k}") / (F.col("n") + SMOOTH)).otherwise(0.0).alias(f"p_{k}") for k in KINDS])
        if n + 1 < rounds:
            best = graph.join(conf, "pattern").groupBy("v").agg(*[F.max(f"p_{k}").alias(f"b_{k}") for k in KINDS])
            own = graph.join(best, "v").select("pattern", "v", *[F.greatest(f"seed_{k}", f"b_{k}").alias(f"c_{k}") for k in KINDS])
    per_kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"p_{k}").alias("confidence")) for k in KINDS]))
    return conf.select("pattern", per_kind.alias("x")).select("pattern", "x.*").where(F.col("confidence") >= TRUST)


def discovered(rows: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT) -> DataFrame:
    """(k1, k2, more): spans beyond the base ones, by the content key of the text."""
    items = rows.select("k1", "k2", F.explode("items").alias("x")).select("k1", "k2", "x.s", "x.e", "x.v", "x.kind", F.explode("x.patterns").alias("pattern"))
    edges = items.groupBy("pattern", "v").agg(F.max("kind").alias("kind"))
    trusted = score_patterns(edges, rounds, support)
    loose = [(F.col("kind") == k) & F.col("v").rlike(form) for k, form in FORMS.items()]
    fits = loose[0] | loose[1] | loose[2] | loose[3]
    new = items.where("kind is null").drop("kind").join(trusted, "pattern").where(fits)
    place = F.element_at(F.create_map(*[F.lit(y) for n, k in enumerate(KINDS) for y in (k, n)]), F.col("kind"))
    # one kind per token: that of the most confident pattern
    one = new.groupBy("k1", "k2", "s", "e").agg(F.max(F.struct("confidence", "kind"))["kind"].alias("kind"))
    span = F.struct("s", place.alias("o"), "e", "kind")
    return one.groupBy("k1", "k2").agg(F.collect_set(span).alias("more"))


def _all(base: Column) -> Column:
    return F.array_sort(F.concat(base, F.coalesce("more", sp.tagged(F.expr(sp.NONE), "", 0))))


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, support: float = SUPPORT) -> DataFrame:
    """doc_id, content key, `base` and `found` (all spans) as arrays of (s, o, e, kind)."""
    rows = written(marked(docs, id_col, text_col), "pii-items")
    more = discovered(rows, rounds, support)
    return rows.drop("items").join(more, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "base", _all(F.col("base")).alias("found"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents with every span in the text replaced by its kind, and the length set anew.

    All other columns stay. What the bootstrap found is written first, so Spark joins it to
    the documents as its size allows; base spans are found again in the pass that replaces.
    """
    more = written(discovered(written(marked(docs.select(F.lit(0).alias("doc_id"), text_of(text_col).alias("text"))), "pii-items")), "pii-more")
    k1, k2 = content_key(text_of(text_col))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    more = more.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("more").alias("__more"))
    base = F.array_sort(base_spans(text_of(text_col)))
    found = F.array_sort(F.concat(base, F.coalesce("__more", sp.tagged(F.expr(sp.NONE), "", 0))))
    rows = keyed.join(more, ["__k1", "__k2"], "left").withColumn("__found", found)
    new = F.when(F.size("__found") > 0, redacted(F.col(text_col), F.col("__found"))).otherwise(F.col(text_col))
    rows = rows.withColumn("__new", new)
    out = [F.col("__new").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if chars_col in docs.columns:
        length = F.when(F.size("__found") > 0, F.length("__new")).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
        out[docs.columns.index(chars_col)] = length.alias(chars_col)
    return rows.select(*out)


def digests(extracted: DataFrame) -> DataFrame:
    counts = [sp.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return extracted.select("doc_id", *counts, F.sha2(sp.spelled(F.col("base")), 256).alias("base_sha256"), sp.spelled(F.col("found")).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlaps are one gap."""

    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]
        piece = F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), piece.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(F.array_sort(found), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, cut).otherwise(text)
