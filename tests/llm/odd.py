"""Rows that every operator has to bear, and plain versions to compare with."""

import collections
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    """n words that do not repeat soon."""
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORD[x // 65536 % 20] + WORD[x // 512 % 20][:3])
    return " ".join(out)


def rows():
    a = prose(120, 1)
    texts = [
        (1, a), (2, a), (2, a), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "Ünï çødé 漢字 🙂 " * 30), (8, prose(30_000, 2)),
        (None, a + " tail"), (None, None), (9, a.replace("alpha", "ALPHA") + " end"), (10, "aaaa" * 500), (11, "aaaa" * 300), (12, "x" * 5000),
        (13, prose(200, 3) + " mail me@example.org or +1 (555) 123-4567, 10.1.2.3 4111 1111 1111 1111 ok password = abcdefghijkl"),
        (14, "word " * 400), (15, prose(200, 3)),
    ]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]


def frame(spark, data=None, extra=False):
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    if extra:  # names that operators use themselves
        for name in ("k1", "k2", "cls", "h", "ids", "score", "kept", "base", "found", "more", "block", "place", "data", "low"):
            df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def components(texts):
    """By number of the text, the least number linked with it."""
    sets = [shingles(t) for t in texts]
    holders = collections.defaultdict(list)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, own in enumerate(sets):
        common = collections.Counter(m for s in own for m in holders[s])
        for m, both in common.items():
            if 100 * both >= 80 * (len(own) + len(sets[m]) - both):
                a, b = find(n), find(m)
                parent[max(a, b)] = min(a, b)
        for s in own:
            holders[s].append(n)
    return [find(n) for n in range(len(texts))]


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def personal(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    t = text or ""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def secrets(text):
    t = text or ""
    name = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(name, t, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def spelled(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
