"""Column expressions for addresses, contacts, brands, domains and rich text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State names that may end an address, and their codes.
STATE_CODES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA",
    "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS",
    "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH",
    "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA",
    "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN",
    "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY", "District Of Columbia": "DC",
    "District of Columbia": "DC", "Puerto Rico": "PR",
}

# Brand, confidence and pattern, tested in this order on the lower-cased street.
BRANDS = [
    ("The UPS Store", "high", r"\b(the\s+)?ups\s+store\b"),
    ("Mail Boxes Etc", "high", r"\bmail\s*box(es)?\s*etc\.?\b|\bmbe\s*#"),
    ("PostNet", "high", r"\bpost[\s\-]?net\b"),
    ("iPostal", "high", r"\bipostal1?\b"),
    ("Earth Class Mail", "high", r"\bearth\s+class\s+mail\b"),
    ("PostalAnnex", "high", r"\bpostal\s*annex\b"),
    ("AIM Mail Center", "high", r"\baim\s+mail\s+center\b"),
    ("Pak Mail", "high", r"\bpak[\s\-]?mail\b"),
    ("Regus", "high", r"\bregus\b"),
    ("WeWork", "high", r"\bwe[\s\-]?work\b"),
    ("Davinci Virtual", "high", r"\bdavinci\s+(virtual|meeting)\b"),
    ("Alliance Virtual", "high", r"\balliance\s+virtual\b"),
    ("Opus Virtual Offices", "high", r"\bopus\s+virtual\b"),
    ("Intelligent Office", "high", r"\bintelligent\s+office\b"),
    ("Spaces (IWG)", "high", r"\bspaces\s+(coworking|@|\-)"),
    ("Premier Workspaces", "high", r"\bpremier\s+workspaces?\b"),
    ("Industrious", "high", r"\bindustrious\s+(office|coworking)\b"),
    ("Private Mailbox (PMB)", "medium", r"\bpmb\s*#|\bprivate\s+mail\s*box\b|\s+pmb\s+\d"),
    ("Virtual Office (generic)", "medium", r"\bvirtual\s+office\b"),
    ("Coworking (generic)", "medium", r"\bco[\s\-]?working\b"),
    ("P.O. Box", "medium", r"\bp\.?\s*o\.?\s*box\b|\bpost\s+office\s+box\b"),
]


# Forms of telephone numbers, postal codes, mail addresses and marked numbers.
PHONE_END = r"(\d{3}-\d{3}-\d{4}|\d{10})\s*$"
ZIP_END = r"\s+([A-Z]?\d{5}(?:-?\d{4})?|[A-Z]\d[A-Z]\s?\d[A-Z]\d)\s*$"
MAIL = r"\b([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"
MARKED_PHONE, MARKED_FAX = r"P:\s*([\w\-\. ]+?)(?=F:|$)", r"F:\s*([\w\-\. ]+)$"


def stripped(text: Column) -> Column:
    """Without blanks and line breaks at both ends."""
    return F.trim(text, F.lit(" \t\n\r\x0b\x0c"))


def _peel(rest: Column, pattern: str) -> tuple[Column, Column]:
    """The group at the end of the text and the text before it."""
    return F.regexp_extract(rest, pattern, 1), stripped(F.regexp_replace(rest, pattern, ""))


def split_address(df, column: str):
    """Add street, city, state, country, zip and phone, peeled off one string from its end.

    Every step is a column of its own, so that no expression is repeated in the next one.
    """
    states = "|".join(STATE_CODES)
    empty = F.lit("")

    def peel(frame, name: str, pattern: str):
        got, left = _peel(F.col("rest"), pattern)
        return frame.withColumns({name: got, "rest": left})

    out = df.withColumn("rest", stripped(F.coalesce(F.col(column), empty)))
    out = peel(out, "phone", PHONE_END)
    out = peel(out, "zip", ZIP_END)
    out = peel(out, "country", r"(?s),([^,]*)$")
    out = out.withColumn("country", stripped(F.col("country")))
    out = peel(out, "named_state", rf" ({states})$")
    short = r"\s+([A-Z]{2})\s*$"
    unnamed = F.col("named_state") == ""
    got, left = _peel(F.col("rest"), short)
    out = out.withColumns(
        {"state": F.when(unnamed, got).otherwise(F.col("named_state")), "rest": F.when(unnamed, left).otherwise(F.col("rest"))}
    )
    # two blanks part street and city; else the last one to three capitalised words are the city
    wide = F.col("rest").contains("  ")
    flat = F.regexp_replace("rest", r"\s+", " ")
    tail = r"(?:^|\s)((?:\p{Lu}[^\s\d]* ){0,2}\p{Lu}[^\s\d]*)$"
    city = F.when(wide, F.regexp_extract("rest", r"(?s)^.*  (.*)$", 1)).otherwise(F.regexp_extract(flat, tail, 1))
    street = (
        F.when(wide, F.regexp_extract("rest", r"(?s)^(.*)  .*$", 1))
        .when(flat.rlike(tail), F.regexp_replace(flat, tail, ""))
        .otherwise(F.col("rest"))
    )
    return out.withColumns({"street": stripped(street), "city": stripped(city)}).drop("rest", "named_state")


def contact_struct(text: Column) -> Column:
    """Name, email, phone after P: and fax after F: from one string."""
    s = stripped(F.coalesce(text, F.lit("")))
    email = F.regexp_extract(s, MAIL, 1)
    has = email != ""
    rest = F.when(has, stripped(F.regexp_replace(s, rf"(?s)^.*?{MAIL}", ""))).otherwise(s)
    before = stripped(F.regexp_extract(s, rf"(?s)^(.*?){MAIL}", 1))
    return F.struct(
        F.when(has, before).otherwise(rest).alias("name"),
        email.alias("email"),
        stripped(F.regexp_extract(rest, MARKED_PHONE, 1)).alias("phone"),
        stripped(F.regexp_extract(rest, MARKED_FAX, 1)).alias("fax"),
    )


def brand_of(street: Column) -> Column:
    """struct(brand, confidence, raw_hit) of the first brand pattern that fits, or NULL."""
    low = F.lower(street)
    out = F.lit(None)
    for brand, confidence, pattern in reversed(BRANDS):
        at = F.regexp_instr(low, F.lit(pattern))
        start = F.greatest(at - 10, F.lit(1))
        end = at + F.length(F.regexp_extract(low, pattern, 0)) + 10
        snippet = F.trim(F.substring(street, start, end - start))
        found = F.struct(
            F.lit(brand).alias("brand"), F.lit(confidence).alias("confidence"), snippet.alias("raw_hit")
        )
        out = F.when(low.rlike(pattern), found).otherwise(out)
    return out


def address_key(address: Column) -> Column:
    """Street, city and state in one normal form; NULL without street or city."""

    def low(field: str) -> Column:
        return F.trim(F.lower(F.coalesce(address.getField(field), F.lit(""))))

    street = F.regexp_replace(F.regexp_replace(low("street1"), r"\s+", " "), r"[ .,]+$", "")
    usable = (low("street1") != "") & (low("city") != "")
    return F.when(usable, F.concat_ws("|", street, low("city"), low("state")))


def domain_of(text: Column) -> Column:
    """Host name of a URL or bare domain, lower case without www., or NULL."""
    raw = F.lower(F.trim(text))
    url = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("http://"), raw))
    net = F.regexp_extract(url, r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(net, r"^.*@", ""), r":.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.trim(host), r"^\.+", ""), r"^www\.", "")
    good = F.contains(host, F.lit(".")) & ~F.contains(host, F.lit(" ")) & (F.length(host) >= 4)
    return F.when(good, host)


def plain_text(blocks: Column) -> Column:
    """Text blocks of a rich-text array joined by a blank line."""
    texts = F.filter(blocks, lambda b: b["_type"] == "block")
    joined = F.transform(
        texts, lambda b: F.array_join(F.transform(b["children"], lambda c: F.coalesce(c["text"], F.lit(""))), "")
    )
    return F.coalesce(stripped(F.array_join(joined, "\n\n")), F.lit(""))


def needle_pattern(needle: Column) -> Column:
    """Regular expression that finds the needle between word boundaries.

    Beside a letter, digit or underscore at its edge the needle needs a non-word neighbour,
    beside any other edge character a word neighbour.
    """
    word = r"[\p{L}\p{N}_]"
    quoted = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    head = F.when(needle.rlike(rf"^{word}"), rf"(?<!{word})").otherwise(rf"(?<={word})")
    tail = F.when(needle.rlike(rf"{word}$"), rf"(?!{word})").otherwise(rf"(?={word})")
    return F.concat(head, quoted, tail)
