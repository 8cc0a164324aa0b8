"""Keys: three digits of segment and a suffix of seven digits.

Registries that outgrow ten digits have longer suffixes; nothing is ever cut off a key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.constants import SEGMENTS, STATUS_CODES

SUFFIX_DIGITS = 7


def suffix_text(number: Column) -> Column:
    """A suffix as text: seven digits, or more where the number has more."""
    return F.format_string(f"%0{SUFFIX_DIGITS}d", number)


def key_text(number: Column) -> Column:
    """A key as text: ten digits, or more where the number has more."""
    return F.format_string(f"%0{SUFFIX_DIGITS + 3}d", number.cast("long"))


def suffix_of(number: Column) -> Column:
    return _rest(key_text(number), 4)


def segment_of(number: Column) -> Column:
    return F.substring(key_text(number), 1, 3).cast("int")


def _rest(text: Column, start: int) -> Column:
    return F.substring(text, F.lit(start), F.length(text))


def dashed(number: Column) -> Column:
    """8002000000 -> 800-200-0000"""
    d = key_text(number)
    return F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), _rest(d, 7))


def segment_form(number: Column) -> Column:
    """8002000000 -> 800-2000000"""
    d = key_text(number)
    return F.concat_ws("-", F.substring(d, 1, 3), _rest(d, 4))


def keypad_digits(text: Column) -> Column:
    """Letters to keypad digits, everything else but digits removed."""
    # The telephone keypad.
    typed = F.translate(F.upper(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
    return F.regexp_replace(typed, r"[^0-9]", "")


def normalize_key(text: Column, longest: int | None = SUFFIX_DIGITS) -> Column:
    """Any written form of a key to its digits, or NULL.

    `longest` is the number of suffix digits the registry has at most, None for any.
    """
    d = keypad_digits(text)
    d = F.when((F.length(d) > 3 + SUFFIX_DIGITS) & d.startswith("1"), _rest(d, 2)).otherwise(d)
    valid = (F.length(d) >= 3 + SUFFIX_DIGITS) & F.substring(d, 1, 3).isin([str(s) for s in SEGMENTS])
    if longest is not None:
        valid = valid & (F.length(d) <= 3 + longest)
    return F.when(valid, d)


def status_code(name: Column) -> Column:
    out = F.lit(0)
    for text, code in STATUS_CODES.items():
        out = F.when(name == text, code).otherwise(out)
    return out


def status_name(code: Column) -> Column:
    out = F.lit("?")
    for text, number in STATUS_CODES.items():
        out = F.when(code == number, text).otherwise(out)
    return out
