"""Numbers written in German (1.234,56) or US (1,234.56) style.

Everything here is a Column expression on one value. Which style a column
uses is decided from all its values in ``operators.profile``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import SPACE_CHARS

# What may surround a number: whitespace, currency signs, percent,
# and words for euro and pieces.
UNIT_SIGNS = SPACE_CHARS + "€$£%"
UNIT_WORDS = r"[Ee][Uu][Rr]|[Ssſ][Tt](?:[Kk\u212a]\.?|\.)"
BARE = r"^[-+0-9.,]*+$"
# A whole value in either style.
GERMAN_SHAPE = r"^-?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?$"
US_SHAPE = r"^-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?$"
# Separators that can be read in one style only. A separator
# followed by exactly three digits could be either and proves nothing.
GERMAN_PROOF = r",(?:\d{1,2}|\d{4,})$|\.\d{3},\d+$|\.\d{3}\.\d{3}"
US_PROOF = r"\.(?:\d{1,2}|\d{4,})$|,\d{3}\.\d+$|,\d{3},\d{3}"

_DIGITS = r"\d(?:_?\d)*+"
_NUMBER = rf"(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_INFINITE = r"[iI][nN][fF](?:[iI][nN][iI][tT][yY])?"
# Text that Python's float() takes, apart from "nan".
FLOAT_TEXT = rf"^[+-]?(?:{_NUMBER}|{_INFINITE})$"

# What every text that FLOAT_TEXT or a shape takes under some format looks like: a quick first test.
_MAY_BE_NUMBER = r"^[-+0-9.,iI][-+0-9.,_eEiInNfFtTyY]*+$"

FORMATS = ("german", "us", "plain")


def is_bare(c: Column) -> Column:
    """Nothing but digits, signs and separators: there is no unit to drop."""
    return c.rlike(BARE)


def may_be_number(cleaned: Column) -> Column:
    """False only where a value without units is not a number under any format."""
    return cleaned.rlike(_MAY_BE_NUMBER)


def strip_units(c: Column, bare: Column | None = None) -> Column:
    """Drop whitespace, currency signs, %, EUR, Stk. and St. from a value."""
    worded = F.when(c.rlike("[EeSsſ]"), F.regexp_replace(c, UNIT_WORDS, "")).otherwise(c)
    return F.when(is_bare(c) if bare is None else bare, c).otherwise(F.translate(worded, UNIT_SIGNS, ""))


def to_plain(cleaned: Column, fmt: str) -> Column:
    """Rewrite a value without units so that '.' is its decimal point."""
    if fmt == "german":
        return F.translate(cleaned, ",.", ".")
    if fmt == "us":
        return F.translate(cleaned, ",", "")
    return cleaned


def is_number(text: Column) -> Column:
    return text.rlike(FLOAT_TEXT)


def to_plain_by(cleaned: Column, fmt: Column) -> Column:
    """``to_plain`` under the format named by another column."""
    return (
        F.when(fmt == "german", to_plain(cleaned, "german"))
        .when(fmt == "us", to_plain(cleaned, "us"))
        .otherwise(cleaned)
    )


def parse_plain(text: Column) -> Column:
    """Text to double; null where it is not a number. Never raises.

    ``text`` is read more than once: give it a column, not a long expression.
    """
    digits = F.when(F.contains(text, F.lit("_")), F.replace(text, F.lit("_"), F.lit(""))).otherwise(text)
    return F.when(is_number(text), digits.try_cast("double"))


def parse_number(c: Column, fmt: str) -> Column:
    """One value under a known format ('german', 'us' or 'plain')."""
    return parse_plain(to_plain(strip_units(c), fmt))


def has_leading_zero(trimmed: Column) -> Column:
    return F.startswith(trimmed, F.lit("0")) & trimmed.rlike(r"^0\d+$")
