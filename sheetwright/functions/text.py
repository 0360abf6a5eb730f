"""Text expressions: whitespace, cells, names, cut-offs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters a Unicode-aware strip() treats as whitespace,
# once as the inside of a regex class and once as a plain string for btrim.
SPACE_CLASS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line boundaries, \r\n counting as one.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

CUT_MARKER = " ... (result cut off here, it is longer)"


def strip(c: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_filled(c: Column) -> Column:
    """True for a value that is neither null nor only whitespace; most show it by their first character."""
    return F.coalesce(((c >= "!") & (c < "\x7f")) | (F.ltrim(c, F.lit(SPACE_CHARS)) != ""), F.lit(False))


def blank_to_null(c: Column) -> Column:
    """Whitespace-only text becomes null; other text is left as it is."""
    return F.when(is_filled(c), c)


def squeeze(c: Column) -> Column:
    """Whitespace runs become one space, ends are trimmed, null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{SPACE_CLASS}]+", " "))


def safe_table_name(c: Column) -> Column:
    """Every character that is not a letter, digit or underscore becomes '_'."""
    cleaned = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")
    return F.when(cleaned == "", F.lit("data")).otherwise(F.coalesce(cleaned, F.lit("data")))


def safe_file_name(c: Column) -> Column:
    """As for tables, with '.' and '-' allowed and 'upload' for a missing name."""
    named = F.when(c != "", c).otherwise(F.lit("upload"))
    return F.regexp_replace(named, r"[^\p{L}\p{N}._-]", "_")


def cut_text(c: Column, limit: int = 20000, marker: str = CUT_MARKER) -> Column:
    """The first ``limit`` characters and a marker saying that more follows."""
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(marker))).otherwise(c)


def error_tail(c: Column, limit: int = 2000) -> Column:
    """The last ``limit`` characters, where the cause of an error stands."""
    return F.when(F.length(c) > limit, F.right(c, F.lit(limit))).otherwise(c)


def lines_of(c: Column) -> Column:
    """Text as an array of lines."""
    return F.split(c, LINE_BREAK)
