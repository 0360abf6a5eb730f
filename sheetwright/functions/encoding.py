"""Bytes to text: UTF-8 with or without BOM, else Windows-1252, else Latin-1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Windows-1252 glyphs for the bytes 0x80-0x9F, in byte order.
# The five bytes without a glyph (81, 8D, 8F, 90, 9D) are absent.
CP1252_BYTES = (
    "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e"
    "\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
)
CP1252_GLYPHS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CP1252_GAPS = r"[\x81\x8d\x8f\x90\x9d]"
BOM = "\ufeff"


def is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def latin1(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def without_bom(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit(BOM)), F.substring(text, 2, 2147483647)).otherwise(text)


def encoding_of(utf8: Column, has_gap_bytes: Column) -> Column:
    """Name of the encoding from two facts about the whole file."""
    return F.when(utf8, F.lit("utf-8")).when(has_gap_bytes, F.lit("latin-1")).otherwise(F.lit("cp1252"))


def has_gap_bytes(raw: Column) -> Column:
    """True when a byte occurs that Windows-1252 does not define."""
    return latin1(raw).rlike(CP1252_GAPS)


def decode_as(raw: Column, encoding: Column) -> Column:
    """Bytes to text under the encoding decided for the file."""
    plain = latin1(raw)
    return (
        F.when(encoding == "utf-8", without_bom(raw.cast("string")))
        .when(encoding == "latin-1", plain)
        .otherwise(F.translate(plain, CP1252_BYTES, CP1252_GLYPHS))
    )


def decode_bytes(raw: Column) -> Column:
    """Whole content to text, the encoding being decided from the content."""
    return decode_as(raw, encoding_of(is_utf8(raw), has_gap_bytes(raw)))
