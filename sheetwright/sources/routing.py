"""Which reader a file goes to, by its suffix; the rest is quarantined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# File suffixes per kind of source.
SUFFIXES = {
    "spreadsheet": ["xlsx", "xls"],
    "csv": ["csv"],
    "pdf": ["pdf"],
    "image": ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp"],
}


def file_suffix(path: Column) -> Column:
    """Lower-cased suffix without its dot, '' when there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def route_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``suffix``, ``route`` and, for files without a reader, ``reason``."""
    suffixed = files.withColumn("suffix", file_suffix(F.col(path_col)))
    route = F.lit("quarantine")
    for kind, suffixes in SUFFIXES.items():
        route = F.when(F.col("suffix").isin(*suffixes), F.lit(kind)).otherwise(route)
    shown = F.when(F.col("suffix") == "", F.lit("(no extension)")).otherwise(F.concat(F.lit("."), F.col("suffix")))
    return suffixed.withColumn("route", route).withColumn(
        "reason",
        F.when(F.col("route") == "quarantine", F.concat(F.lit("Unsupported file type: "), shown)),
    )


def quarantine(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("route") == "quarantine")


def without_reader(routed: DataFrame, readable: list[str]) -> DataFrame:
    """Files of other kinds than the ``readable`` ones, each with a ``reason``."""
    extracted = F.concat(F.lit("Needs extracted content: "), F.col("route"))
    return routed.where(~F.col("route").isin(*readable)).withColumn("reason", F.coalesce("reason", extracted))
