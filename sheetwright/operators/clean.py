"""Cleaning: blanks, empty rows and columns, numbers, for many tables at once
(row arrays) or for one big table (ordinary columns)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import numbers as N
from ..functions.text import blank_to_null, is_filled
from .joining import join_back
from .ordered import numbered
from .profile import (
    TABLE_KEY,
    _string_columns,
    as_text,
    cells_are_typed,
    column_decisions,
    typed_cell,
    wide_decisions,
)


def drop_empty_rows(rows: DataFrame) -> DataFrame:
    """Drop rows without a filled cell. A row that knows its page is kept:
    the page number is a value too."""
    if cells_are_typed(rows):
        filled = F.exists(
            "cells",
            lambda c: is_filled(c["text"]) | c["num"].isNotNull() | c["ts"].isNotNull() | c["flag"].isNotNull(),
        )
    else:
        filled = F.exists("cells", is_filled)
    if "source_page" in rows.columns:
        filled = F.col("source_page").isNotNull() | filled
    return rows.where(filled)


def renumber(rows: DataFrame, rows_per_range: int = 1_000_000) -> DataFrame:
    """Number the rows of each table 0, 1, 2 … in their present order."""
    counted = numbered(rows, TABLE_KEY, ["row_no"], "place", rows_per_range)
    return counted.withColumn("row_no", F.col("place") - 1).drop("place")


def packed_decisions(decisions: DataFrame) -> DataFrame:
    """One row per table: an array of (type, fmt) with null for empty columns."""
    entry = F.struct("col_no", F.struct("type", "fmt").alias("plan"))
    by_column = decisions.groupBy(*TABLE_KEY).agg(
        F.map_from_entries(F.collect_list(entry)).alias("plans"),
        F.max("col_no").alias("last"),
        F.sum("n_filled").alias("n_cells"),
    )
    plans = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at(F.col("plans"), i))
    return by_column.select(*TABLE_KEY, plans.alias("plans"), "n_cells")


def apply_decisions(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Turn every cell into the type decided for its column.

    Decisions are packed per table first, so the join is by table and carries
    rows, not cells; see ``join_back`` for how a huge table is kept whole but
    spread. Cells are blanked, rewritten and parsed in steps, each computed
    once; only the last makes a structure of each cell.
    """
    joined = join_back(rows, packed_decisions(decisions), TABLE_KEY, "n_cells")
    typed = cells_are_typed(rows)
    plans = F.coalesce("plans", F.array().cast(joined.schema["plans"].dataType))

    def blanked(c: Column) -> Column:
        return typed_cell(blank_to_null(c["text"]), c["num"], c["ts"], c["flag"]) if typed else blank_to_null(c)

    def plain(c: Column, p: Column) -> Column:
        return F.when(p["type"] == "number", N.to_plain_by(N.strip_units(c["text"] if typed else c), p["fmt"]))

    def parsed(c: Column, p: Column, text: Column) -> Column:
        kind, number = p["type"], N.parse_plain(text)
        if not typed:
            return typed_cell(F.when(kind == "text", c), number)
        as_word = as_text(*[c[f] for f in ("text", "num", "ts", "flag")])
        number = F.coalesce(number, F.when(kind == "number", F.coalesce(c["num"], c["flag"].cast("double"))))
        return typed_cell(
            F.when(kind == "text", as_word), number, F.when(kind == "timestamp", c["ts"]), F.when(kind == "boolean", c["flag"])
        )

    def plan(i: Column) -> Column:
        return F.get("plans", i)

    joined = joined.withColumns({"plans": plans, "cells": F.transform("cells", blanked)})
    joined = joined.withColumn("plain_cells", F.transform("cells", lambda c, i: plain(c, plan(i))))
    joined = joined.withColumn("cells", F.transform("cells", lambda c, i: parsed(c, plan(i), F.get("plain_cells", i))))
    return joined.drop("plans", "plain_cells")


def normalize_rows(
    rows: DataFrame,
    identifier_mode: str = "all_values",
    default: str = "german",
    decisions: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Clean and type the rows of many tables; returns (rows, decisions).

    Columns that are empty throughout have no decision and stay null.
    """
    kept = drop_empty_rows(rows)
    if decisions is None:
        decisions = column_decisions(kept, identifier_mode, default)
    return apply_decisions(kept, decisions), decisions


def to_cells(typed_rows: DataFrame) -> DataFrame:
    """Typed rows as one row per filled cell."""
    extra = [c for c in ("row_no", "source_page") if c in typed_rows.columns]
    return (
        typed_rows.select(*TABLE_KEY, *extra, F.posexplode_outer("cells").alias("col_no", "cell"))
        .select(*TABLE_KEY, *extra, "col_no", "cell.*")
        .where("text is not null or num is not null or ts is not null or flag is not null")
    )


def to_wide(typed_rows: DataFrame, columns: list[tuple[int, str, str]]) -> DataFrame:
    """Rows of like tables as ordinary columns; ``columns`` lists (col_no, name, type)."""
    field = {"number": "num", "text": "text", "timestamp": "ts", "boolean": "flag"}
    extra = [c for c in ("row_no", "source_page") if c in typed_rows.columns]
    picked = [
        F.try_element_at("cells", F.lit(no + 1))[field[kind]].alias(name)
        for no, name, kind in columns
        if kind in field
    ]
    return typed_rows.select(*TABLE_KEY, *extra, *picked)


# --- One big table -------------------------------------------------------------


def drop_empty(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Blank text to null, then rows without any value, then columns without
    any value. Columns in ``keep`` are neither tested nor dropped."""
    tested = [f for f in df.schema.fields if f.name not in (keep or [])]
    blanked = df.select(*[
        blank_to_null(F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) and f in tested
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
    kept = blanked.where(reduce(or_, [F.col(f"`{f.name}`").isNotNull() for f in tested]))
    filled = kept.agg(*[F.count(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(tested)]).first()
    return kept.drop(*[f.name for i, f in enumerate(tested) if filled[f"c{i}"] == 0])


def normalize_table(
    df: DataFrame,
    columns: list[str] | None = None,
    identifier_mode: str = "all_values",
    default: str = "german",
) -> DataFrame:
    """Text columns of one big table become numbers where their values say so.

    Typed columns are not touched. Conversion is a projection, so a later
    query still reads only the columns it needs.
    """
    decided = wide_decisions(df, columns, identifier_mode, default)
    names = set(_string_columns(df, columns))

    def rewritten(name: str) -> Column:
        c = F.col(f"`{name}`")
        if name not in names:
            return c
        kind, fmt = decided[name]
        text = N.to_plain(N.strip_units(c), fmt) if kind == "number" else blank_to_null(c)
        return text.alias(name)

    def parsed(name: str) -> Column:
        c = F.col(f"`{name}`")
        is_number = name in names and decided[name][0] == "number"
        return N.parse_plain(c).alias(name) if is_number else c

    return df.select(*[rewritten(c) for c in df.columns]).select(*[parsed(c) for c in df.columns])
