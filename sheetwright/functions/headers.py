"""Header rows: recognising them and naming columns from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import SPACE_CLASS, safe_table_name, squeeze

# A filled cell that reads like a number, and header cells that
# stand for "no name".
NUMBER_LIKE = rf"^[-+]?[\d.,{SPACE_CLASS}]+(?:€|%|[Ee][Uu][Rr])?$"
NO_NAME = ("", "None", "nan", "NaN")


def looks_like_header(row: Column) -> Column:
    """Some cell is filled and no filled cell reads like a number."""
    return F.exists(row, lambda c: c != "") & ~F.exists(row, lambda c: c.rlike(NUMBER_LIKE))


def base_names(header: Column) -> Column:
    """Squeezed names, ``column_<position>`` where there is none."""
    def name(c: Column, i: Column) -> Column:
        text = squeeze(c)
        return F.when(text.isin(*NO_NAME), F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(text)

    return F.transform(header, name)


def _distinct_names(names: Column, taken: list[str]) -> Column:
    """Each name as it is, or with the smallest free suffix from 2 on.

    The result for a name depends on the names chosen before it, so this is a
    fold over the array. The search for a free suffix only runs for a name
    that is already taken. Names in ``taken`` are never given out.
    """
    def add(done: Column, name: Column) -> Column:
        def suffixed(k: Column) -> Column:
            return F.concat(name, F.lit("_"), k.cast("string"))

        free = F.filter(
            F.transform(F.sequence(F.lit(2), F.size(done) + 2), suffixed),
            lambda candidate: ~F.array_contains(done, candidate),
        )
        chosen = F.when(F.array_contains(done, name), F.element_at(free, 1)).otherwise(name)
        return F.concat(done, F.array(chosen))

    start = F.array(*[F.lit(t) for t in taken]).cast("array<string>")
    chosen = F.aggregate(names, start, add)
    return F.slice(chosen, F.lit(len(taken) + 1), F.size(names)) if taken else chosen


def unique_names(header: Column) -> Column:
    """Distinct column names for a header row."""
    return _distinct_names(base_names(header), [])


def sheet_table_names(sheets: Column) -> Column:
    """Distinct table names for the sheets of a workbook; ``document_text`` is
    kept for the text blocks."""
    return _distinct_names(F.transform(sheets, safe_table_name), ["document_text"])


def fit_width(row: Column, width: Column) -> Column:
    """Pad with '' or cut so that the row has exactly ``width`` cells."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)
