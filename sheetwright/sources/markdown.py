"""Markdown tables inside free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import LINE_BREAK, SPACE_CLASS, strip

# One or more lines in a row that start with a pipe and hold another one.
# Possessive, so that a block of any length is matched without backtracking.
TABLE_BLOCK = rf"(?:\n[{SPACE_CLASS}&&[^\n]]*+\|[^\n|]*+\|[^\n]*+)++"
# Fixed value: a cell of the line under a markdown header.
RULE_CELL = r"^:?-{2,}:?$"


def _cells(line: Column) -> Column:
    inner = F.btrim(strip(line), F.lit("|"))
    return F.transform(F.split(inner, r"\|"), lambda c: strip(F.btrim(strip(c), F.lit("*"))))


def _is_rule(row: Column) -> Column:
    return F.exists(row, lambda c: c != "") & F.forall(row, lambda c: (c == "") | c.rlike(RULE_CELL))


def tables_in(text: Column) -> Column:
    """All tables with at least two rows, as array<array<array<string>>>.

    Each text is handled inside its own row; nothing is shuffled.
    """
    unified = F.concat(F.lit("\n"), F.regexp_replace(text, LINE_BREAK, "\n"))
    blocks = F.regexp_extract_all(unified, F.lit(TABLE_BLOCK), F.lit(0))

    def rows(block: Column) -> Column:
        lines = F.split(F.substring(block, 2, 2147483647), "\n")
        return F.filter(F.transform(lines, _cells), lambda r: ~_is_rule(r))

    return F.filter(F.transform(blocks, rows), lambda t: F.size(t) >= 2)


def markdown_fragments(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Every markdown table in a text as one fragment; all other columns stay."""
    others = [c for c in texts.columns if c != text_col]
    holding = texts.where(F.contains(F.col(text_col), F.lit("|")))
    return holding.select(*others, F.posexplode(tables_in(F.col(text_col))).alias("index_on_page", "rows"))
