"""Whole ways from extracted input to typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.headers import sheet_table_names
from ..operators.clean import drop_empty_rows, normalize_rows
from ..operators.fragments import all_fragments, merge_page_tables
from ..operators.joining import join_back
from ..operators.profile import as_text
from .session import written
from ..sources.csvtables import read_csv_rows
from ..sources.markdown import markdown_fragments
from ..sources.pages import page_routes, text_blocks


def ingest_csv(
    spark: SparkSession, paths: list[str], identifier_mode: str = "all_values"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delimited files to (typed rows, headers, column decisions)."""
    rows, headers = read_csv_rows(spark, paths)
    typed, decisions = normalize_rows(rows, identifier_mode)
    return typed, headers, decisions


def ingest_pages(
    facts: DataFrame, ruled: DataFrame, page_text: DataFrame, identifier_mode: str = "all_values"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages to (typed rows, headers, column decisions, text blocks).

    ``ruled`` holds the pieces found on pages with tables, ``page_text(doc_id,
    page_no, text)`` the text outside tables, the transcript of a scan, or the
    text of the page. Only transcripts of scans are searched for markdown.
    """
    routed = page_routes(facts).select("doc_id", "page_no", "route")
    paged = page_text.join(routed, ["doc_id", "page_no"])
    on_tables = ruled.join(routed.where(F.col("route") == "table"), ["doc_id", "page_no"], "left_semi")
    transcripts = paged.where(F.col("route") == "scan").select("doc_id", "page_no", "text")
    pieces = all_fragments(
        on_tables.select("doc_id", "page_no", "index_on_page", "rows"),
        markdown_fragments(transcripts).select("doc_id", "page_no", "index_on_page", "rows"),
    )
    rows, headers = merge_page_tables(pieces)
    typed, decisions = normalize_rows(written(rows, "page-rows"), identifier_mode)
    return typed, headers, decisions, text_blocks(paged)


def ingest_images(transcripts: DataFrame, identifier_mode: str = "all_values") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Transcripts of pictures, ``(doc_id, text)``, to the same four results."""
    paged = transcripts.select("doc_id", F.lit(1).alias("page_no"), F.lit("image").alias("route"), "text")
    pieces = markdown_fragments(paged.select("doc_id", "page_no", "text"))
    rows, headers = merge_page_tables(pieces)
    typed, decisions = normalize_rows(written(rows, "page-rows"), identifier_mode)
    return typed, headers, decisions, text_blocks(paged)


def ingest_sheets(
    sheets: DataFrame, identifier_mode: str = "all_values"
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Extracted workbook cells to (typed rows, headers, column decisions, metadata).

    ``sheets(doc_id, sheet_no, sheet, row_no, cells)`` has a row for every row
    of every sheet, cells typed as the workbook has them (``profile.CELL``). A
    sheet's first row that is not empty is its header. Sheets become tables
    with safe names of their own, in the order of the workbook; one without a
    value below its header is dropped. Columns without any value stay null.
    ``metadata(doc_id, sheet_count)`` has every workbook, also one whose sheets
    are all empty.
    """
    key = ["doc_id", "sheet_no"]
    filled = drop_empty_rows(sheets.withColumn("table_name", F.col("sheet_no").cast("string")).drop("sheet"))
    firsts = filled.groupBy(*key).agg(F.min_by("cells", "row_no").alias("first"), F.min("row_no").alias("header_row"), F.count("*").alias("n_rows"))
    # A workbook's names depend on each other; a row of them per workbook.
    named = sheets.select(*key, "sheet").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sheet_no", "sheet"))).alias("s"))
    names = named.select("doc_id", F.explode(F.arrays_zip(
        F.transform("s", lambda x: x["sheet_no"]).alias("sheet_no"), sheet_table_names(F.transform("s", lambda x: x["sheet"])).alias("name"))).alias("x"))
    tables = written(firsts.where("n_rows > 1").join(names.select("doc_id", "x.*"), key), "sheet-tables")
    below = join_back(filled.drop("table_name"), tables.select(*key, "name", "header_row", "n_rows"), key, "n_rows")
    rows = below.where(F.col("row_no") > F.col("header_row")).select("doc_id", F.col("name").alias("table_name"), "row_no", "cells")
    shown = lambda c: F.coalesce(as_text(c["text"], c["num"], c["ts"], c["flag"]), F.lit(""))
    headers = tables.select("doc_id", F.col("name").alias("table_name"), F.transform("first", shown).alias("header"))
    typed, decisions = normalize_rows(rows, identifier_mode)
    counts = tables.groupBy("doc_id").agg(F.count("*").alias("sheet_count"))
    meta = sheets.select("doc_id").distinct().join(counts, "doc_id", "left").na.fill(0, ["sheet_count"])
    return typed, headers, decisions, meta
