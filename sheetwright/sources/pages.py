"""Pages of PDF files: how each page is read, and the text blocks kept from it.

Input: ``page_facts(doc_id, page_no, n_text_chars, n_chars, width, height,
images, n_vector, n_tables)``; ``n_text_chars`` counts trimmed text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .routing import route_files

from ..functions.text import strip
from ..operators.ordered import numbered

MIN_TEXT = 40
MIN_IMAGE_SHARE = 0.3
MIN_VECTORS = 50


def image_share(images: Column, width: Column, height: Column) -> Column:
    """Share of the page area that images cover."""
    zero = F.lit(0.0)
    area = F.aggregate(
        images,
        zero,
        lambda total, i: total
        + F.greatest(zero, i["x1"] - i["x0"]) * F.greatest(zero, i["bottom"] - i["top"]),
    )
    page = width * height
    return F.coalesce(area, zero) / F.when(page == 0, F.lit(1.0)).otherwise(page)


def is_scan(facts: DataFrame) -> Column:
    covered = image_share(facts["images"], facts["width"], facts["height"]) >= MIN_IMAGE_SHARE
    drawn = (facts["n_chars"] == 0) & (facts["n_vector"] >= MIN_VECTORS)
    return (facts["n_text_chars"] < MIN_TEXT) & (covered | drawn)


def page_routes(facts: DataFrame) -> DataFrame:
    """Add ``route``: table, scan, text, or none for a page without content.
    A page with a table is never a scan, however little text it has."""
    return facts.withColumn(
        "route",
        F.when(F.col("n_tables") > 0, F.lit("table"))
        .when(is_scan(facts), F.lit("scan"))
        .when(F.col("n_text_chars") > 0, F.lit("text"))
        .otherwise(F.lit("none")),
    )


def block_text(route: Column, page_no: Column, text: Column) -> Column:
    """Text block of one page, or null when the page gives none."""
    page = page_no.cast("string")
    outside = strip(text)
    return (
        F.when(
            route == "scan",
            F.concat(F.lit("[page "), page, F.lit(", read by vision model]\n"), F.coalesce(text, F.lit(""))),
        )
        .when((route == "table") & (outside != ""), F.concat(F.lit("[page "), page, F.lit("]\n"), outside))
        .when((route == "text") & (outside != ""), F.concat(F.lit("[page "), page, F.lit("]\n"), text))
        .when(route == "image", text)
    )


def text_blocks(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page_no, route, text)`` to numbered text blocks.

    ``text`` is what stands outside tables, the transcript of a scan, or the
    page's text, by route; route ``image`` keeps a transcript without prefix.
    """
    blocks = pages.select(
        "doc_id", "page_no", block_text(F.col("route"), F.col("page_no"), F.col("text")).alias("content")
    ).where(F.col("content").isNotNull())
    places = numbered(blocks.select("doc_id", "page_no"), ["doc_id"], ["page_no"], "place")
    return blocks.join(places, ["doc_id", "page_no"]).select(
        "doc_id", (F.col("place") - 1).cast("int").alias("block_index"), "content"
    )


def doc_meta(routes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Pages, transcribed pages, source kind and table count per document."""
    meta = routes.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.count(F.when(F.col("route") == "scan", F.lit(1))).alias("vision_pages"),
    ).withColumn(
        "source_type", F.when(F.col("vision_pages") > 0, F.lit("pdf_scanned")).otherwise(F.lit("pdf_text"))
    )
    if tables is None:
        return meta
    counts = tables.groupBy("doc_id").agg(F.count_distinct("table_name").alias("n_tables"))
    return meta.join(counts, "doc_id", "left").na.fill(0, ["n_tables"])


def document_facts(files: DataFrame, paged: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row per file with its name, kind and counts; a count that its kind does not have is null.

    ``files(doc_id, path)``; ``paged`` as ``doc_meta`` gives it, for documents
    of pages; ``sheets(doc_id, sheet_count)`` for workbooks. A picture is one
    transcribed page.
    """
    found = route_files(files).join(paged.select("doc_id", "page_count", F.col("vision_pages").alias("scans"), F.col("source_type").alias("paged_as")), "doc_id", "left")
    found = found.join(sheets.select("doc_id", F.col("sheet_count").alias("sheets")), "doc_id", "left")
    kind = F.col("route")
    return found.select(
        "doc_id",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.when(kind == "pdf", F.coalesce("paged_as", F.lit("pdf_text"))).otherwise(kind).alias("source_type"),
        F.when(kind == "pdf", F.coalesce("page_count", F.lit(0))).alias("page_count"),
        F.when(kind == "image", F.lit(1)).when(kind == "pdf", F.coalesce("scans", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("vision_pages"),
        F.when(kind == "spreadsheet", F.coalesce("sheets", F.lit(0))).when(kind == "csv", F.lit(1)).cast("long").alias("sheet_count"),
    )
