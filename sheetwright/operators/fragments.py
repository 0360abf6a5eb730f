"""Tables that run over several pages.

Input: ``fragments(doc_id, page_no, index_on_page, rows)``, one row per table
piece on a page, ``rows`` being an array of string arrays.

A piece continues the one before it when it is the first on its page, that one
stood on the page before, and both are equally wide; unless its first row looks
like a header other than the current one. Instead of walking through a document
piece by piece, each page is reduced to its first and last piece, and the header
and the start of the current table are *carried values*: the last one set before
each page. Pages are cut into ranges, so the windows also stay small for a
document that makes up much of the data; between ranges only one row per range
is carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.headers import fit_width, looks_like_header
from ..functions.text import squeeze
from ..plans.session import written
from .joining import join_back
from .ordered import numbered, running_sum

PAGES_PER_RANGE = 256
PIECE = ["doc_id", "page_no", "index_on_page"]
TABLE_START = ["doc_id", "start_page", "start_index"]


def all_fragments(ruled: DataFrame, transcribed: DataFrame) -> DataFrame:
    """Pieces found in ruled tables and in page transcripts together."""
    return ruled.unionByName(transcribed)


HEAD = ["first_row", "is_header", "width", "n_rows", "has_value"]


def _clean_pieces(fragments: DataFrame) -> DataFrame:
    """Pieces with squeezed cells and without blank rows, and what the joining rule needs to know of each.

    Written, so that cells are cleaned once: the rule reads only the columns
    ``HEAD``, the rows are read when they are matched to their tables. Pieces
    without any text disappear on reading; a filter on what is computed here
    would be moved before it and compute it once more.
    """
    cells = F.transform("rows", lambda r: F.transform(r, squeeze))
    pieces = fragments.select(*PIECE, F.filter(cells, lambda r: F.exists(r, lambda c: c != "")).alias("rows"))
    pieces = pieces.withColumn("first_row", F.get("rows", F.lit(0)))
    pieces = pieces.withColumn("is_header", looks_like_header(F.col("first_row")))
    pieces = pieces.withColumn("n_rows", F.size("rows") - F.col("is_header").cast("int"))
    body = F.when(F.col("is_header"), F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows"))
    width = F.size("first_row")
    pieces = pieces.withColumns({
        "width": width,
        "has_value": F.exists(body, lambda r: F.exists(F.slice(r, F.lit(1), width), lambda c: c != "")),
    })
    return written(pieces.select(*PIECE, *HEAD, "rows"), "page-pieces").where(F.size("rows") > 0)


def _page_ends(heads: DataFrame) -> DataFrame:
    """One row per page: its piece 0 (``front``, if any) and its last piece.

    Only a front can continue a table, and only the last piece of the page
    before it can be continued, so a page of any number of pieces is one row.
    """
    index = F.col("index_on_page")
    front = F.struct("width", "is_header", "first_row", "n_rows", "has_value")
    end = F.struct("index_on_page", "width", "is_header", "first_row")
    return heads.groupBy("doc_id", "page_no").agg(
        F.max_by(front, F.when(index == 0, F.lit(0))).alias("front"), F.max_by(end, index).alias("end")
    )


def _label_fronts(pages: DataFrame, pages_per_range: int) -> DataFrame:
    """Where the table of each page's front starts, and whether that is here."""
    own_range = F.floor(F.col("page_no") / pages_per_range)
    ranged = pages.withColumn("page_range", own_range)

    # The last page of a range is also shown to the next range, so that the
    # first page there can see its predecessor.
    both = F.array(F.col("page_range"), F.col("page_range") + 1)
    is_last_page = F.col("page_no") % pages_per_range == pages_per_range - 1
    shown = ranged.withColumn(
        "seen_in", F.explode(F.when(is_last_page, both).otherwise(F.array("page_range")))
    )

    here = Window.partitionBy("doc_id", "seen_in").orderBy("page_no")
    upto_before = here.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("page_no").over(here)
    related = (F.col("page_no") == before + 1) & (F.col("front.width") == F.lag("end.width").over(here))
    ends_apart = F.col("end.index_on_page") != 0
    first_row, is_header = F.col("front.first_row"), F.col("front.is_header")

    def header_of(piece: str) -> Column:
        names = F.when(F.col(f"{piece}.is_header"), F.col(f"{piece}.first_row"))
        return F.struct(names.alias("names"))

    # The header a page leaves behind for the next one: that of its last table,
    # "none" if that has none, and null if the page only goes on with a table.
    leaves = (
        F.when(ends_apart, header_of("end"))
        .when(is_header | ~F.col("related"), header_of("front"))
    )
    other_header = is_header & F.col("known").isNotNull() & ~F.col("known.names").eqNullSafe(first_row)
    seen = (
        shown.withColumn("related", F.coalesce(related, F.lit(False)))
        .where(F.col("seen_in") == F.col("page_range"))
        .withColumn("leaves", leaves)
        .withColumn("known", F.last("leaves", ignorenulls=True).over(upto_before))
        .withColumn("starts", F.coalesce(F.col("front").isNotNull() & (~F.col("related") | other_header), F.lit(False)))
        # Only the first header in a range can depend on earlier ranges.
        .withColumn("open", F.coalesce(is_header & F.col("related") & F.col("known").isNull(), F.lit(False)))
    )

    # The last table start on a page, apart from a start that is still open.
    def start_on_page(front_starts: Column) -> Column:
        index = F.when(ends_apart, F.col("end.index_on_page")).when(front_starts, F.lit(0))
        return F.when(index.isNotNull(), F.struct("page_no", index.cast("int").alias("index_on_page")))

    front_place = F.struct("page_no", F.lit(0).alias("index_on_page"))
    ranges = seen.groupBy("doc_id", "seen_in").agg(
        F.max_by("leaves", F.when(F.col("leaves").isNotNull(), F.col("page_no"))).alias("last_leaves"),
        F.max(start_on_page(F.col("starts"))).alias("last_start"),
        F.max(F.when(F.col("open"), front_place)).alias("open_place"),
        F.max(F.when(F.col("open"), first_row)).alias("open_row"),
    )
    earlier = Window.partitionBy("doc_id").orderBy("seen_in").rowsBetween(Window.unboundedPreceding, -1)
    open_starts = F.col("open_place").isNotNull() & ~F.col("from_leaves.names").eqNullSafe(F.col("open_row"))
    carried = (
        ranges.withColumn("from_leaves", F.last("last_leaves", ignorenulls=True).over(earlier))
        .withColumn("open_starts", F.coalesce(open_starts, F.lit(False)))
        .withColumn("range_start", F.greatest("last_start", F.when(F.col("open_starts"), F.col("open_place"))))
        .withColumn("from_start", F.last("range_start", ignorenulls=True).over(earlier))
        .select("doc_id", "seen_in", "from_start", "open_starts")
    )

    starts = F.col("starts") | (F.col("open") & F.col("open_starts"))
    last_before = F.last("start_on_page", ignorenulls=True).over(upto_before)
    return (
        seen.join(carried, ["doc_id", "seen_in"])
        .withColumn("starts", starts)
        .withColumn("start_on_page", start_on_page(F.col("starts")))
        .withColumn("start", F.when(F.col("starts"), front_place).otherwise(F.coalesce(last_before, F.col("from_start"))))
        .where(F.col("front").isNotNull())
    )


def label_fragments(fragments: DataFrame, pages_per_range: int = PAGES_PER_RANGE) -> DataFrame:
    """Labels (``_label_pieces``) of pieces as they were found."""
    return _label_pieces(_clean_pieces(fragments), pages_per_range)


def _label_pieces(pieces: DataFrame, pages_per_range: int) -> DataFrame:
    """For each piece the place where its table starts and, at that place, the header.

    Output: doc_id, page_no, index_on_page, start_page, start_index, header,
    is_header (its first row is one), width, n_rows (without a header row),
    has_value. Only these few values per piece are shuffled, never its rows.
    """
    heads = pieces.select(*PIECE, *HEAD)
    pages = written(_page_ends(heads), "page-ends")
    fronts = _label_fronts(pages, pages_per_range).select(
        "doc_id", "page_no", F.lit(0).alias("index_on_page"), "front.*", "start.*", "starts"
    )
    # ``start.*`` repeats two names; they are told apart by position.
    fronts = fronts.toDF(
        *PIECE, "width", "is_header", "first_row", "n_rows", "has_value", "start_page", "start_index", "starts"
    )
    others = heads.where(F.col("index_on_page") != 0).select(
        "*", F.col("page_no").alias("start_page"), F.col("index_on_page").alias("start_index"), F.lit(True).alias("starts")
    )
    names = F.when(F.col("is_header"), F.col("first_row")).otherwise(F.array_repeat(F.lit(""), F.col("width")))
    return fronts.unionByName(others).select(
        *PIECE, "start_page", "start_index", F.when(F.col("starts"), names).alias("header"),
        "is_header", "width", "n_rows", "has_value",
    )


def named_tables(labels: DataFrame) -> DataFrame:
    """Tables that have at least one value, as table1, table2 … per document.

    Output: doc_id, start_page, start_index, header, table_name, n_pieces.
    """
    tables = (
        labels.groupBy(*TABLE_START)
        .agg(
            F.max("has_value").alias("has_value"),
            F.max("header").alias("header"),
            F.count("*").alias("n_pieces"),
        )
        .where("has_value")
        .drop("has_value")
    )
    # Page and piece as one number that rises with them, so that the tables of
    # one page can be spread as well.
    piece = F.least(F.col("start_index").cast("bigint"), F.lit((1 << 20) - 1))
    placed = tables.withColumn("place", F.col("start_page").cast("bigint") * (1 << 20) + piece)
    counted = numbered(placed, ["doc_id"], ["place", "start_page", "start_index"], "number").drop("place")
    return counted.withColumn("table_name", F.concat(F.lit("table"), F.col("number").cast("string"))).drop("number")


def merge_page_tables(
    fragments: DataFrame, pages_per_range: int = PAGES_PER_RANGE
) -> tuple[DataFrame, DataFrame]:
    """Join tables over pages; returns (rows, headers).

    ``rows(doc_id, table_name, row_no, source_page, cells)``: one per body row,
    numbered from 0 in each table. ``headers(doc_id, table_name, header)``.
    The labels are settled first and written; the rows themselves are then
    matched to them by place, which is unique, and exploded.
    """
    pieces = _clean_pieces(fragments)
    labels = written(_label_pieces(pieces, pages_per_range), "page-labels")
    tables = written(named_tables(labels), "page-tables")
    placed = running_sum(
        labels.drop("header", "has_value"), TABLE_START, ["page_no", "index_on_page"], "n_rows", "rows_upto"
    )
    names = tables.select(*TABLE_START, "table_name", "n_pieces")
    named = join_back(placed, names, TABLE_START, "n_pieces").where(
        F.col("table_name").isNotNull() & (F.col("n_rows") > 0)
    )
    targets = written(
        named.select(*PIECE, "table_name", "is_header", "width", (F.col("rows_upto") - F.col("n_rows")).alias("offset")),
        "page-targets",
    )
    body = F.when(F.col("is_header"), F.slice("rows", F.lit(2), F.size("rows"))).otherwise(F.col("rows"))
    rows = (
        pieces.select(*PIECE, "rows")
        .join(targets, PIECE)
        .select(
            "doc_id", "table_name", "offset", "width", F.col("page_no").cast("int").alias("source_page"),
            F.posexplode(body).alias("place", "row"),
        )
        .select(
            "doc_id",
            "table_name",
            (F.col("offset") + F.col("place")).alias("row_no"),
            "source_page",
            fit_width(F.col("row"), F.col("width")).alias("cells"),
        )
    )
    return rows, tables.select("doc_id", "table_name", "header")
