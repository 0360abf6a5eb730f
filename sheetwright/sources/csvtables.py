"""Separator-delimited files of mixed encodings, separators and headers.

Files are looked at once, line by line and split across tasks, to find each
file's encoding, separator and width. Then every group of like files is read by
Spark's own CSV reader, all columns as text. Widths are grouped by powers of
two, so a wide file does not widen the records of a narrow one. A file of any
size is split; where quoted fields run over several lines, its records are put
together first (``quoted``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import encoding as E
from ..functions.headers import unique_names
from ..functions.text import is_filled
from ..operators.joining import join_back
from ..plans.session import written
from .quoted import BYTES_PER_PIECE, quoted_records, runs_on

# Separators in order of preference when equally frequent.
SEPARATORS = (";", "\t", ",", "|")
# Words that stand for "no value" in a delimited file.
NO_VALUE = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def plain_path(path: str) -> str:
    """A file's path as Spark's readers take it: characters that stand for other names stand for themselves."""
    return re.sub(r"[][{}*?\\]", r"\\\g<0>", path)


def count_between_fields(line: Column, sep: str) -> Column:
    """Number of separators of a line that are not inside a quoted field; one that is never closed ends with the line."""
    s = "\\" + sep if sep == "|" else sep
    bare = F.regexp_replace(line, rf'"(?<![^{s}]")(?:[^"]++|"")*+(?:"|\z)', "")
    quoted = F.contains(line, F.lit(sep)) & F.contains(line, F.lit('"'))
    return F.when(quoted, count_of(bare, sep)).otherwise(count_of(line, sep))


def guess_separator(line: Column) -> Column:
    """Most frequent separator of a line; the first listed wins a tie."""
    counts = F.array(*[
        F.struct(count_of(line, s).alias("n"), F.lit(-i).alias("place"), F.lit(s).alias("sep"))
        for i, s in enumerate(SEPARATORS)
    ])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["sep"]).otherwise(F.lit(","))


def first_filled_line(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^.*\S.*$", 0)


def sniff(lines: DataFrame) -> DataFrame:
    """One row per file from ``lines(path, block, line, value)`` of raw text.

    Every figure is combined on the map side, so one huge file is no burden.
    ``most`` is over lines without a quote; ``quoted`` tells whether there are
    others. The set it is taken from also makes Spark choose a hash
    aggregation; the first line alone would make it sort all lines.
    """
    value, raw = F.col("value"), F.col("value").cast("binary")
    place = F.struct("block", "line")
    utf8, quoted = E.is_utf8(raw), F.contains(value, F.lit('"'))
    ascii_only = utf8 & (F.octet_length(value) == F.char_length(value))
    facts = lines.groupBy("path").agg(
        F.bool_and(utf8).alias("utf8"),
        F.bool_or(F.when(ascii_only, F.lit(False)).otherwise(E.has_gap_bytes(raw))).alias("gaps"),
        F.min_by(raw, F.when(is_filled(value), place)).alias("first_raw"),
        *[F.max(F.when(~quoted, count_of(value, s))).alias(f"most_{i}") for i, s in enumerate(SEPARATORS)],
        F.collect_set(F.when(quoted, F.lit(True))).alias("quoted"),
        (F.sum(F.octet_length(value)) / F.count(F.lit(1))).alias("line_bytes"),
    )
    facts = facts.where(F.col("first_raw").isNotNull()).withColumn(
        "encoding", E.encoding_of(F.col("utf8"), F.col("gaps"))
    )
    facts = facts.withColumn("first_line", E.decode_as(F.col("first_raw"), F.col("encoding")))
    facts = facts.withColumn("separator", guess_separator(F.col("first_line")))
    most = F.element_at(F.array(*[f"most_{i}" for i in range(len(SEPARATORS))]), F.array_position(F.array(*map(F.lit, SEPARATORS)), F.col("separator")).cast("int"))
    return facts.select(
        "path", "encoding", "separator", "first_line", most.alias("most"), (F.size("quoted") > 0).alias("quoted"), "line_bytes"
    )


def with_quoted_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``width`` and ``multi_line`` to what ``sniff`` tells of files.

    Lines with quotes are matched here, under the separator of their file only.
    """
    quoted = files.where("quoted").select("path", "separator", F.lit(1).alias("files"))
    if quoted.isEmpty():
        return files.withColumn("width", (F.col("most") + 1).cast("int")).withColumn("multi_line", F.lit(False))
    value = F.col("value")

    def for_separator(of: Callable[[str], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("separator") == s, of(s)) for s in SEPARATORS])

    marked = join_back(lines.where(F.contains(value, F.lit('"'))).select("path", "value"), quoted, ["path"], "files")
    found = marked.groupBy("path").agg(
        F.max(for_separator(lambda s: count_between_fields(value, s))).alias("most_quoted"),
        F.bool_or(for_separator(lambda s: runs_on(value, s))).alias("runs_on"),
    )
    return files.join(found, "path", "left").select(
        *files.columns, (F.greatest("most", "most_quoted") + 1).cast("int").alias("width"), F.coalesce("runs_on", F.lit(False)).alias("multi_line")
    )


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw lines with the file, the split they are from, and their order in it."""
    return (
        spark.read.text(paths)
        .withColumn("path", F.col("_metadata.file_path"))
        .withColumn("block", F.col("_metadata.file_block_start"))
        .withColumn("line", F.monotonically_increasing_id())
    )


def _options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}


def _max_columns(width: int) -> dict[str, str]:
    """The parser keeps room for so many fields; twice a file's width and more."""
    return {"maxColumns": str(max(20_480, 2 * width))}


def _schema(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def _cell(c: Column, cp1252: bool) -> Column:
    text = F.translate(c, E.CP1252_BYTES, E.CP1252_GLYPHS) if cp1252 else c
    return F.when(~text.isin(*NO_VALUE), text)


def _cells(width: int, cp1252: bool) -> Column:
    return F.array(*[_cell(F.col(f"c{i}"), cp1252) for i in range(width)])


def _charset(encoding: str) -> str:
    """Spark reads no Windows-1252: such bytes come as Latin-1 and are translated."""
    return "UTF-8" if encoding == "utf-8" else "ISO-8859-1"


def _read_group(
    spark: SparkSession, paths: list[str], encoding: str, sep: str, width: int
) -> DataFrame:
    """Records of like files, one in each line; the first of each file is left out as its header."""
    return (
        spark.read.options(**_options(sep), **_max_columns(width))
        .option("header", True)
        .option("enforceSchema", True)
        .option("encoding", _charset(encoding))
        .schema(_schema(width))
        .csv(paths)
        .select(
            F.col("_metadata.file_path").alias("doc_id"),
            F.lit("data").alias("table_name"),
            F.struct(
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("row_no"),
            _cells(width, encoding == "cp1252").alias("cells"),
        )
    )


def _read_quoted(spark: SparkSession, paths: list[str], encoding: str, sep: str, lines_per_piece: int) -> tuple[DataFrame, DataFrame]:
    """Rows and headers of like files with quoted fields over several lines."""
    records = written(quoted_records(spark, paths, encoding, sep, lines_per_piece=lines_per_piece), "quoted-records")
    widths = records.groupBy("doc_id").agg((F.max(count_between_fields(F.col("text"), sep)) + 1).alias("width"), F.min("row_no.block").alias("block"))
    widths = written(widths, "quoted-widths")
    width = widths.agg(F.max("width")).first()[0] or 1
    fields = F.from_csv("text", F.lit(_schema(width)), {**_options(sep), **_max_columns(width)})
    cells = F.array(*[_cell(fields[f"c{i}"], False) for i in range(width)])

    def parsed(some: DataFrame, wanted: Column | None = None) -> DataFrame:
        kept = cells if wanted is None else F.when(wanted, cells)
        return some.select("doc_id", F.lit("data").alias("table_name"), "row_no", kept.alias("cells"))

    # A file's first filled record is in its first split with a record, or else anywhere. Fields of
    # other splits are not parsed: a filter on them would be taken before the join, this is not.
    begins = parsed(records.join(widths, "doc_id"), F.col("row_no.block") == F.col("block"))
    heads = written(_first_records(begins), "quoted-heads")
    others = widths.join(heads, "doc_id", "left_anti")
    if not others.isEmpty():
        more = _first_records(parsed(records.join(others, "doc_id", "left_semi")))
        heads = written(heads.unionByName(more), "quoted-heads")
    headers = heads.join(widths, "doc_id").select("doc_id", "table_name", F.slice("header", F.lit(1), F.col("width")).alias("header"))
    return _after_header(parsed(records), heads), headers


def _first_records(records: DataFrame) -> DataFrame:
    """The first filled record of each file and its place; the set makes Spark choose a hash aggregation (see ``sniff``)."""
    filled = records.where(F.exists("cells", is_filled))
    first = [F.min_by("cells", "row_no").alias("header"), F.min("row_no").alias("header_row"), F.collect_set(F.lit(True)).alias("some")]
    return filled.groupBy("doc_id", "table_name").agg(*first).where(F.size("some") > 0).drop("some")


def _after_header(records: DataFrame, heads: DataFrame) -> DataFrame:
    """Records below the first filled one of their file, where lines before it are blank."""
    below = records.join(heads.select("doc_id", "header_row"), "doc_id")
    return below.where(F.col("row_no") > F.col("header_row")).drop("header_row")


def _headers(files: DataFrame, classes: set[tuple[str, int]]) -> list[DataFrame]:
    """Header cells of each file whose records are one line each; a missing one is null."""
    parts = []
    for sep, width in sorted(classes):
        parsed = F.from_csv("first_line", F.lit(_schema(width)), {**_options(sep), **_max_columns(width)})
        header = F.array(*[parsed[f"c{i}"] for i in range(width)])
        parts.append(
            files.where((F.col("separator") == sep) & (F.col("width_class") == width) & ~F.col("multi_line")).select(
                F.col("path").alias("doc_id"),
                F.lit("data").alias("table_name"),
                F.slice(header, F.lit(1), F.col("width")).alias("header"),
            )
        )
    return parts


def read_csv_rows(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """All delimited files under ``paths``: (rows, headers), keyed by file.

    ``rows(doc_id, table_name, row_no, cells)`` has every record after the
    header; a record may be longer than the header, its extra cells are kept.
    Only one short row per file, which the driver lists anyway, comes back to
    it to group like files: at most 3 encodings x 4 separators x 2 kinds of records x the
    powers of two up to the widest file.
    """
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("width").cast("double")))).cast("int")
    lines = read_lines(spark, paths)
    files = with_quoted_lines(written(sniff(lines), "csv-sniffed"), lines)
    files = written(files.withColumn("width_class", power), "csv-files")
    kind = ["encoding", "separator", "multi_line", "width_class"]
    listed = files.select("path", "line_bytes", *kind)
    groups: dict[tuple, list] = {}
    for r in listed.toLocalIterator():
        groups.setdefault(tuple(r[k] for k in kind), []).append(r)
    if not groups:
        empty = spark.createDataFrame(
            [], "doc_id string, table_name string, row_no struct<block:bigint,line:bigint>, cells array<string>"
        )
        return empty, spark.createDataFrame([], "doc_id string, table_name string, header array<string>")

    rows, more_headers = [], []
    for (encoding, sep, multi, width), members in groups.items():
        names = [plain_path(unquote(m.path)) for m in members]
        if not multi:
            rows.append(_read_group(spark, names, encoding, sep, width))
            continue
        longest = max(m.line_bytes for m in members)
        table_rows, heads = _read_quoted(spark, names, encoding, sep, max(1, int(BYTES_PER_PIECE / (longest + 1))))
        rows.append(table_rows)
        more_headers.append(heads)
    headers = [*_headers(files, {(sep, width) for _, sep, multi, width in groups if not multi}), *more_headers]
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, headers)


def read_csv_table(spark: SparkSession, paths: list[str], sep: str, encoding: str = "utf-8") -> DataFrame:
    """One table of like files with ordinary, still textual columns, named by their header row.

    Blank and repeated names become distinct ones; files without a record give no column.
    """
    read = spark.read.options(**_options(sep), **_max_columns(0)).option("encoding", _charset(encoding))
    df, first = read.option("header", True).csv(paths), read.option("header", False).csv(paths).first()
    if first is None:
        return df
    glyphs = str.maketrans(E.CP1252_BYTES, E.CP1252_GLYPHS) if encoding == "cp1252" else {}
    found = F.array(*[F.lit(c and c.translate(glyphs)).cast("string") for c in first])
    names = spark.range(1).select(unique_names(found)).first()[0]
    places = [f"c{i}" for i in range(len(names))]
    return df.toDF(*places).select(*[_cell(F.col(c), encoding == "cp1252").alias(n) for c, n in zip(places, names)])
