"""Records of delimited files whose quoted fields run over lines, with the files split.

Where a split of a file begins, nothing tells whether a quoted field is open.
But a piece of text of whole lines acts on that state in one of three ways,
whatever the state is: it leaves it, turns it over, or sets it. So splits are
cut into pieces of some lines each, and each piece is matched twice, once from
either state. What the pieces of a split do is put together within the split,
and a second step over one row per split tells each its state. Then a piece
gives out its whole records at once. Only records that run over the end of a
piece are gathered, from at most two parts of each piece; such a record may run
over any number of pieces and splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import encoding as E
from ..operators.joining import join_back
from ..operators.ordered import ROWS_PER_RANGE, carry_last
from ..plans.session import written

# Lines in a piece, and bytes that a caller who knows the length of lines should aim at.
LINES_PER_PIECE = 1024
BYTES_PER_PIECE = 65_536
# Places of records within a piece: its number, and so many bits for those inside it.
PLACE_BITS = 30
_END = r"(?:\r\n|\n|\r)"


def _in_class(sep: str) -> str:
    return "\\" + sep if sep == "|" else sep


def _field(s: str) -> str:
    """A whole field, which is quoted, not quoted or empty; ``s`` are the characters that end it."""
    return rf'(?:"(?:[^"]++|"")*+"[^{s}]*+|[^{s}"][^{s}]*+)?+'


def _record(sep: str) -> str:
    s = _in_class(sep)
    return rf"(?:{_field(s + '\r\n')}[{s}])*+{_field(s + '\r\n')}"


def runs_on(line: Column, sep: str) -> Column:
    """True when a quoted field opens in this line and does not close in it."""
    s = _in_class(sep)
    return line.rlike(rf'^(?:{_field(s)}[{s}])*+"(?:[^"]++|"")*+$')


def _open_after(text: Column, sep: str) -> Column:
    """True when a quoted field opens in this text of whole lines and does not close in it."""
    s = _in_class(sep) + "\r\n"
    return text.rlike(rf'\A(?:{_field(s)}[{s}])*+"(?:[^"]++|"")*+\z')


def _decoded(text: Column, encoding: str) -> Column:
    """Text of whole lines; a mark of byte order in front of any of them is left out."""
    if encoding != "utf-8":
        return E.decode_as(text.cast("binary"), F.lit(encoding))
    return F.when(F.contains(text, F.lit(E.BOM)), F.regexp_replace(text, rf"(?<![^\n]){E.BOM}", "")).otherwise(text)


def _pieces(spark: SparkSession, paths: list[str], encoding: str, sep: str, lines_per_piece: int) -> DataFrame:
    """``path, block, piece, text`` and whether a quoted field is open after the text, where none was open before it and where one was.

    Pieces are numbered within their split one after the other. Lines end with
    \\n, \\r\\n or \\r, the last one of a piece with \\n.
    """
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    piece = F.floor(F.col("line").bitwiseAND(F.lit((1 << 33) - 1)) / lines_per_piece)
    pieces = raw.groupBy("path", "block", piece.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("lines"))
    text = F.concat(F.array_join(F.col("lines")["value"], "\n"), F.lit("\n"))
    pieces = pieces.select("path", "block", "piece", text.alias("text")).withColumn("text", _decoded(F.col("text"), encoding))
    return pieces.withColumns({"from_closed": _open_after(F.col("text"), sep), "from_open": _open_after(F.concat(F.lit('"'), "text"), sep)})


def _split_states(pieces: DataFrame) -> DataFrame:
    """Per split its number of pieces, that of the first one, and the states before and after each, from one row per split.

    ``states`` has one entry more than there are pieces.
    """
    each = F.array_sort(F.collect_list(F.struct("piece", "from_closed", "from_open")))
    splits = pieces.groupBy("path", "block").agg(each.alias("each"), F.count(F.lit(1)).alias("pieces"))

    def states_from(start: bool) -> Column:
        after = lambda so_far, p: F.when(F.element_at(so_far, -1), p["from_open"]).otherwise(p["from_closed"])
        return F.aggregate("each", F.array(F.lit(start)), lambda so_far, p: F.concat(so_far, F.array(after(so_far, p))))

    splits = splits.withColumns({"from_closed": states_from(False), "from_open": states_from(True)})
    closed, opened = F.element_at("from_closed", -1), F.element_at("from_open", -1)
    splits = splits.withColumns({"known": F.when(closed == opened, closed), "turned": (closed & ~opened).cast("long")})
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    splits = splits.withColumns({"turns_before": F.coalesce(F.sum("turned").over(before), F.lit(0)), "turns": F.sum("turned").over(upto)})
    sets = F.when(F.col("known").isNotNull(), F.struct(F.col("known").alias("open"), "turns"))
    last = F.last(sets, ignorenulls=True).over(before)
    splits = splits.withColumn("last", F.coalesce(last, F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("turns"))))
    open_at_start = F.col("last.open") != ((F.col("turns_before") - F.col("last.turns")) % 2 == 1)
    return splits.select("path", "block", "pieces", F.col("each")[0]["piece"].alias("first_piece"),
                         F.when(open_at_start, F.col("from_open")).otherwise(F.col("from_closed")).alias("states"))


def quoted_records(
    spark: SparkSession, paths: list[str], encoding: str, sep: str, rows_per_range: int = ROWS_PER_RANGE, lines_per_piece: int = LINES_PER_PIECE
) -> DataFrame:
    """``doc_id, row_no, text``: the records of the files, without their line end, those of blanks only left out.

    Line ends inside quoted fields are kept as they are. A quoted field that is
    never closed takes the rest of its file. ``row_no`` tells the order of a
    file's records.
    """
    pieces = written(_pieces(spark, paths, encoding, sep, lines_per_piece), "quoted-pieces")
    pieces = join_back(pieces, _split_states(pieces), ["path", "block"], "pieces")
    place = (F.col("piece") - F.col("first_piece")).cast("int")
    pieces = pieces.select("path", "block", "piece", "text", F.get("states", place).alias("inside"), F.get("states", place + 1).alias("open"))
    pieces = pieces.withColumn("text", F.when(F.col("inside"), F.concat(F.lit('"'), "text")).otherwise(F.col("text")))

    def at(inner: Column) -> Column:
        return F.struct("block", (F.shiftleft("piece", PLACE_BITS) + inner).alias("line"))

    record = _record(sep)
    found = F.regexp_extract_all("text", F.lit(rf"\G({record}){_END}"), F.lit(1))
    # Of a piece that begins inside a field, the first match is the end of an earlier record.
    whole = F.slice(found, F.when(F.col("inside"), 2).otherwise(1), F.lit((1 << 31) - 1))
    whole = pieces.select("path", "block", "piece", F.posexplode(whole).alias("inner", "value")).select(
        F.col("path").alias("doc_id"), at(F.col("inner") + 1).alias("row_no"), "value")

    cut = pieces.where("inside OR open").withColumn("head", F.regexp_extract("text", rf"\A({record}){_END}", 1))
    ends = F.col("head") != ""
    tail = F.regexp_extract("text", rf"\A(?:{record}{_END})*+([\s\S]*+)\z", 1)
    first, last = at(F.lit(0)), at(F.lit((1 << PLACE_BITS) - 1))
    no_start = F.lit(None).cast("struct<block:bigint,line:bigint>")
    head = F.struct(first.alias("place"), F.substr(F.when(ends, F.col("head")).otherwise(F.col("text")), F.lit(2)).alias("value"), no_start.alias("start"))
    begun = F.struct(last.alias("place"), tail.alias("value"), last.alias("start"))
    parts = F.array_compact(F.array(F.when(F.col("inside"), head), F.when(F.col("open") & (~F.col("inside") | ends), begun)))
    parts = written(cut.select("path", F.inline(parts)), "quoted-parts")
    parts = carry_last(parts, ["path"], ["place"], "start", "record", rows_per_range)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda p: p["value"])
    long = parts.groupBy("path", "record").agg(F.array_join(in_order, "").alias("value"))
    long = long.select(F.col("path").alias("doc_id"), F.col("record").alias("row_no"), F.regexp_replace("value", r"(\r?\n|\r)\z", "").alias("value"))
    records = whole.unionByName(long)
    return records.select("doc_id", "row_no", F.col("value").alias("text")).where(F.col("text").rlike(r"\S"))
