"""Per-column facts and the decisions drawn from them.

Rows of many tables travel together as
``rows(doc_id, table_name, row_no, source_page, cells)`` where ``cells`` is an
array of strings, or of ``struct<text,num,ts,flag>`` for typed workbook cells.
All facts about a column come from one aggregation over its exploded cells,
which Spark combines on the map side, so a column holding most of the data
costs no more to finish than a small one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import numbers as N
from ..functions.headers import unique_names
from ..functions.text import blank_to_null, is_filled, strip
from ..plans.session import written
from .joining import join_back

TABLE_KEY = ["doc_id", "table_name"]
COLUMN_KEY = [*TABLE_KEY, "col_no"]

CONVERT_SHARE = 0.9
ZERO_SHARE = 0.3
LONG_SHARE = 0.7
LONG_LENGTH = 8
UNIQUE_SHARE = 0.95

CELL = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("num", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("flag", T.BooleanType()),
])


def typed_cell(
    text: Column | None = None, num: Column | None = None, ts: Column | None = None, flag: Column | None = None
) -> Column:
    """One workbook cell; at most one of the four is not null."""
    given = {"text": text, "num": num, "ts": ts, "flag": flag}
    return F.struct(*[
        (F.lit(None) if given[f.name] is None else given[f.name]).cast(f.dataType).alias(f.name)
        for f in CELL.fields
    ])


def cells_are_typed(rows: DataFrame) -> bool:
    return isinstance(rows.schema["cells"].dataType.elementType, T.StructType)


def exploded(rows: DataFrame, *extra: str) -> DataFrame:
    """One row per filled cell: keys, ``col_no`` from 0, text, num, ts, flag."""
    keep = [*TABLE_KEY, *extra]
    if cells_are_typed(rows):
        return (
            rows.select(*keep, F.posexplode_outer("cells").alias("col_no", "cell"))
            .select(
                *keep, "col_no", blank_to_null(F.col("cell.text")).alias("text"), "cell.num", "cell.ts", "cell.flag"
            )
            .where("text is not null or num is not null or ts is not null or flag is not null")
        )
    return (
        rows.select(*keep, F.posexplode_outer("cells").alias("col_no", "text"))
        .where(is_filled(F.col("text")))
        .select(
            *keep, "col_no", "text",
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in CELL.fields[1:]],
        )
    )


def _plain(num: Column) -> Column:
    short = num.cast("string")
    digits = F.when(F.abs(num) < 1, num.try_cast("decimal(38,34)")).otherwise(num.try_cast("decimal(38,8)")).cast("string")
    return F.when(short.contains("E"), F.coalesce(F.regexp_replace(digits, r"\.?0+$", ""), short)).otherwise(short)


def as_text(text: Column, num: Column, ts: Column, flag: Column) -> Column:
    """A cell of any kind as text; whole numbers without a decimal point, and none with an exponent that 38 digits can hold."""
    whole = (num == F.floor(num)) & (F.abs(num) < 1e15)
    return F.coalesce(
        text,
        F.when(whole, num.cast("bigint").cast("string")).otherwise(_plain(num)),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.when(flag, F.lit("True")).when(~flag, F.lit("False")),
    )


def _with_facts(cells: DataFrame, identifier_mode: str, *keep: str) -> DataFrame:
    """Yes/no facts about each filled cell.

    Each step uses only columns of the step before, so every pattern is
    matched once per cell however many facts depend on it.
    """
    text, num, ts, flag = (F.col(n) for n in ("text", "num", "ts", "flag"))
    cleaned, shown = F.col("cleaned"), F.col("shown")
    german, us = F.col("fits_german"), F.col("fits_us")
    bare = F.col("bare")
    named = (
        cells.withColumn("bare", N.is_bare(text))
        .withColumn("cleaned", N.strip_units(text, bare))
        .withColumn("shown", F.when(bare, text).otherwise(strip(as_text(text, num, ts, flag))))
    )
    maybe = F.col("maybe_number")
    shaped = (
        named.withColumn("maybe_number", bare | N.may_be_number(cleaned))
        .withColumn("fits_german", maybe & cleaned.rlike(N.GERMAN_SHAPE))
        .withColumn("fits_us", maybe & cleaned.rlike(N.US_SHAPE))
    )
    has_comma = F.contains(cleaned, F.lit(","))
    has_mark = has_comma | F.contains(cleaned, F.lit("."))
    long = F.length(shown) >= LONG_LENGTH
    if identifier_mode == "digits_only":
        # A number shape with a separator or a unit is an amount, not a code.
        amount = (german | us) & ((cleaned != shown) | has_mark)
        number = num.isNotNull() & F.contains(shown, F.lit("."))
        long = long & ~F.coalesce(amount, F.lit(False)) & ~number
    return shaped.select(
        *COLUMN_KEY,
        *keep,
        *[F.col(n).isNotNull().alias(f"is_{n}") for n in ("text", "num", "ts", "flag")],
        N.has_leading_zero(shown).alias("is_zero"),
        long.alias("is_long"),
        (german | us).alias("is_fit"),
        (german & has_mark & cleaned.rlike(N.GERMAN_PROOF)).alias("is_proof_german"),
        (us & has_mark & cleaned.rlike(N.US_PROOF)).alias("is_proof_us"),
        # What fits a shape also parses under it, and is plain if it is the US one without a comma.
        (german | (maybe & N.is_number(N.to_plain(cleaned, "german")))).alias("is_german"),
        (us | (maybe & N.is_number(N.to_plain(cleaned, "us")))).alias("is_us"),
        (maybe & ~has_comma & (us | N.is_number(cleaned))).alias("is_plain"),
    )


def number_format_of(default: str = "german") -> Column:
    """Format of a column from its counts; 'unknown' when nothing decides."""
    german, us = F.col("n_proof_german") > 0, F.col("n_proof_us") > 0
    fallback = "us" if default == "us" else "german"
    return (
        F.when(german & us, F.lit("unknown"))
        .when(german, F.lit("german"))
        .when(us, F.lit("us"))
        .when(F.col("n_fit") > 0, F.lit(fallback))
        .otherwise(F.lit("unknown"))
    )


def _with_decision_inputs(stats: DataFrame, default: str) -> DataFrame:
    parsed = (
        F.when(F.col("fmt") == "german", F.col("n_german"))
        .when(F.col("fmt") == "us", F.col("n_us"))
        .otherwise(F.col("n_plain"))
    )
    one_kind = (
        (F.col("n_num") == F.col("n_filled"))
        | (F.col("n_ts") == F.col("n_filled"))
        | (F.col("n_flag") == F.col("n_filled"))
    )
    return (
        stats.withColumn("fmt", number_format_of(default))
        .withColumn("n_parsed", parsed + F.col("n_num") + F.col("n_flag"))
        .withColumn("one_kind", one_kind)
        .withColumn("converts", ~one_kind & (F.col("n_parsed") / F.col("n_filled") >= CONVERT_SHARE))
        .withColumn("zero_ids", F.col("n_zero") / F.col("n_filled") > ZERO_SHARE)
        .withColumn("maybe_unique_ids", ~F.col("zero_ids") & (F.col("n_long") / F.col("n_filled") > LONG_SHARE))
    )


def column_stats(rows: DataFrame, identifier_mode: str = "all_values", default: str = "german") -> DataFrame:
    """Counts per column of every table, with the number format they decide."""
    facts = _with_facts(exploded(rows), identifier_mode)
    stats = facts.groupBy(*COLUMN_KEY).agg(
        F.count("*").alias("n_filled"),
        *[F.count_if(c).alias("n_" + c.removeprefix("is_")) for c in facts.columns if c not in COLUMN_KEY],
    )
    return _with_decision_inputs(stats, default)


def _distinct_counts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct trimmed values for the wanted columns only."""
    marked = wanted.select(*COLUMN_KEY, "n_filled", F.lit(True).alias("wanted"))
    cells = join_back(exploded(rows), marked, COLUMN_KEY, "n_filled").where("wanted")
    values = cells.select(*COLUMN_KEY, strip(as_text(*[F.col(n) for n in ("text", "num", "ts", "flag")])).alias("value"))
    return values.groupBy(*COLUMN_KEY).agg(F.count_distinct("value").alias("n_distinct"))


def _decide(stats: DataFrame) -> DataFrame:
    """Add ``identifier`` and ``type``: number, text, timestamp or boolean."""
    unique = F.coalesce(F.col("n_distinct") / F.col("n_filled") > UNIQUE_SHARE, F.lit(False))
    return stats.withColumn("identifier", F.col("zero_ids") | (F.col("maybe_unique_ids") & unique)).withColumn(
        "type",
        F.when(F.col("n_num") == F.col("n_filled"), F.lit("number"))
        .when(F.col("n_ts") == F.col("n_filled"), F.lit("timestamp"))
        .when(F.col("n_flag") == F.col("n_filled"), F.lit("boolean"))
        .when(F.col("converts") & ~F.col("identifier"), F.lit("number"))
        .otherwise(F.lit("text")),
    )


def _decisions(rows: DataFrame, stats: DataFrame, all_identifiers: bool = False) -> DataFrame:
    """Decisions from column stats, which must be cheap to read again.

    Distinct values are counted only where they can change the outcome: in
    columns of long values that would otherwise become numbers. So the second
    look at the data, and its shuffle by value, is skipped for most columns.
    """
    open_question = F.col("maybe_unique_ids")
    if not all_identifiers:
        open_question = open_question & F.col("converts")
    wanted = stats.where(open_question)
    if wanted.isEmpty():
        return _decide(stats.withColumn("n_distinct", F.lit(None).cast("bigint")))
    return _decide(stats.join(_distinct_counts(rows, wanted), COLUMN_KEY, "left"))


def column_decisions(
    rows: DataFrame,
    identifier_mode: str = "all_values",
    default: str = "german",
    all_identifiers: bool = False,
) -> DataFrame:
    """Format, identifier flag and type per column, as a written small table.

    ``all_identifiers`` asks for the flag on text columns too.
    """
    stats = written(column_stats(rows, identifier_mode, default), "column-stats")
    return written(_decisions(rows, stats, all_identifiers), "column-decisions")


# Distinct values are estimated with a standard error of 1.04 / sqrt(2 ** SKETCH).
SKETCH = 14
# An estimate settles a question that is so many standard errors away from it.
SURE = 5.0


def column_state(rows: DataFrame, identifier_mode: str = "all_values") -> DataFrame:
    """Counts per column of every table and a sketch of its distinct values, as a written table.

    The state of rows that come in batches is the states of the batches put
    together (``merged_states``), so a profile is brought up to date without
    reading earlier batches again.
    """
    cells = exploded(rows)
    facts = _with_facts(cells.withColumn("value", strip(as_text(*[F.col(n) for n in ("text", "num", "ts", "flag")]))), identifier_mode, "value")
    counted = [c for c in facts.columns if c not in (*COLUMN_KEY, "value")]
    return written(facts.groupBy(*COLUMN_KEY).agg(
        F.count("*").alias("n_filled"), *[F.count_if(c).alias("n_" + c.removeprefix("is_")) for c in counted],
        F.hll_sketch_agg("value", F.lit(SKETCH)).alias("distinct_sketch")), "column-state")


def merged_states(states: list[DataFrame]) -> DataFrame:
    """The state of all rows that ``states`` were taken from, as a written table."""
    both = reduce(DataFrame.unionByName, states)
    sums = [F.sum(c).alias(c) for c in both.columns if c.startswith("n_")]
    return written(both.groupBy(*COLUMN_KEY).agg(*sums, F.hll_union_agg("distinct_sketch").alias("distinct_sketch")), "column-state")


def state_decisions(state: DataFrame, rows: DataFrame, default: str = "german", all_identifiers: bool = False) -> DataFrame:
    """``column_decisions`` of ``rows`` from their ``state``.

    Only columns whose estimate is too near the share of distinct values that
    makes an identifier are counted in ``rows``; ``n_distinct`` is the estimate
    of the others.
    """
    stats = _with_decision_inputs(state, default).withColumn("n_distinct", F.least(F.hll_sketch_estimate("distinct_sketch"), "n_filled")).drop("distinct_sketch")
    open_question = F.col("maybe_unique_ids") if all_identifiers else F.col("maybe_unique_ids") & F.col("converts")
    off = SURE * 1.04 / (1 << SKETCH) ** 0.5 * F.col("n_distinct")
    stats = written(stats.withColumn("near", open_question & (F.abs(F.col("n_distinct") - UNIQUE_SHARE * F.col("n_filled")) <= off)), "column-stats")
    unsure = stats.where("near")
    if unsure.isEmpty():
        return written(_decide(stats.drop("near")), "column-decisions")
    counted = _distinct_counts(rows, unsure).withColumnRenamed("n_distinct", "n_counted")
    exact = stats.join(counted, COLUMN_KEY, "left").withColumn("n_distinct", F.coalesce("n_counted", "n_distinct")).drop("n_counted", "near")
    return written(_decide(exact), "column-decisions")


def column_names(headers: DataFrame) -> DataFrame:
    """``headers(doc_id, table_name, header)`` to one named row per column."""
    return headers.select(*TABLE_KEY, F.posexplode(unique_names(F.col("header"))).alias("col_no", "name"))


def table_sizes(rows: DataFrame) -> DataFrame:
    """Rows per table."""
    return rows.groupBy(*TABLE_KEY).agg(F.count("*").alias("n_rows"))


def table_profile(rows: DataFrame, decisions: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Table, column, type and row count: what a question needs to know."""
    out = decisions.select(*COLUMN_KEY, "type").join(table_sizes(rows), TABLE_KEY)
    if headers is not None:
        out = out.join(column_names(headers), COLUMN_KEY, "left")
    return out


def doc_tables(rows: DataFrame, text_blocks: DataFrame | None = None) -> DataFrame:
    """Tables per document with their row counts; the text blocks, when a
    document has any, appear last as ``document_text``."""
    tables = table_sizes(rows).withColumn("is_text", F.lit(False))
    if text_blocks is None:
        return tables
    blocks = text_blocks.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    return tables.unionByName(
        blocks.select(
            "doc_id", F.lit("document_text").alias("table_name"), "n_rows", F.lit(True).alias("is_text")
        )
    )


def table_sample(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows of every table.

    ``row_number() <= n`` is cut down inside each input partition before the
    shuffle, so a huge table sends only ``n`` rows per partition.
    """
    first = Window.partitionBy(*TABLE_KEY).orderBy("row_no")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)


# --- One big table with ordinary columns ---------------------------------------


def _string_columns(df: DataFrame, columns: list[str] | None) -> list[str]:
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return text if columns is None else [c for c in columns if c in text]


def wide_decisions(
    df: DataFrame,
    columns: list[str] | None = None,
    identifier_mode: str = "all_values",
    default: str = "german",
) -> dict[str, tuple[str, str]]:
    """(type, format) for each text column of one big table.

    The columns are unpivoted to (column, value), counted in one aggregation,
    and only its result, one row per column, comes to the driver.
    """
    names = _string_columns(df, columns)
    if not names:
        return {}
    rows = df.select(
        F.lit(0).alias("doc_id"), F.lit("data").alias("table_name"), F.array(*[F.col(f"`{c}`") for c in names]).alias("cells")
    )
    counted = column_stats(rows, identifier_mode, default)
    stats = df.sparkSession.createDataFrame(counted.collect(), counted.schema)
    found = _decisions(rows, stats).select("col_no", "type", "fmt").collect()
    decided = {names[r.col_no]: (r.type, r.fmt) for r in found}
    return {c: decided.get(c, ("empty", "unknown")) for c in names}
