"""Questions on cleaned tables, over every row. Plain DataFrames in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.text import squeeze
from ..plans.session import written
from .joining import join_back
from .ordered import ROWS_PER_RANGE, rank_within, running_sum
from .profile import column_names


def total(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Sum of a column, over all rows or those that match."""
    kept = df if where is None else df.where(where)
    return kept.agg(F.sum(col).alias("total"))


def total_product(df: DataFrame, a: str, b: str, where: Column | None = None) -> DataFrame:
    """Sum of the product of two columns, such as quantity times price."""
    kept = df if where is None else df.where(where)
    return kept.agg(F.sum(F.col(a) * F.col(b)).alias("total"))


def n_distinct(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Number of different values."""
    count = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(count.alias("n"))


def total_by(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Sum and row count per group; the group keys stay as columns."""
    return df.groupBy(*keys).agg(F.sum(col).alias("total"), F.count("*").alias("n"))


def largest(df: DataFrame, col: str, key: str, smallest: bool = False) -> DataFrame:
    """The row with the largest (or smallest) value; the smaller key on a tie."""
    place = F.col(col).asc_nulls_last() if smallest else F.col(col).desc_nulls_last()
    return df.orderBy(place, F.col(key).asc()).limit(1).select(F.col(key), F.col(col).alias("value"))


def top(df: DataFrame, col: str, key: str, n: int) -> DataFrame:
    """The n rows with the largest values, ties in order of key."""
    return df.orderBy(F.col(col).desc_nulls_last(), F.col(key).asc_nulls_last()).limit(n)


def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """Most frequent value and its count; the smaller value on a tie."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("value").asc()).limit(1)


def n_rows(df: DataFrame, where: Column | None = None) -> DataFrame:
    kept = df if where is None else df.where(where)
    return kept.agg(F.count("*").alias("n"))


def all_totals(cells: DataFrame) -> DataFrame:
    """Total, smallest, largest and count for every numeric column of every
    table of every document, in one aggregation."""
    return (
        cells.where(F.col("num").isNotNull())
        .groupBy("doc_id", "table_name", "col_no")
        .agg(
            F.sum("num").alias("total"),
            F.min("num").alias("smallest"),
            F.max("num").alias("largest"),
            F.count("num").alias("n"),
        )
    )


def all_frequent(cells: DataFrame) -> DataFrame:
    """Most frequent text per column of every table; the smaller one on a tie.

    Counts per value come first and are combined on the map side, then the
    best per column is an aggregate again, so no column is sorted in one task.
    """
    counts = (
        cells.where(F.col("text").isNotNull())
        .groupBy("doc_id", "table_name", "col_no", "text")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("down"), F.col("text")))
    return counts.groupBy("doc_id", "table_name", "col_no").agg(best.alias("best")).select(
        "doc_id", "table_name", "col_no", F.col("best.text").alias("value"), (-F.col("best.down")).alias("n")
    )


def text_search(blocks: DataFrame, words: list[str], text_col: str = "content") -> DataFrame:
    """Blocks that contain every word, ignoring case."""
    found = reduce(lambda a, b: a & b, [F.contains(F.lower(text_col), F.lit(w.lower())) for w in words])
    return blocks.where(found)


def running_total(
    df: DataFrame, keys: list[str], order: str, col: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Running total per key: one row per key and order value."""
    sums = written(df.groupBy(*keys, order).agg(F.sum(col).alias("total")), "moment-sums")
    return running_sum(sums, keys, [order], "total", "running_total", rows_per_range)


def rank_by_total(
    df: DataFrame, keys: list[str], item: str, col: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Items ranked by their total inside each key, the largest first."""
    sums = written(df.groupBy(*keys, item).agg(F.round(F.sum(col), 2).alias("total")), "item-sums")
    return rank_within(sums, keys, "total", "rank", rows_per_range)


def total_levels(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Totals per group with subtotals and the grand total (rollup)."""
    return df.rollup(*keys).agg(
        F.sum(col).alias("total"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")
    )


def total_cube(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Totals for every combination of the keys."""
    return df.cube(*keys).agg(
        F.sum(col).alias("total"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")
    )


def total_sets(df: DataFrame, sets: list[list[str]], col: str) -> DataFrame:
    """Totals for the given groupings only, in one pass; ``level`` tells them apart."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return df.groupingSets(sets, *keys).agg(
        F.sum(col).alias("total"), F.count("*").alias("n"), F.grouping_id().cast("int").alias("level")
    )


def _number(df: DataFrame, name: str) -> Column:
    """A number that grows with the column; dates and moments become days and seconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def _celled(df: DataFrame, cuts: list[float], cells: dict[str, str]) -> DataFrame:
    """Add for columns the number of the cell between cut points that their value is in."""
    for name, out in cells.items():
        cutter = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="cell_value", outputCol=out, handleInvalid="keep")
        df = cutter.transform(df.withColumn("cell_value", _number(df, name))).drop("cell_value").withColumn(out, F.col(out).cast("long"))
    return df


def _covers(depth: int) -> Column:
    """The cells of all levels up to ``depth`` that make up those from ``low_cell`` to ``high_cell``.

    On each level these are the first whole cell if it is the second of its
    pair, and the last if it is the first of its pair.
    """
    return F.expr(f"""flatten(transform(sequence(0, {depth}), k -> filter(array(
        if(shiftright(low_cell + (1L << k) - 1, k) % 2 = 1, struct(k AS level, shiftright(low_cell + (1L << k) - 1, k) AS place), NULL),
        if(shiftright(high_cell + 1, k) % 2 = 1 AND NOT (shiftright(low_cell + (1L << k) - 1, k) % 2 = 1 AND shiftright(low_cell + (1L << k) - 1, k) + 1 = shiftright(high_cell + 1, k)),
           struct(k AS level, shiftright(high_cell + 1, k) - 1 AS place), NULL)),
        c -> c IS NOT NULL AND shiftright(low_cell + (1L << k) - 1, k) < shiftright(high_cell + 1, k))))""")


def _cells_of(cell: str, depth: int) -> Column:
    """The cell of each level up to ``depth`` that a cell of the lowest is in."""
    return F.expr(f"transform(sequence(0, {depth}), k -> struct(k AS level, shiftright({cell}, k) AS place))")


def in_interval(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, levels: int = 12,
    totals: dict[str, tuple[str, str]] | None = None, rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Join points with the intervals ``low <= point < high`` that hold them.

    The axis is cut into up to 2 ** ``levels`` cells at quantiles of the
    intervals' ends, and cells are paired level by level into larger ones. An
    interval, however wide, is covered by at most two cells of each level, and
    a point is in one cell of each; so both sides meet on equal cells, no pair
    meets twice, and no pairs are compared but those that share a cell. Values
    that are null are in no interval, and NaN is in none either.

    With ``totals``, names with (``count``, ``sum``, ``min`` or ``max``, column
    of the intervals; ``*`` for all rows), each point that is in an interval is
    one row with the totals of the intervals that hold it. The cells are then
    those between neighbouring ends, each of which an interval holds whole or
    not at all; so totals are taken per cell and no pair is made. Use this
    where the pairs, which may be as many as points times intervals, are only
    added up.
    """
    real = lambda df, c: F.col(c).isNotNull() & ~F.isnan(_number(df, c))
    kept = intervals.where(real(intervals, low) & real(intervals, high) & (F.col(low) < F.col(high)))
    if totals is not None:
        return _totals_in_interval(points.where(real(points, point)), kept, point, low, high, totals, rows_per_range)

    ends = intervals.select(F.explode(F.array(_number(intervals, low), _number(intervals, high))).alias("end")).where("end IS NOT NULL AND NOT isnan(end)")
    shares = [i / (1 << levels) for i in range(1, 1 << levels)]
    cuts = ends.agg(F.percentile_approx("end", shares, 4 << levels).alias("cuts")).first()["cuts"] or []
    cuts = sorted({c for c in cuts if abs(c) != float("inf")}) or [0.0]
    depth = max(1, len(cuts)).bit_length()

    placed = _celled(points.where(real(points, point)), cuts, {point: "point_cell"})
    placed = placed.withColumn("cell", F.explode(_cells_of("point_cell", depth)))
    listed = _celled(kept, cuts, {low: "low_cell", high: "high_cell"})
    listed = listed.withColumn("cell", F.explode(_covers(depth)))
    joined = placed.join(listed, "cell")
    return joined.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("cell", "point_cell", "low_cell", "high_cell")


def _totals_in_interval(
    points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, totals: dict[str, tuple[str, str]], rows_per_range: int
) -> DataFrame:
    """``in_interval`` with totals, of rows without null and NaN: intervals to cells, cells to values, values to points."""
    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    again = {**first, "count": F.sum}
    of_rows = [F.count("*").alias("held_by"), *[first[kind](c).alias(name) for name, (kind, c) in totals.items()]]
    of_totals = [F.sum("held_by").alias("held_by"), *[again[kind](name).alias(name) for name, (kind, _) in totals.items()]]
    names = ["held_by", *totals]

    # Every value once, with its uses and the number of different ends up to it.
    def used(df: DataFrame, c: str, use: str) -> DataFrame:
        return df.select(F.col(c).alias("axis_value"), *[F.lit(int(u == use)).cast("long").alias(u) for u in ("points", "lows", "highs")])

    axis = used(points, point, "points").unionByName(used(intervals, low, "lows")).unionByName(used(intervals, high, "highs"))
    axis = axis.groupBy("axis_value").agg(*[F.sum(u).alias(u) for u in ("points", "lows", "highs")])
    axis = written(axis.withColumn("is_end", (F.col("lows") + F.col("highs") > 0).cast("long")), "interval-values")
    axis = written(running_sum(axis, [], ["axis_value"], "is_end", "ends", rows_per_range), "interval-axis")
    depth = (axis.agg(F.max("ends")).first()[0] or 1).bit_length()
    kind = axis.schema["axis_value"].dataType

    spans = intervals.groupBy(F.col(low).cast(kind).alias("low_value"), F.col(high).cast(kind).alias("high_value")).agg(*of_rows)
    for side, uses, cell in (("low_value", "lows", F.col("ends") - 1), ("high_value", "highs", F.col("ends") - 2)):
        places = axis.where(F.col(uses) > 0).select(F.col("axis_value").alias(side), uses, cell.alias(side.replace("value", "cell")))
        spans = join_back(spans, places, [side], uses)
    cells = spans.select(*names, F.explode(_covers(depth)).alias("cell")).groupBy("cell").agg(*of_totals)
    cells = cells.select("cell.*", *names).withColumn("lowest", F.expr("1L << level"))

    values = axis.where("points > 0 AND ends > 0").select("axis_value", "points", (F.col("ends") - 1).alias("own_cell"))
    own = values.groupBy("own_cell").agg(F.count("*").alias("n_values"))
    above = own.select("own_cell", "n_values", F.explode(_cells_of("own_cell", depth)).alias("cell")).select("own_cell", "n_values", "cell.*")
    held = join_back(above, cells, ["level", "place"], "lowest").where("held_by IS NOT NULL")
    held = held.groupBy("own_cell").agg(F.max("n_values").alias("n_values"), *of_totals)
    of_value = join_back(values, held, ["own_cell"], "n_values").where("held_by IS NOT NULL").select("axis_value", "points", *names)
    found = join_back(points.withColumn("axis_value", F.col(point).cast(kind)), of_value, ["axis_value"], "points")
    return found.where("held_by IS NOT NULL").drop("axis_value", "held_by")


def table_signatures(headers: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every column with its table's ``signature``: the same for tables whose columns have the same names and types in any order.

    Names are compared squeezed and without case; of columns of a table with
    the same name and type the first is the first of another, and so on
    (``nth``).
    """
    key = ["doc_id", "table_name"]
    columns = column_names(headers).withColumn("name", F.lower("name")).join(decisions.select(*key, "col_no", "type"), [*key, "col_no"])
    nth = F.row_number().over(Window.partitionBy(*key, "name", "type").orderBy("col_no"))
    columns = columns.withColumn("nth", nth)
    listed = F.array_sort(F.collect_list(F.struct("name", "type", "nth")))
    tables = columns.groupBy(*key).agg(F.sha2(F.to_json(listed), 256).alias("signature"))
    return columns.join(tables, key).select(*key, "col_no", "name", "nth", "type", "signature")


def cross_doc(cells: DataFrame, headers: DataFrame, decisions: DataFrame, name: str | None = None) -> DataFrame:
    """Numeric columns, or the one called ``name``, of like tables over all documents.

    Tables are alike when their signatures are, whatever they are called and in
    whatever order their columns stand; unlike ones are never added up. The
    cells are totalled per table before anything is joined.
    """
    columns = table_signatures(headers, decisions)
    if name is not None:
        columns = columns.where(F.col("name") == F.lower(squeeze(F.lit(name))))
    found = all_totals(cells).join(columns, ["doc_id", "table_name", "col_no"])
    return found.groupBy("signature", "name", "nth").agg(
        F.sum("total").alias("total"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"),
        F.sum("n").alias("n"), F.count_distinct("doc_id").alias("n_docs"))
