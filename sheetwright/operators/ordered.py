"""Running values over ordered rows that stay parallel when one key is hot.

A window over a key puts all rows of that key into one task. Where a key may
hold a large share of all rows, the order axis is cut into ranges first: one
window works inside (key, range), one row per (key, range) is passed on, and a
second window over those few rows supplies what came before the range.

The axis may be of any type that Spark can order, structs included: ranges are
cut between its own distinct values. Nulls come first and NaN last, as they do
in a window, and each is a value like any other. Where no key has more rows
than one range, a plain window over the keys is enough, however many there are.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.session import written
from .joining import join_back

ROWS_PER_RANGE = 1_000_000
RANGE = "order_range"


def _ranges_of_values(df: DataFrame, order_col: str, rows: int, rows_per_range: int) -> DataFrame:
    """Per distinct value of ``order_col`` its rows and the number of its range.

    The distinct values are sorted by range partitioning. The rows before a
    value are the sum over the partitions before its own, a few rows, and over
    the values before it in its partition.
    """
    values = df.groupBy(order_col).agg(F.count(F.lit(1)).alias("value_rows"))
    parts = -(-rows // rows_per_range)
    sorted_values = written(values.repartitionByRange(parts, order_col).withColumn("part", F.spark_partition_id()), "order-values")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sorted_values.groupBy("part").agg(F.sum("value_rows").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_part"))
    inside = Window.partitionBy("part").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("before_part") + F.coalesce(F.sum("value_rows").over(inside), F.lit(0))
    return sorted_values.join(before, "part").select(order_col, "value_rows", F.floor(place / rows_per_range).alias(RANGE))


def with_ranges(
    df: DataFrame, order_col: str, rows_per_range: int = ROWS_PER_RANGE, keys: list[str] | None = None
) -> tuple[DataFrame, bool]:
    """Add ``order_range``: ranges of ``order_col`` with about as many rows each.

    Equal values share a range, so one that is very frequent makes a larger
    one. Fewer rows than one range has, of each of the ``keys`` if given, need
    no cuts; the flag says whether there are several ranges.
    """
    rows = most = df.count()
    if keys and rows > rows_per_range:
        most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if most <= rows_per_range:
        return df.withColumn(RANGE, F.lit(0).cast("long")), False
    return join_back(df, _ranges_of_values(df, order_col, rows, rows_per_range), [order_col], "value_rows"), True


def _with_carried(here: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Give each row its range's carried value; null keys match null keys."""
    names = [*keys, RANGE]
    other = carried.select(*[F.col(k).alias(f"carried_{k}") for k in names], "carried")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"carried_{k}")) for k in names])
    return here.join(other, same, "left").drop(*[f"carried_{k}" for k in names])


def carry_last(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    out: str,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Last non-null ``value`` at or before each row, per key."""
    ranged, several = with_ranges(df, order[0], rows_per_range, keys)
    inside = (
        Window.partitionBy(*keys, RANGE).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = ranged.withColumn(out, F.last(value, ignorenulls=True).over(inside))
    if not several:
        return here.drop(RANGE)
    filled_order = F.when(F.col(value).isNotNull(), F.struct(*order))
    spots = ranged.groupBy(*keys, RANGE).agg(F.max_by(value, filled_order).alias("range_end"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.select(
        *keys, RANGE, F.last("range_end", ignorenulls=True).over(before).alias("carried")
    )
    return (
        _with_carried(here, carried, keys)
        .withColumn(out, F.coalesce(out, "carried"))
        .drop("carried", RANGE)
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    out: str,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Sum of ``value`` over the rows up to and including each row, per key."""
    ranged, several = with_ranges(df, order[0], rows_per_range, keys)
    inside = (
        Window.partitionBy(*keys, RANGE).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = ranged.withColumn(out, F.sum(value).over(inside))
    if not several:
        return here.drop(RANGE)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy(*keys, RANGE)
        .agg(F.sum(value).alias("range_sum"))
        .select(*keys, RANGE, F.sum("range_sum").over(before).alias("carried"))
    )
    return (
        _with_carried(here, carried, keys)
        .withColumn(out, F.when(F.col("carried").isNull(), F.col(out))
                    .otherwise(F.coalesce(F.col(out), F.lit(0)) + F.col("carried")))
        .drop("carried", RANGE)
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Number the rows of each key 1, 2, 3 … in order."""
    one = df.withColumn("one", F.lit(1).cast("bigint"))
    return running_sum(one, keys, order, "one", out, rows_per_range).drop("one")


def rank_within(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str = "rank",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Rank rows of each key by ``value``, largest first, nulls last, ties sharing a rank.

    Works on the distinct values with their counts, so a hot key or a hot
    value is already combined before any shuffle.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    kind = df.schema[value].dataType.typeName()
    nan = F.isnan(value) if kind in ("double", "float") else F.lit(False)
    usual = F.col(value).isNotNull() & ~nan
    running = running_sum(counts.where(usual).withColumn("down", -F.col(value)), keys, ["down"], "n", "upto", rows_per_range)
    upto = running.select(*keys, value, "n", "upto")
    # NaN is above all values and comes first; nulls come after all values.
    odd = counts.where(~usual).select(*keys, value, "n", F.col("n").alias("upto"))
    sums = counts.groupBy(*keys).agg(
        F.sum(F.when(nan, F.col("n")).otherwise(0)).alias("n_nan"), F.sum(F.when(F.col(value).isNull(), 0).otherwise(F.col("n"))).alias("n_some"),
        F.sum("n").alias("n_of_key"))
    shift = F.when(F.col(value).isNull(), F.col("n_some")).when(nan, 0).otherwise(F.col("n_nan"))
    ranks = join_back(upto.unionByName(odd), sums, keys, "n_of_key")
    ranks = ranks.select(*keys, value, (F.col("upto") - F.col("n") + 1 + shift).alias(out), "n")
    return join_back(df, ranks, [*keys, value], "n")
