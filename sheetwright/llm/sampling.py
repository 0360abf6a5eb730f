"""Bounded samples of labelled rows for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.session import written
from .tables import joined


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30))


def thinned(rows: DataFrame, bound: int, key: str) -> DataFrame:
    """About twice ``bound`` of the ``class_rows`` rows of each class, by hash; all of a class that has fewer."""
    return rows.where(_place(key).cast("double") * F.col("class_rows") < F.lit(float(2 * bound + 200)) * (1 << 30))


def per_class(rows: DataFrame, label: str, bound: int, key: str) -> DataFrame:
    """At most ``bound`` rows of each class, chosen by a hash of ``key``, the same in every run.

    ``rows`` should be narrow. Classes are first thinned by hash to about
    twice the bound, so that only so many rows of a class are put in order.
    """
    rows = written(rows, "labelled")
    sizes = written(rows.groupBy(label).agg(F.count(F.lit(1)).alias("class_rows")), "classes")
    thin = thinned(joined(rows, sizes, [label]), bound, key)
    order = W.partitionBy(label).orderBy(_place(key), key)
    return written(thin.withColumn("class_place", F.row_number().over(order)).where(F.col("class_place") <= bound).select(*rows.columns), "sample")
