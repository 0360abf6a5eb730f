"""Joins of many rows with an aggregate of the same rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from ..plans.session import written

# A summary whose rows, as JSON text, take no more than this is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
# Beyond that, a key with more than this share of all rows is handled apart.
# There can be at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 1000
# Fewer rows than this of one key need no special way.
HOT_ROWS = 1_000_000


def _matched(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join in which null keys equal each other; the keys appear once."""
    other = table.withColumnsRenamed({k: f"_{i}_of_summary" for i, k in enumerate(keys)})
    same = reduce(and_, [F.col(f"rows_.`{k}`").eqNullSafe(F.col(f"_{i}_of_summary")) for i, k in enumerate(keys)])
    out = rows.alias("rows_").join(F.broadcast(other) if how.startswith("broadcast ") else other, same, how.removeprefix("broadcast "))
    return out.drop(*[f"_{i}_of_summary" for i in range(len(keys))])


def join_back(rows: DataFrame, summary: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """Add the columns of ``summary`` (one row per key) to every row.

    ``summary`` holds in ``count_col`` how many rows each key has; a row whose
    key is not in it is kept with nulls; null keys equal each other. It is written once and measured. When
    it is small it is broadcast whole. Otherwise the keys with more than a
    thousandth of the rows, at most a thousand of them, are joined by broadcast
    and never shuffled, and the remaining rows by a plain join in which no key
    can be hot.
    """
    table = written(summary, "summary")
    text = F.to_json(F.struct(*table.columns))
    total, size = table.agg(F.sum(count_col), F.sum(F.octet_length(text))).first()
    if (size or 0) <= BROADCAST_BYTES:
        return _matched(rows, table.drop(count_col), keys, "broadcast left")
    limit = max(int(total * HOT_SHARE), HOT_ROWS)
    hot = table.where(F.col(count_col) > limit)
    if hot.isEmpty():
        return _matched(rows, table.drop(count_col), keys, "left")
    hot_rows = _matched(rows, hot.drop(count_col), keys, "broadcast inner")
    other_rows = _matched(rows, hot.select(*keys), keys, "broadcast left_anti")
    cold = table.where(F.col(count_col) <= limit).drop(count_col)
    return hot_rows.unionByName(_matched(other_rows, cold, keys, "left"))
