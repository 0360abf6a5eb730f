"""Joins against tables that are small or not, decided by their measured size, and the size of batches sent to Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.joining import BROADCAST_BYTES


def small(table: DataFrame) -> bool:
    """Whether a written table, as JSON text, stays below the broadcast bound."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(*table.columns))))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def joined(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a written ``table``: by broadcast if it is small, else as Spark plans it."""
    return rows.join(F.broadcast(table) if small(table) else table, keys, how)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends at most 500 rows at a time to Python: texts can be long."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return df
