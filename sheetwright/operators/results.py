"""Results as they are handed on: capped, with the full count beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

MAX_ROWS = 200


def capped(df: DataFrame, order: list[Column | str], n: int = MAX_ROWS) -> DataFrame:
    """The first ``n`` rows in ``order`` with ``total_rows`` and a ``note``.

    ``orderBy().limit()`` becomes a top-n per partition; the count is a scalar
    subquery of its own, so no window over the whole result is needed.
    """
    count = F.count("*")
    note = F.concat(F.lit(f"only the first {n} of "), count.cast("string"), F.lit(" rows are shown"))
    # Both in one projection: Spark recognises a top-n only right below one.
    return df.orderBy(*order).limit(n).select(
        *[F.col(f"`{c}`") for c in df.columns],
        df.agg(count).scalar().alias("total_rows"),
        df.agg(F.when(count > n, note)).scalar().alias("note"),
    )


def capped_now(df: DataFrame, order: list[Column | str], n: int = MAX_ROWS) -> DataFrame:
    """The first ``n`` rows in ``order`` with ``total_rows`` and a ``note``.

    Unlike ``capped``, which stays a plan and asks twice, the question runs
    once, when this is called: every task keeps its first
    ``n`` rows and counts all that pass on their way there, so what comes to
    the driver is ``n`` rows and a number, as for any result that is shown.
    """
    passed = Observation()
    first = df.observe(passed, F.count(F.lit(1)).alias("rows")).orderBy(*order).limit(n).collect()
    # A result that the optimizer knows to be empty is not run at all.
    total = passed.get["rows"] if first else 0
    note = f"only the first {n} of {total} rows are shown" if total > n else None
    return df.sparkSession.createDataFrame(first, df.schema).withColumns({"total_rows": F.lit(total).cast("long"), "note": F.lit(note).cast("string")})


def capped_list(df: DataFrame, list_col: str, n: int = MAX_ROWS) -> DataFrame:
    """First items of a long list and how many there are."""
    return df.withColumn("first_items", F.slice(list_col, 1, n)).withColumn("total_items", F.size(list_col))


def to_records(df: DataFrame, out: str = "record") -> DataFrame:
    """Each row as one JSON text; dates in ISO form, nulls kept."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
               "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    return df.select(F.to_json(whole, options).alias(out))
