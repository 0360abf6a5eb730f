"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# A word is a run of characters other than space and tab to carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN), "")


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def largest(numbers: Column) -> Column:
    return F.coalesce(F.array_max(numbers).cast("long"), F.lit(0).cast("long"))


def before(numbers: Column, fold: Callable[[Column], Column]) -> Column:
    """For every element ``fold`` (``total`` or ``largest``) of those before it.

    Runs of 128 elements are folded first, so an array of n elements costs
    about 64 n steps and not n squared.
    """

    def runs(values: Column) -> Column:
        n = F.ceil(F.size(values) / F.lit(CHUNK)).cast("int")
        each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda c: fold(F.slice(values, (c - 1) * CHUNK + 1, CHUNK)))
        return let(each, lambda f: F.transform(f, lambda _, c: fold(F.slice(f, F.lit(1), c))))

    def inside(values: Column, earlier: Column, i: Column) -> Column:
        run = F.floor(i / CHUNK).cast("int")
        return fold(F.array(F.get(earlier, run), fold(F.slice(values, run * CHUNK + 1, i % CHUNK))))

    return let(numbers, lambda v: let(runs(v), lambda e: F.transform(v, lambda _, i: inside(v, e, i))))
