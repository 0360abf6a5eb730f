"""Mixing sources to target weights in blocks of equal length.

Sources share a budget of words by weight; none may pass twice its size, and
what it leaves is reshared. The targets become whole numbers of blocks by
Sainte-Lague apportionment (highest quotients weight / 1, 3, 5, ...), first
over sources, then over the shards of each source. A shard is a stream of
documents in seeded order, cut into blocks; it gives whole passes over all its
blocks and then a run of blocks that starts at a seeded place and wraps
around. A document gives the words of its blocks. Only built-in expressions
run, and nothing depends on how rows were partitioned, so reruns agree.

Cases: a null text has size 0 and gives nothing; a null source is a source and
comes last; equal rows are separate documents; an empty table gives an empty
table; other columns are carried along whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.joining import join_back
from ..plans.session import written
from .expr import whole, words
from .tables import joined


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)  # in turn, to the sources in order
    budget: float = 1.5  # of all words
    limit: int = 2  # passes over a source
    block_words: int = 32
    shard_rows: int = 5_000
    seed: int = 7


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``src, source_size`` and other columns, with ``target``. One row per source is put in order; documents are not.

    A source is at its limit when its weight times the level reaches it. With
    the sources by limit per weight, the level of the others after each is
    known from running sums. It is right at the first source that keeps below
    its limit; from there on the levels only fall, so it is the largest of these.
    """
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    no = F.row_number().over(W.orderBy("src")) - 1
    s = sizes.withColumn("w", F.get(weights, (no % len(mix.weights)).cast("int"))).withColumn("cap", F.col("source_size") * float(mix.limit))
    order = W.orderBy(F.col("cap") / F.col("w"), "src")
    before, on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) * mix.budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(on)
    s = s.withColumn("level", level)
    found = F.max(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.col("level"))).over(everything)
    target = F.when(found.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * found))
    return s.select(*sizes.columns, target.alias("target"))


def apportion(items: DataFrame, group: list[str], item: list[str], weight: str, seats: str, given: str) -> DataFrame:
    """Adds ``given``: the ``seats`` of each group dealt to its items by highest quotients.

    At the divisor sum(weight) / (seats - n / 2) rounding deals out at most all
    seats and at least n fewer, as the first part of the same sequence. Only
    the quotients that can still win are then ranked, about two per item. An
    item of weight 0 gets nothing; equal quotients go to the item first in order.
    """
    g = W.partitionBy(*group)
    live = items.where(F.col(weight) > 0)
    sums = live.withColumn("a_total", F.sum(weight).over(g)).withColumn("a_n", F.count(F.lit(1)).over(g))
    share = F.col(weight) / F.col("a_total")
    first = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("a_n") / 2) + 0.5 - 1e-9)).cast("long")
    dealt = sums.withColumn("a_first", first).withColumn("a_left", F.col(seats) - F.sum("a_first").over(g))
    more = (F.ceil(share * F.col("a_n")) + 1).cast("long")
    tries = dealt.withColumn("a_j", F.explode(F.sequence(F.lit(0).cast("long"), more)))
    quotient = F.col(weight) / (2 * (F.col("a_first") + F.col("a_j")) + 1)
    place = F.row_number().over(g.orderBy(quotient.desc(), *item, "a_j"))
    keys = list(dict.fromkeys([*group, *item]))
    won = tries.withColumn("a_place", place).groupBy(*keys).agg(
        (F.first("a_first") + F.sum(F.when(F.col("a_place") <= F.col("a_left"), 1).otherwise(0))).alias(given))
    return items.join(won, keys, "left").withColumn(given, F.coalesce(given, F.lit(0)).cast("long"))


def mixed(docs: DataFrame, mix: Mix = Mix(), source: str = "source", text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` as ``row`` with ``size``, ``source_size``, ``target`` and ``taken`` words.

    ``keep`` names the columns that are carried along, all by default. Shards
    have about ``shard_rows`` rows however large a source is.
    """
    carried = docs.columns if keep is None else keep
    name = F.col(f"`{source}`")
    # A null source is a name of its own, after all others.
    src = F.struct(name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name"))
    whole_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), src.alias("src"),
                             F.size(words(whole(F.col(f"`{text}`")))).cast("long").alias("size"), F.col(f"`{key}`").alias("key"))
    whole_rows = written(whole_rows.withColumn("rid", F.monotonically_increasing_id()), "sized")
    rows = whole_rows.drop("row")
    sizes = written(rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), "sizes")
    wanted = targets(sizes, mix).withColumn("all", F.lit(0))
    wanted = wanted.withColumn("blocks", F.floor(F.sum("target").over(W.partitionBy("all")) / mix.block_words + 0.5).cast("long"))
    quota = apportion(wanted, ["all"], ["src"], "target", "blocks", "quota")
    quota = quota.withColumn("shards", F.ceil(F.col("source_rows") / mix.shard_rows))
    dealt = join_back(rows, quota.select("src", "source_size", "target", "quota", "shards", "source_rows"), ["src"], "source_rows")
    place = F.xxhash64(F.lit(mix.seed), "key", "size")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(mix.seed + 1), "key", "size"), "shards"))
    by = W.partitionBy("src", "shard")
    streamed = dealt.withColumn("start", F.sum("size").over(by.orderBy(place, "key", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    streamed = written(streamed, "streams")
    shards = streamed.groupBy("src", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"), F.count(F.lit(1)).alias("n"))
    shards = apportion(shards, ["src"], ["shard"], "words", "quota", "given")
    back = join_back(streamed.drop("quota"), shards.select("src", "shard", "words", "given", "n"), ["src", "shard"], "n")
    # Only numbers were moved; the rows get theirs by number.
    taken = written(back.select("rid", "source_size", "target", _taken(mix).alias("taken")), "taken")
    return joined(whole_rows.select("row", "rid", "size"), taken, ["rid"]).drop("rid")


def _taken(mix: Mix) -> Column:
    """Words that the shard's passes and its run of blocks take of one document."""
    b = F.lit(mix.block_words)
    n = F.ceil(F.col("words") / b)
    given = F.least(F.col("given"), mix.limit * n)
    passes, extra = F.floor(given / n), given % n
    first = F.pmod(F.xxhash64(F.lit(mix.seed + 2), "src", "shard"), n)
    lo, hi = F.col("start"), F.col("start") + F.col("size")

    def within(a: Column, z: Column) -> Column:
        return F.greatest(F.lit(0), F.least(hi, z * b) - F.greatest(lo, a * b))

    run = within(first, F.least(first + extra, n)) + within(F.lit(0), first + extra - n)
    return F.when(F.col("size") == 0, 0).otherwise(passes * F.col("size") + run).cast("long")


def repeated(docs: DataFrame, mix: Mix = Mix(), source: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as its taken words fill it, rounded: none, one or two times; a row without words stays."""
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    some = mixed(docs, mix, source, text, key).withColumn("times", times).where("times > 0")
    return some.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
