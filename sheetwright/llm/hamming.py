"""Exact nearest binary codes by multi-index hashing with growing radius.

A code is cut into substrings. Two codes that differ in at most m (r + 1) - 1
of their bits differ in at most r in one of the m substrings; when only the
first j substrings have been searched to r + 1, this holds up to m (r + 1) + j
- 1. So substring after substring is searched at growing radius, and a query
ends as soon as its k-th best verified distance is covered.

Equal codes are one entry that keeps its k smallest ids, whatever their
number. Entries are dealt to blocks of bounded size, in which the substring
tables are built; queries meet blocks in bounded parts, each with the tables
of one block, and the answers of the blocks are merged per query code.

Cases: rows without a vector, or with a null in it, have no code and are
neither found nor asked; ties go to the smaller id; fewer than k rows give
fewer answers; repeated rows are each an answer; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..plans.session import written


@dataclass(frozen=True)
class Search:
    k: int = 10
    bits: int = 64
    block_codes: int = 16_384
    part_queries: int = 2_048


def sign_code(vector: Column, bits: int) -> Column:
    """Code of up to 64 bits: bit i is set where element i is above 0; null without a whole vector.

    A vector of more elements than ``bits`` is an error: its code would leave some out.
    """
    if not 0 < bits <= 64:
        raise ValueError(f"a code has 1 to 64 bits, not {bits}")
    one = F.transform(vector, lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))
    too_long = F.raise_error(F.format_string(f"a vector of %s elements does not fit a code of {bits} bits", F.size(vector))).cast("long")
    return F.when(F.size(vector) > bits, too_long).when(vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull()), F.aggregate(one, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b)))


def plan(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, width) of the substrings, each about as wide as the logarithm of the number of codes."""
    m = max(1, min(bits, round(bits / max(1.0, np.log2(max(n, 2))))))
    edges = [round(i * bits / m) for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def flips(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with ``radius`` bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


class Index:
    """Substring tables over one block of distinct codes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, bits: int):
        self.codes, self.counts, self.parts = codes, counts, plan(bits, len(codes))
        self.tables = []
        for first, width in self.parts:
            values = self._cut(codes, first, width)
            self.tables.append((np.argsort(values, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << width))])))

    @staticmethod
    def _cut(codes: np.ndarray, first: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def nearest(self, query: np.uint64, k: int, masks: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes as near as the one with which k rows are reached; all codes if there are fewer rows."""
        seen = np.zeros(len(self.codes), bool)
        places, distances = np.empty(0, np.int64), np.empty(0, np.int64)
        m, widest = len(self.parts), max(w for _, w in self.parts)
        for radius in range(widest + 1):
            for j, ((first, width), (order, starts)) in enumerate(zip(self.parts, self.tables)):
                if radius <= width:
                    key = (width, radius)
                    if key not in masks:
                        masks[key] = flips(width, radius)
                    values = masks[key] ^ int(self._cut(query, first, width))
                    lo, n = starts[values], starts[values + 1] - starts[values]
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    new = order[at]
                    new = new[~seen[new]]
                    seen[new] = True
                    places = np.concatenate([places, new])
                    distances = np.concatenate([distances, np.bitwise_count(self.codes[new] ^ query).astype(np.int64)])
                covered = m * radius + j
                sure = distances <= covered
                if self.counts[places[sure]].sum() >= k:
                    rank = np.argsort(distances, kind="stable")
                    last = distances[rank][np.searchsorted(np.cumsum(self.counts[places[rank]]), k)]
                    return places[distances <= last], distances[distances <= last]
        return places, distances


def nearest(rows: DataFrame, queries: DataFrame, how: Search = Search()) -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` rows of ``rows`` (id, code) nearest to each of ``queries`` (id, code)."""
    first = F.row_number().over(W.partitionBy("code").orderBy("id"))
    entries = rows.where("code IS NOT NULL").withColumn("place", first).where(F.col("place") <= how.k)
    entries = written(entries.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    n_codes = entries.count()
    blocks = max(1, -(-n_codes // how.block_codes))
    asked = written(queries.where("code IS NOT NULL").select("code").distinct(), "asked")
    parts = max(1, -(-asked.count() // how.part_queries))
    block = F.pmod(F.xxhash64("code"), F.lit(blocks))
    # Each part of the queries meets each block; either side of a meeting is bounded.
    index = entries.select(F.col("code").alias("c"), F.size("ids").alias("n"), block.alias("block")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    probes = asked.select("code", F.pmod(F.xxhash64(F.lit("part"), "code"), F.lit(parts)).cast("int").alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(probes):
            return pd.DataFrame({"code": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "distance": pd.Series(dtype="int32")})
        index = index.sort_values("c")
        codes = index["c"].to_numpy()
        tables, masks, out = Index(codes.view(np.uint64), index["n"].to_numpy(), how.bits), {}, []
        for code in probes["code"].to_numpy():
            places, distances = tables.nearest(np.array([code]).view(np.uint64)[0], how.k, masks)
            out.append((np.full(len(places), code), codes[places], distances))
        q, c, d = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"code": q, "c": c, "distance": d.astype(np.int32)})

    met = probes.groupBy("block", "part").cogroup(index.groupBy("block", "part")).applyInPandas(meet, "code long, c long, distance int")
    # Entries of a query in order of distance, as far as the rows before them are fewer than k.
    sized = met.join(entries.select(F.col("code").alias("c"), "ids"), "c")
    nearer = F.sum(F.size("ids")).over(W.partitionBy("code").orderBy("distance").rangeBetween(W.unboundedPreceding, -1))
    some = sized.withColumn("nearer", F.coalesce(nearer, F.lit(0))).where(F.col("nearer") < how.k)
    answers = some.select("code", "distance", F.explode("ids").alias("found"))
    rank = F.row_number().over(W.partitionBy("code").orderBy("distance", "found"))
    answers = answers.withColumn("rank", rank).where(F.col("rank") <= how.k)
    # Queries with the same code have the same answers: at most k rows each.
    answers = answers.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("rank", "found", "distance"))).alias("a"))
    named = queries.where("code IS NOT NULL").select(F.col("id").alias("query_id"), "code").join(answers, "code")
    each = named.select("query_id", F.explode("a").alias("x"))
    return each.select("query_id", F.col("x.rank").alias("rank"), F.col("x.found").alias("id"), F.col("x.distance").alias("distance"))
