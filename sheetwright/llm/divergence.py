"""How far the sources of each language differ in the terms they use.

Every (language, source) and every language gives each kept term a smoothed
share in billionths, and two of them differ in a term by (p - q)^2 / (p + q),
rounded down. Summed over all kept terms for all pairs of sources, that is
mostly made of terms that at least one of the two never uses. So the sum is
taken apart: a base for the terms that neither uses, what a term used by one
adds to it, which depends on its count alone, and a correction where both use
it.

The corrections come from a frequent-pattern tree. A term is a row of its
counts that are not zero, in the order of the sources. Equal rows are one with
a multiplicity, rows are put in order, and each task inserts its range of them
into trees of bounded size. Terms that share the beginning of their rows share
nodes, and for each node and each of its ancestors the correction is worked out
once and counted as often as terms pass the node.

Null text, language and source are read as empty. A language whose terms are
all too rare has pairs with the value 0 and no terms; a source without terms
has shares by smoothing alone; an empty table gives no rows. Repeated rows
count each time, and other columns are not read. Equal values are put in order
by the item's bytes. A row is as long as its language has sources; texts of
any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.joining import join_back
from ..plans.session import written
from .expr import whole
from .tables import joined, small_batches

# ASCII letters and everything beyond ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Bytes of text whose terms a task counts at once.
BLOCK = 8_000_000
# Places of the rows that are inserted into a tree at once.
PLACES = 1_000_000
SCALE = 1_000_000_000


NAMES = ["lang", "source", "term", "n", "d"]


def _rows(lang: str, sources: np.ndarray, terms: np.ndarray, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                                       pa.array(n, pa.int64()), pa.array(d, pa.int64())], NAMES)


def _long(lang: str, source: str, text: bytes) -> Iterator[pa.RecordBatch]:
    """Counts of one text of more than a block, taken in parts that end between terms."""
    uses, at = Counter(), 0
    while at < len(text):
        inside = TERM.match(text, end - 1) if (end := at + BLOCK) < len(text) else None
        end = inside.end() if inside else end
        uses.update(TERM.findall(text, at, end))
        at = end
    terms, n = np.array(list(uses), dtype=object), np.array(list(uses.values()), dtype=np.int64)
    yield _rows(lang, np.full(len(n), source, dtype=object), terms, n, np.ones(len(n), dtype=np.int64))


def _block(lang: str, sources: list[str], texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of some texts of a language, each with its source, equal terms next to each other."""
    tokens = [t for terms in texts for t in terms]
    if tokens:
        places, terms = pd.factorize(np.array(tokens, dtype=object))
        source, names = pd.factorize(np.array(sources, dtype=object))
        doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        # A text's uses of a term, then the texts of a source.
        key, n = np.unique(places * len(texts) + doc, return_counts=True)
        key = key // len(texts) * len(names) + source[key % len(texts)]
        key, at, d = np.unique(key, return_inverse=True, return_counts=True)
        yield _rows(lang, names[key % len(names)], terms[key // len(names)], np.bincount(at, n).astype(np.int64), d)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per (lang, source, term) the occurrences ``n`` and documents ``d``, dealt by language and term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = defaultdict(lambda: ([], [])), 0
        for batch in batches:
            for lang, source, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                t = t.as_py().translate(LOWER)
                if len(t) > BLOCK:
                    yield from _long(lang, source, t)
                    continue
                sources, texts = waiting[lang]
                sources.append(source)
                texts.append(TERM.findall(t))
                size += len(t)
                if size >= BLOCK:
                    for lang_here, some in waiting.items():
                        yield from _block(lang_here, *some)
                    waiting, size = defaultdict(lambda: ([], [])), 0
        for lang_here, some in waiting.items():
            yield from _block(lang_here, *some)

    texts = small_batches(docs).select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).cast("binary").alias("text"))
    parts = texts.mapInArrow(counted, "lang string, source string, term string, n long, d long")
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact; null where there is nothing to share."""
    over = f"(CAST({total} AS DECIMAL(20)) + 2 * CAST({terms} AS DECIMAL(20)))"
    return F.when(F.expr(f"{over} > 0"), F.expr(f"CAST({SCALE} AS DECIMAL(10)) * (CAST({count} AS DECIMAL(20)) + 2) DIV {over}") + 1)


def distance(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV ({p} + {q})")


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _inserted(rows: pa.Table) -> pa.RecordBatch:
    """Sums of the corrections of all pairs of sources, from a tree of ``rows`` in order.

    All nodes of one depth are worked on at once. A row's nodes are new from
    the depth on at which it leaves the row before, and a node's multiplicity
    is summed up to the next new node of its depth.
    """
    langs, sources = rows["lang"].combine_chunks().dictionary_encode(), rows["source"].combine_chunks()
    lang, size = langs.indices.to_numpy(), pc.list_value_length(sources).to_numpy()
    deepest = int(size.max())
    owner = np.repeat(np.arange(len(size)), size)
    depth = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)

    def laid(values: np.ndarray) -> np.ndarray:
        out = np.full((len(size), deepest), -1, dtype=np.int64)
        out[owner, depth] = values
        return out

    named = sources.flatten().dictionary_encode()
    names = named.dictionary.to_numpy(zero_copy_only=False)
    source = laid(named.indices.to_numpy())
    n, p, p0 = (laid(rows[c].combine_chunks().flatten().to_numpy()) for c in ("n", "p", "p0"))
    differs = (source[1:] != source[:-1]) | (n[1:] != n[:-1])
    leaves = np.where(differs.any(axis=1), differs.argmax(axis=1), deepest)
    leaves = np.concatenate([[0], np.where(lang[1:] != lang[:-1], 0, leaves)])
    times = rows["times"].to_numpy()

    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    for d in range(1, deepest):
        new = np.flatnonzero((leaves <= d) & (size > d))
        if not len(new):
            continue
        mine, q, q0 = source[new, d][:, None], p[new, d][:, None], p0[new, d][:, None]
        above, up, up0 = source[new, :d], p[new, :d], p0[new, :d]
        passing = np.add.reduceat(np.where(size > d, times, 0), new)
        more = (_differ(up, q) - _differ(up, q0) - _differ(up0, q) + _differ(up0, q0)) * passing[:, None]
        key = (lang[new][:, None].astype(np.int64) * len(names) + above) * len(names) + mine
        keys, at = np.unique(np.concatenate([keys, key.reshape(-1)]), return_inverse=True)
        both = np.concatenate([sums, more.reshape(-1)])
        sums = np.zeros(len(keys), dtype=np.int64)
        np.add.at(sums, at, both)
    of = lambda codes: pa.array(names[codes], pa.string())
    return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // len(names) ** 2)), of(keys // len(names) % len(names)), of(keys % len(names)), pa.array(sums)],
                                      ["lang", "source", "item", "value"])


def _tree(rows: DataFrame) -> DataFrame:
    """Sums of the corrections of pairs of sources, those of each tree in rows of their own.

    ``rows`` are in order of ``lang`` and ``items``; a task inserts as many at
    once as have about ``PLACES`` places. What two trees share is in both.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, at = pa.Table.from_batches([batch]), 0
            ends = np.maximum.accumulate(pc.list_value_length(batch.column("source")).to_numpy())
            while at < table.num_rows:
                many = np.searchsorted((ends[at:] * np.arange(1, len(ends) - at + 1)), PLACES)
                many = max(1, int(many))
                yield _inserted(table.slice(at, many))
                at += many

    items = [F.col(f"items.{c}").alias(c) for c in ("source", "n", "p", "p0")]
    return rows.select("lang", "times", *items).mapInArrow(trees, "lang string, source string, item string, value long")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def _pairs(uses: DataFrame, groups: DataFrame) -> DataFrame:
    """Value of every pair of sources of a language: what neither uses, what one uses, and what both use."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    sides = joined(groups, written(others, "others"), ["lang"]).where("source <> item").withColumn("none", distance("p0", "q0"))
    base = sides.select("lang", "source", "item", F.coalesce(F.col("terms") * F.col("none"), F.lit(0)).alias("value"))

    alike = uses.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.count(F.lit(1)).alias("times"))
    alike = written(alike.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("uses")), "alike")
    more = F.expr("aggregate(uses, 0L, (sum, u) -> sum + u.times * ((u.p - q0) * (u.p - q0) DIV (u.p + q0) - none))")
    one = joined(sides, alike, ["lang", "source"]).select("lang", "source", "item", more.alias("value"))

    rows = uses.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "p", "p0"))).alias("items"))
    rows = rows.groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    both = _tree(rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items"))
    values = base.unionByName(_both_ways(one)).unionByName(_both_ways(both))
    return values.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", documents: int = 10, best: int = 10) -> DataFrame:
    """Per (lang, source): its distance to every other source, and the ``best`` terms it uses more than its language.

    Terms in fewer than ``documents`` documents of a language are left out.
    Returns ``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``
    (the other source, or the term), ``value`` and ``rank``, which counts from
    1 in each part of each (lang, source). All values are exact.
    """
    counts = term_counts(docs, text, lang, source).withColumn("documents", F.sum("d").over(W.partitionBy("lang", "term")))
    counts = counts.where(F.col("documents") >= documents).withColumn("in_lang", F.sum("n").over(W.partitionBy("lang", "term")))
    counts = written(counts.select("lang", "source", "term", "n", "in_lang"), "uses")
    langs = counts.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    groups = docs.select(whole(lang).alias("lang"), whole(source).alias("source")).distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["terms", "lang_total", "total", "rows"]).withColumn("p0", share("0", "total", "terms"))
    groups = written(groups, "groups")
    uses = join_back(counts, groups, ["lang", "source"], "rows").withColumn("p", share("n", "total", "terms"))
    uses = written(uses.withColumn("q", share("in_lang", "lang_total", "terms")).select("lang", "source", "term", "n", "p", "p0", "q"), "shares")

    pairs = _pairs(uses, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = uses.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= best))
