"""Near duplicates by DartMinHash.

A text is a weighted set: its five-word shingles with their numbers of
occurrences. Hashed darts fall on the plane of weight and time, one per unit
of area, the same for every text; a text is hit by the darts that land inside
its elements' weights. Each dart names one of ``k`` coordinates, which keeps
its earliest dart. Two texts agree in a coordinate with a probability equal to
their weighted Jaccard similarity. About k ln k darts suffice, so a long text
costs one draw per shingle and not k.

Coordinates are banded. In each band, texts are first compared with the
smallest one that shares it (as many pairs as rows). In bands that these links
leave in several components, the texts outside the largest one are then
compared with all texts of other components, in blocks that give out links only,
so no candidate is lost and no list of all pairs is made. A link is a pair whose
exact similarity reaches the threshold; classes are connected components.

Cases: words are lower-cased and split at white space; a text of one to four
words is a single shingle; a text without words, or null, is in a class of its
own; equal rows are copies of each other; an empty table gives an empty table;
other columns are kept in ``first_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..plans.session import written
from .graph import components
from .tables import joined, small_batches

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
WORDS_KEPT = 300_000  # word hashes kept by a task
# Texts and words whose darts a task draws at once.
AT_ONCE_TEXTS, AT_ONCE_WORDS = 256, 200_000
# Texts of a band that are compared in full meet in parts of about so many
# texts and words, and their elements so many at a time.
PART_TEXTS, PART_WORDS, COLUMNS = 1024, 400_000, 4096


@dataclass(frozen=True)
class Banding:
    words: int = 5
    threshold: float = 0.8
    rows: int = 5
    bands: int = 28
    # Pairs whose coordinates agree less than this share are dropped before the
    # exact check: six standard deviations below the threshold.
    least_agreement: float = 0.6

    @property
    def k(self) -> int:
        return self.rows * self.bands


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class WordHashes(dict):
    """Hash of each word, computed once while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _chained(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * GOLDEN + h[i : i + n])
    return out


def shingle_sets(texts: list[list[str]], size: int, hashes: WordHashes) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text's words the distinct shingle hashes, sorted, and how often each occurs.

    All texts are hashed at once; runs that go over a text's end are left out.
    """
    sizes = [len(t) for t in texts]
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(texts)), np.uint64, sum(sizes))
    runs = _chained(h, size) if len(h) >= size else h[:0]
    out, at = [], 0
    for n in sizes:
        out.append(np.unique(runs[at : at + n - size + 1] if n >= size else _chained(h[at : at + n], n) if n else h[:0], return_counts=True))
        at += n
    return out


def shingles(words: list[str], size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets([words], size, hashes)[0]


def _thrown(h: np.ndarray, strip: int, width: float, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Element, time and hash of all darts up to each element's ``until`` in one strip of weight.

    The darts of a strip arrive one after the other, with exponential gaps.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, last, j = np.arange(len(h)), np.zeros(len(h)), 0
    while len(at):
        m = max(1, min(math.ceil(((until[at] - last) * width).mean()) + 1, (1 << 20) // len(at)))
        no = (np.arange(j + 1, j + m + 1, dtype=np.uint64) + np.uint64(strip << 40)) * GOLDEN
        z = mix(h[at][:, None] + no[None, :])
        # Added up one by one, so that a dart's time is the same however many are drawn at once.
        t = np.cumsum(np.concatenate([last[:, None], -np.log(_unit(z)) / width], axis=1), axis=1)[:, 1:]
        hit = t <= until[at][:, None]
        parts.append((np.broadcast_to(at[:, None], t.shape)[hit], t[hit], z[hit]))
        on = hit[:, -1]
        at, last, j = at[on], t[on, -1], j + m
    return tuple(np.concatenate(x) for x in zip(*parts))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates for sets of hashed elements with positive weights, one row per set."""
    out, time = np.zeros((len(sets), k), np.uint64), np.full((len(sets), k), np.inf)
    until = np.array([k * (math.log(k) + 2) / float(n.sum()) for _, n in sets])
    todo = np.arange(len(sets))
    while len(todo):
        h = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(todo, [len(sets[i][0]) for i in todo])
        keys, darts, times = [], [], []
        lo, width, strip = 0.0, 1.0, 0
        while len(inside := np.flatnonzero(weights > lo)):
            e, t, z = _thrown(h[inside], strip, width, until[owner[inside]])
            part, z = weights[inside[e]], mix(z + GOLDEN)
            under = part >= lo + width
            some = np.flatnonzero(~under)
            under[some] = lo + width * _unit(mix(z[some] + GOLDEN)) < part[some]
            keys.append((owner[inside[e]] * k + (z % np.uint64(k)).astype(np.int64))[under])
            darts.append(z[under])
            times.append(t[under])
            lo, width, strip = lo + width, max(1.0, lo + width), strip + 1
        key, dart, when = (np.concatenate(x) for x in (keys, darts, times))
        np.minimum.at(time.reshape(-1), key, when)
        first = when == time.reshape(-1)[key]
        out.reshape(-1)[key[first]] = dart[first]
        todo = todo[~np.isfinite(time[todo]).all(axis=1)]
        until[todo] *= 2
    return out


def signature(h: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    return signatures([(h, np.asarray(weights))], k)[0]


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """The bands' hashes, one row per signature."""
    each = sig.reshape(len(sig), sig.shape[1] // rows, rows)
    out = np.broadcast_to(np.arange(1, each.shape[1] + 1, dtype=np.uint64), each.shape[:2])
    for i in range(rows):
        out = mix(out * GOLDEN + each[:, :, i])
    return out.view(np.int64)


def _signed(rows: DataFrame, how: Banding) -> DataFrame:
    names = ["rid", "content", "weight", "bands", "sig"]

    def signed(rids: list[int], texts: list[list[str]], hashes: WordHashes) -> pa.RecordBatch:
        sets = shingle_sets(texts, how.words, hashes)
        some = [i for i, (h, _) in enumerate(sets) if len(h)]
        sig = signatures([sets[i] for i in some], how.k)
        place = np.full(len(sets), -1)
        place[some] = np.arange(len(some))
        digest = [blake2b(" ".join(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() if t else None for t in texts]
        bands = pa.ListArray.from_arrays(np.arange(0, len(some) * how.bands + 1, how.bands, dtype=np.int32), pa.array(_bands(sig, how.rows).reshape(-1)))
        short = pa.array([x.tobytes() for x in (sig >> np.uint64(56)).astype(np.uint8)], pa.binary())
        take = pa.array(place, mask=place < 0)
        return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(digest, pa.binary()), pa.array([int(n.sum()) for _, n in sets], pa.int64()),
                                           bands.take(take), short.take(take)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rids, texts, size = [], [], 0
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rids.append(rid)
                texts.append((text.as_py() or "").lower().split())
                size += len(texts[-1])
                if size >= AT_ONCE_WORDS or len(rids) >= AT_ONCE_TEXTS:
                    yield signed(rids, texts, hashes)
                    rids, texts, size = [], [], 0
            if rids:
                yield signed(rids, texts, hashes)

    return small_batches(rows).select("rid", "text").mapInArrow(run, "rid long, content binary, weight long, bands array<long>, sig binary")


def _agreeing(pairs: DataFrame, sigs: DataFrame, how: Banding) -> DataFrame:
    """The pairs whose coordinates agree often enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) >= how.least_agreement * how.k for a, b in zip(batch["a"], batch["b"])]
            yield batch.loc[np.array(same, bool), ["u", "v"]]

    side = lambda x, s: sigs.select(F.col("node").alias(x), F.col("sig").alias(s))
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").mapInPandas(run, "u long, v long")


def _similar(pairs: DataFrame, texts: DataFrame, how: Banding) -> DataFrame:
    """The pairs whose exact weighted Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            keep = []
            for a, b in zip(batch["a"], batch["b"]):
                (x, n), (y, m) = (shingles(t.lower().split(), how.words, hashes) for t in (a, b))
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both = np.minimum(n[i], m[j]).sum()
                keep.append(both >= how.threshold * (n.sum() + m.sum() - both))
            yield batch.loc[np.array(keep, bool), ["u", "v"]]

    wanted = written(pairs.select(F.explode(F.array("u", "v")).alias("rid")).distinct(), "wanted")
    some = written(joined(texts.select("rid", "text"), wanted, ["rid"]), "texts")
    side = lambda x, s: some.select(F.col("rid").alias(x), F.col("text").alias(s))
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").mapInPandas(run, "u long, v long")


def _links(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, how: Banding, name: str) -> DataFrame:
    likely = written(_agreeing(pairs, sigs, how), f"{name}-likely")
    return written(_similar(likely, texts, how), f"{name}-links")


def _shared(elements: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of elements that each of the ``left`` sets has in common with each of the ``right`` ones."""
    owner = np.repeat(np.arange(len(elements)), [len(e) for e in elements])
    _, column, n = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    often = n[column] > 1  # only these can be shared
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(elements), COLUMNS), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        out += part[left] @ part[right].T
    return out


def _forest(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> list[int]:
    """Places of links that join all components that the links join, each of them joining two that were apart."""
    pairs, first = np.unique(np.stack([root[u], root[v]], 1), axis=0, return_index=True)
    parent, kept = list(range(len(root))), []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for (a, b), at in zip(pairs.tolist(), first.tolist()):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(at)
    return kept


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each group of sorted batches."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        if not table.num_rows:
            continue
        by = np.stack([table[k].to_numpy() for k in keys])
        edges = [0, *(np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1).tolist()]
        for lo, hi in zip(edges, edges[1:]):
            yield table.slice(lo, hi - lo)
        rest = table.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


BLOCK = ["band", "lo", "hi"]
PLACE = "band long, lo long, hi long, part long, node long, root long, weight long"


def _likely(blocks: DataFrame, how: Banding) -> DataFrame:
    """Of the rows of every block those that agree often enough with one of the other part in another component."""
    least = math.ceil(how.least_agreement * how.k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches, BLOCK):
            part, root, weight = (block[c].to_numpy() for c in ("part", "root", "weight"))
            sig = np.frombuffer(b"".join(block["sig"].to_pylist()), np.uint8).reshape(-1, how.k)
            left, right = np.flatnonzero(part == block["lo"][0].as_py()), np.flatnonzero(part == block["hi"][0].as_py())
            some = np.zeros(block.num_rows, bool)
            for i in left.tolist():
                apart = right[root[right] != root[i]]
                near = np.minimum(weight[apart], weight[i]) >= how.threshold * np.maximum(weight[apart], weight[i])
                apart = apart[near]
                met = apart[np.count_nonzero(sig[apart] == sig[i], axis=1) >= least]
                some[met] = True
                some[i] |= len(met) > 0
            if some.any():
                yield from block.filter(pa.array(some)).drop_columns(["sig"]).combine_chunks().to_batches()

    names = [n.split()[0] for n in PLACE.split(", ")]
    return blocks.select(*names, "sig").repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, PLACE)


def _apart_links(apart: DataFrame, sigs: DataFrame, texts: DataFrame, how: Banding) -> DataFrame:
    """Links between texts of one band in different components, by exact similarity.

    Only texts outside the band's largest component, the strays, meet others:
    each other and those of that component. A band's texts are dealt to parts
    of bounded number and length, and a part of strays is compared with every
    other part as a whole: first the signatures' bytes, then the texts of those
    that agree often enough. Of the links between the same components one comes
    out, so no more than a block has texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in _groups(batches, BLOCK):
            elements = []
            for text in block["text"].to_pylist():
                h, n = shingles(text.lower().split(), how.words, hashes)
                # A shingle that occurs c times is c elements.
                again = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                elements.append(mix(np.repeat(h, n) + again.astype(np.uint64) * GOLDEN))
            part, root, node = (block[c].to_numpy() for c in ("part", "root", "node"))
            left, right = np.flatnonzero(part == block["lo"][0].as_py()), np.flatnonzero(part == block["hi"][0].as_py())
            size = np.array([len(e) for e in elements], np.float32)
            both = _shared(elements, left, right)
            near = both >= how.threshold * (size[left][:, None] + size[right][None, :] - both)
            i, j = np.nonzero(near & (root[left][:, None] != root[right][None, :]))
            u, v = left[i], right[j]
            kept = _forest(np.unique(root, return_inverse=True)[1], u, v)
            yield pa.RecordBatch.from_arrays([pa.array(node[u[kept]]), pa.array(node[v[kept]])], ["u", "v"])

    parts = lambda n, w: F.greatest(F.ceil(F.col(n) / PART_TEXTS), F.ceil(F.col(w) / PART_WORDS)).cast("long")
    dealt = apart.withColumn("stray_parts", parts("n_stray", "w_stray")).withColumn("all_parts", F.col("stray_parts") + parts("n_major", "w_major"))
    own = F.pmod(F.xxhash64(F.lit("part"), "node"), F.when(F.col("stray"), F.col("stray_parts")).otherwise(F.col("all_parts") - F.col("stray_parts")))
    dealt = dealt.withColumn("part", F.when(F.col("stray"), own).otherwise(F.col("stray_parts") + own))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("stray"), F.col("all_parts")).otherwise(F.col("stray_parts")) - 1)
    dealt = dealt.join(sigs.select("node", "sig"), "node").withColumn("other", F.explode(others))
    dealt = dealt.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    likely = written(_likely(dealt, how), "apart-likely")
    wanted = written(likely.select(F.col("node").alias("rid")).distinct(), "apart-nodes")
    some = joined(texts.select("rid", "text"), wanted, ["rid"]).withColumnRenamed("rid", "node")
    blocks = likely.join(some, "node").select(*BLOCK, "part", "node", "root", "text")
    return small_batches(blocks).repartition(*BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(run, "u long, v long")


def classes(rows: DataFrame, how: Banding = Banding()) -> DataFrame:
    """``rid, class_rid`` for every row of a written table with ``rid`` and ``text``: the smallest row of its class."""
    signed = written(_signed(rows, how), "signed")
    sigs = signed.where(F.col("content").isNotNull()).groupBy("content").agg(
        F.min("rid").alias("node"), F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    sigs = written(sigs, "contents")
    places = sigs.select("node", "weight", F.explode("bands").alias("band"))
    shared = places.groupBy("band").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(places.join(shared.select("band", "u"), "band"), "met")
    near = lambda a, b: F.least(a, b) >= how.threshold * F.greatest(a, b)
    heads = sigs.select(F.col("node").alias("u"), F.col("weight").alias("w"))
    stars = met.where("node != u").select("u", F.col("node").alias("v"), "weight").distinct().join(heads, "u").where(near(F.col("weight"), F.col("w"))).select("u", "v")
    links = _links(stars, sigs.select("node", "sig"), rows, how, "star")
    roots = components(links)
    # Bands that still hold several components: the strays meet the rest.
    rooted = met.join(roots, "node", "left").select("band", "node", "weight", F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    largest = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    mixed = largest.where("roots > 1").select("band", F.col("m.root").alias("major"), F.col("m.n").alias("n_major"), F.col("m.w").alias("w_major"),
                                              F.expr("n - m.n").alias("n_stray"), F.expr("w - m.w").alias("w_stray"))
    apart = written(rooted.join(mixed, "band").withColumn("stray", F.expr("root != major")).drop("major"), "apart")
    more = written(_apart_links(apart, sigs, rows, how), "apart-links")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    members = signed.select("rid", "content").join(sigs.select("content", "node"), "content", "left")
    return members.join(roots, "node", "left").select("rid", F.coalesce("root", "node", "rid").alias("class_rid"))


def _numbered(docs: DataFrame, text: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")


def near_duplicates(docs: DataFrame, how: Banding = Banding(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: its key, ``class_id`` (the smallest key of its class) and ``class_size``."""
    found = written(classes(rows := _numbered(docs.select(key, text), text), how), "classes")
    named = written(found.join(rows.select("rid", F.col(f"row.`{key}`").alias(key)), "rid"), "named")
    each = named.groupBy("class_rid").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(each, "class_rid").select(key, "class_id", "class_size")


def first_of_each(docs: DataFrame, how: Banding = Banding(), text: str = "text") -> DataFrame:
    """``docs`` without the rows that near-duplicate another: the first row of each class stays, whole."""
    rows = _numbered(docs, text)
    extra = written(classes(rows, how).where("rid != class_rid").select("rid"), "extra")
    return joined(rows, extra, ["rid"], "left_anti").select("row.*")
