"""Toxicity by a factorization machine over hashed terms.

A text is the set of its words and of their first letters, hashed. The machine
adds a weight for each term and, for each two terms that occur together, the
product of their factors, so that a word can count only beside another one.
Terms that say nothing about the label in the sample, neither alone nor in a
pair, are left out before the fit. The machine is fitted on a bounded sample and sent with the job.

Cases: null and empty texts score what the machine gives for no term; texts
are taken whole at any length; repeated words count once; with no labelled row,
or only one class, the score is the share of that class (0 without rows);
repeated rows are each scored, and rows with the same key are learned from once
for each label; equal scores are equally predicted, 0.5 as toxic; an empty table
gives an empty table; other columns are carried along, but those named as a
result are replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .sampling import per_class
from .tables import joined, small_batches

WORD = re.compile(r"[^\W\d_]+")
WORDS_KEPT = 150_000
PAIR_BLOCK = 1024


@dataclass(frozen=True)
class Fit:
    bound: int = 3000  # texts of each class to learn from
    bits: int = 22
    prefix: int = 5  # letters of a word's beginning that count as a term
    least: float = 8.0  # chi-square that a term must reach by itself,
    least_pair: float = 50.0  # or that one of its pairs must add to those of its two terms
    common: float = 0.005  # share of the sample's texts that a term of such a pair is in, and 5 texts
    factors: int = 8
    rounds: int = 25
    rate: float = 0.1
    shrink: float = 2e-4


@dataclass
class Machine:
    bias: float = 0.0
    place: dict[int, int] = field(default_factory=dict)  # hashed term to row
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factor: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))


def hashed(word: str, how: Fit) -> list[int]:
    """The terms of a word: itself and, if it is longer, its beginning."""
    mask = (1 << how.bits) - 1
    terms = [xxhash.xxh3_64_intdigest(word) & mask]
    if len(word) > how.prefix:
        terms.append(xxhash.xxh3_64_intdigest(word[: how.prefix] + "*") & mask)
    return terms


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def margin(m: Machine, rows: np.ndarray) -> float:
    """Bias, weights, and products of the factors of every two terms."""
    if not len(rows):
        return m.bias
    f = m.factor[rows]
    s = f.sum(0)
    return float(m.bias + m.weight[rows].sum() + 0.5 * ((s * s).sum() - (f * f).sum()))


def chance(x: float) -> float:
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def _telling(texts: list[Collection[int]], toxic: np.ndarray, how: Fit) -> dict[int, int]:
    """Rows for the terms that tell something about the label, by themselves or in a pair."""
    n, n1 = len(texts), int(toxic.sum())
    every, ones = Counter(), Counter()
    for t, y in zip(texts, toxic):
        every.update(t)
        if y:
            ones.update(t)
    chi = {}
    for t, k in every.items():
        a = ones[t]
        parts = k * (n - k) * n1 * (n - n1)
        chi[t] = n * (a * (n - n1) - (k - a) * n1) ** 2 / parts if parts else 0.0
    kept = {t for t, c in chi.items() if c >= how.least}
    if 0 < n1 < n:
        kept |= _paired(texts, toxic, chi, sorted(t for t, k in every.items() if max(5, how.common * n) <= k < n), how)
    return {t: i for i, t in enumerate(sorted(kept, key=lambda t: (-chi[t], t)))}


def _paired(texts: list[Collection[int]], toxic: np.ndarray, chi: dict[int, float], terms: list[int], how: Fit) -> set[int]:
    """Terms of pairs whose four cases (both, either, none) differ in the label by more than each term alone explains."""
    n, n1 = len(texts), int(toxic.sum())
    place = {t: i for i, t in enumerate(terms)}
    has = np.zeros((n, len(terms)), np.uint8)
    for row, t in zip(has, texts):
        row[[place[x] for x in t if x in place]] = 1
    ones = toxic == 1
    alone = np.array([chi[t] for t in terms])
    k, k1 = has.sum(0, dtype=np.float64), has[ones].sum(0, dtype=np.float64)
    found = np.zeros(len(terms), bool)
    for at in range(0, len(terms), PAIR_BLOCK):
        i = slice(at, at + PAIR_BLOCK)
        left = has[:, i].astype(np.float32).T
        for to in range(at, len(terms), PAIR_BLOCK):
            j = slice(to, to + PAIR_BLOCK)
            right = has[:, j].astype(np.float32)
            both, both1 = (left @ right).astype(np.float64), (left[:, ones] @ right[ones]).astype(np.float64)
            a, b, a1, b1 = k[i][:, None], k[j], k1[i][:, None], k1[j]
            gain = -alone[i][:, None] - alone[j]
            for c, c1 in ((both, both1), (a - both, a1 - both1), (b - both, b1 - both1), (n - a - b + both, n1 - a1 - b1 + both1)):
                gain += (c1 - c * n1 / n) ** 2 / np.maximum(c, 1) * (n * n / (n1 * (n - n1)))
            told = gain >= how.least_pair
            found[i] |= told.any(1)
            found[j] |= told.any(0)
    return {t for t, f in zip(terms, found) if f}


def train(texts: list[Collection[int]], toxic: np.ndarray, how: Fit = Fit()) -> Machine:
    """Logistic loss, adaptive steps, rows in a fixed shuffle; the two classes weigh the same."""
    rng = np.random.default_rng(0)
    m = Machine(place=_telling(texts, toxic, how))
    share = (toxic.sum() + 0.0) / max(1, len(toxic))
    if share in (0.0, 1.0) or not m.place:
        m.bias = -50.0 if not len(toxic) or share == 0 else math.log(share / (1 - share)) if share < 1 else 50.0
        return m
    rows = [np.array(sorted(m.place[t] for t in s if t in m.place), np.int64) for s in texts]
    m.weight, m.factor = np.zeros(len(m.place)), rng.normal(0, 0.01, (len(m.place), how.factors))
    g_bias, g_weight, g_factor = 1.0, np.ones(len(m.place)), np.ones((len(m.place), how.factors))
    each = np.where(toxic, 0.5 / share, 0.5 / (1 - share))
    for _ in range(how.rounds):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            slope = (chance(margin(m, r)) - toxic[i]) * each[i]
            g_bias += slope * slope
            m.bias -= how.rate * slope / math.sqrt(g_bias)
            if not len(r):
                continue
            f = m.factor[r]
            step = slope + how.shrink * m.weight[r]
            g_weight[r] += step * step
            m.weight[r] -= how.rate * step / np.sqrt(g_weight[r])
            steps = slope * (f.sum(0) - f) + how.shrink * f
            g_factor[r] += steps * steps
            m.factor[r] -= how.rate * steps / np.sqrt(g_factor[r])
    return m


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), text: str = "text", label: str = "toxic", key: str = "doc_id") -> Machine:
    """Machine for ``labels`` (key, label 0 or 1); at most ``how.bound`` texts of each class come to the driver, as hashed terms."""
    narrow = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropDuplicates()
    chosen = per_class(narrow, "label", how.bound, "key")
    texts = joined(small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text")), chosen, ["key"])
    # A sampled key may have any number of rows; one text of each is taken.
    texts = texts.groupBy("key", "label").agg(F.min("text").alias("text"))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "label": batch["label"], "x": [array("i", sorted({t for w in words(s) for t in hashed(w, how)})).tobytes() for s in batch["text"]]})

    rows = texts.select(F.col("key").cast("string").alias("key"), "label", "text").mapInPandas(terms, "key string, label int, x binary").collect()
    rows.sort(key=lambda r: (r.key or "", r.label, r.x))
    return train([array("i", bytes(r.x)) for r in rows], np.array([r.label for r in rows], np.int64), how)


def scored(docs: DataFrame, machine: Machine, how: Fit = Fit(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); columns of these names are replaced."""
    carried = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]

    def over(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            out = []
            for t in texts:
                rows: set[int] = set()
                for w in words(t):
                    known = kept.get(w)
                    if known is None:
                        if len(kept) >= WORDS_KEPT:
                            kept.clear()
                        known = kept[w] = tuple(machine.place[x] for x in hashed(w, how) if x in machine.place)
                    rows.update(known)
                out.append(chance(margin(machine, np.array(sorted(rows), np.int64))))
            yield pd.Series(out, dtype="float64")

    over.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    found = small_batches(docs).select(*[F.col(f"`{c}`") for c in carried], F.pandas_udf(over, "double")(F.col(f"`{text}`")).alias("score"))
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
