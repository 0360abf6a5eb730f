"""Language identification: first the family, then the language within it.

Texts are counted as hashed character pairs and triples of their lower-cased
letters. Linear support vector machines, one for each pair of families, vote
for the family; one for each pair of languages of that family votes for the
language. So closely related languages are told apart by machines that have
seen nothing else. They are fitted on a bounded sample and sent with the job.

Cases: a null text or one without a letter is ``und`` with score 0; ties go to
the name first in order; languages without a listed family are families of
their own; texts are taken whole at any length, in windows; with no labelled row
everything is ``und``; repeated rows are each identified, and learned from once;
an empty table gives an empty table; other columns are carried along, but those
named as a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .sampling import per_class
from .tables import joined, small_batches

# Languages by family (ISO 639-1 codes).
FAMILIES = {
    "germanic": "da de en fy is lb nl no sv".split(),
    "romance": "ca es fr gl it pt ro".split(),
    "slavic": "be bg cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
    "indo-aryan": "bn gu hi mr ne pa ur".split(),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
LETTER = re.compile(r"[^\W\d_]")
WINDOW = 1 << 16


@dataclass(frozen=True)
class Fit:
    bound: int = 400  # texts of each language to learn from
    dims: int = 4096
    rounds: int = 30
    cost: float = 1.0


@dataclass
class Svm:
    """Votes of linear machines, one for each pair of classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None  # dims x pairs, without the scale of the features
    bias: np.ndarray | None = None


def counts(text: str, dims: int) -> np.ndarray:
    """How often each hashed pair and triple of characters occurs; runs of other characters than letters count as one space."""
    total = np.zeros(dims, np.float64)
    points = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for at in range(0, len(points), WINDOW):
        p = points[at : at + WINDOW + 2]
        pair = p[:-1] * np.uint64(0x9E3779B97F4A7C15) + p[1:]
        triple = pair[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + p[2:]
        for x in (pair[:WINDOW], triple):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            total += np.bincount((x >> np.uint64(40)).astype(np.int64) % dims, minlength=dims)
    return total


def features(c: np.ndarray) -> np.ndarray:
    """Square roots of shares: vectors of length one, in which rare pairs still weigh."""
    return np.sqrt(c / max(c.sum(), 1.0))


def _machine(x: np.ndarray, y: np.ndarray, how: Fit) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by dual coordinate descent over the rows in a fixed shuffle."""
    rng = np.random.default_rng(0)
    x = np.hstack([x, np.ones((len(x), 1))])
    w, alpha, half = np.zeros(x.shape[1]), np.zeros(len(x)), 1 / (2 * how.cost)
    norm = (x * x).sum(1) + half
    for _ in range(how.rounds):
        for i in rng.permutation(len(x)):
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + half * alpha[i]) / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def _votes(x: np.ndarray, names: np.ndarray, how: Fit) -> Svm:
    svm = Svm(sorted(set(names.tolist())))
    fitted = []
    for a, b in combinations(range(len(svm.classes)), 2):
        is_a, is_b = names == svm.classes[a], names == svm.classes[b]
        fitted.append(_machine(x[is_a | is_b], np.where(is_a[is_a | is_b], 1.0, -1.0), how))
        svm.pairs.append((a, b))
    if fitted:
        svm.weights, svm.bias = np.stack([w for w, _ in fitted], 1), np.array([b for _, b in fitted])
    return svm


def choose(svm: Svm, x: np.ndarray) -> tuple[str, float]:
    """The class with most votes (then the larger sum of margins), and how sure its own machines are, 0 to 1."""
    if len(svm.classes) == 1:
        return svm.classes[0], 1.0
    margins = x @ svm.weights + svm.bias
    wins, sums, least = np.zeros(len(svm.classes)), np.zeros(len(svm.classes)), np.full(len(svm.classes), np.inf)
    for (a, b), m in zip(svm.pairs, margins):
        wins[a if m >= 0 else b] += 1
        for c, own in ((a, m), (b, -m)):
            sums[c] += own
            least[c] = min(least[c], own)
    best = max(range(len(wins)), key=lambda c: (wins[c], sums[c], -c))
    return svm.classes[best], float(1 / (1 + np.exp(-3 * np.clip(least[best], -50, 50))))


def fit(docs: DataFrame, how: Fit = Fit(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, Svm]:
    """Machines for the families (under an empty name) and for the languages of each family.

    At most ``how.bound`` texts of each language come to the driver, as counts; copies count once.
    """
    named = docs.where(F.col(lang).isNotNull()).select(F.xxhash64(F.col(key)).alias("key"), F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("mark"), F.col(text).alias("text"))
    narrow = named.where(F.col("text").rlike(r"\p{L}")).groupBy("lang", "mark").agg(F.min("key").alias("key"))
    chosen = per_class(narrow, "lang", how.bound, "mark")
    texts = joined(small_batches(named), chosen, ["lang", "mark", "key"]).dropDuplicates(["lang", "mark"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "mark": batch["mark"], "x": [features(counts(t, how.dims)).astype("<f4").tobytes() for t in batch["text"]]})

    rows = texts.select("lang", "mark", "text").mapInPandas(count, "lang string, mark long, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.mark))
    if not rows:
        return {}
    x = np.stack([np.frombuffer(r.x, "<f4") for r in rows]).astype(np.float64)
    langs = np.array([r.lang for r in rows])
    families = np.array([FAMILY.get(r.lang, r.lang) for r in rows])
    return {"": _votes(x, families, how)} | {f: _votes(x[families == f], langs[families == f], how) for f in sorted(set(families.tolist()))}


def identify(docs: DataFrame, machines: dict[str, Svm], how: Fit = Fit(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``family_pred`` and ``score``; columns of these names are replaced."""
    added = ("lang_pred", "family_pred", "score")
    carried = [c for c in (docs.columns if keep is None else keep) if c not in added]

    def over(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                if not machines or not t or not LETTER.search(t):
                    out.append(("und", "und", 0.0))
                    continue
                x = features(counts(t, how.dims))
                family, sure = choose(machines[""], x)
                lang, surer = choose(machines[family], x)
                out.append((lang, family, min(sure, surer)))
            yield pd.DataFrame(out, columns=list(added))

    over.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    predict = F.pandas_udf(over, "lang_pred string, family_pred string, score double")
    row = F.struct(*[F.col(f"`{c}`") for c in carried], F.lit(0).alias("no column"))
    found = small_batches(docs).select(row.alias("row"), predict(F.col(f"`{text}`")).alias("found"))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in carried], *[F.col(f"found.{c}").alias(c) for c in added])
