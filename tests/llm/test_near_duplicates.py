"""Near duplicates at size: bands with strays, recall by similarity, batches of darts."""

import random

import numpy as np
from pyspark.sql import functions as F

from sheetwright.llm import minhash

DOCS = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(4000)]


def jaccard(a, b):
    (x, n), (y, m) = (minhash.shingles(t.lower().split(), 5, minhash.WordHashes()) for t in (a, b))
    _, i, j = np.intersect1d(x, y, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return both / (n.sum() + m.sum() - both)


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = rng.choice(WORDS)
    return out


def test_one_stray_among_many_copies_is_compared_once_with_each(spark, monkeypatch):
    """In a band of many texts only the stray meets the others."""
    rng = random.Random(1)
    base = rng.choices(WORDS, k=300)
    texts = [" ".join(changed(rng, base, 1)) for _ in range(1500)]
    stray = base[:235] + rng.choices(WORDS, k=65)  # shares bands with the others, but is not like them
    rows = spark.createDataFrame([*enumerate(texts), (9999, " ".join(stray))], DOCS)
    blocks, likely = [], minhash._likely
    monkeypatch.setattr(minhash, "_likely", lambda df, how: blocks.append((df.count(), df.groupBy("band").agg(F.count_distinct("node").alias("n")).agg(F.sum("n")).first()[0])) or likely(df, how))
    found = {r.doc_id: r.class_size for r in minhash.near_duplicates(rows).collect()}
    assert found[9999] == 1 and all(n == 1500 for d, n in found.items() if d != 9999)
    (dealt, members), = blocks
    assert members and dealt <= 3 * members  # a row of the many is dealt once, the stray once for each part


def test_strays_that_are_alike_are_found_in_a_crowded_band(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_TEXTS", 16)
    rng = random.Random(2)
    base = rng.choices(WORDS, k=200)
    crowd = [" ".join(changed(rng, base, 1)) for _ in range(120)]
    half = base[:150] + rng.choices(WORDS, k=50)
    pairs = [" ".join(changed(rng, half, 1)) for _ in range(3)]
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame([*enumerate(crowd), *enumerate(pairs, 1000)], DOCS)).collect()}
    want = {i: 0 for i in range(120)} | {1000 + i: 1000 for i in range(3)}
    assert jaccard(crowd[0], pairs[0]) < 0.8 <= jaccard(pairs[0], pairs[1]) and found == want


def test_recall_by_similarity(spark):
    """Of 240 pairs at 0.8 and more at least 98 in 100 are found, of those below none."""
    rng = random.Random(3)
    rows, near = [], {}
    for i in range(400):
        base = rng.choices(WORDS, k=rng.randint(30, 400))
        copy = changed(rng, base, max(1, round(len(base) * rng.uniform(0.001, 0.04))))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        near[i] = jaccard(rows[-2][1], rows[-1][1])
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    joined = {i: found[2 * i] == found[2 * i + 1] for i in near}
    alike = [joined[i] for i, s in near.items() if s >= 0.8]
    assert len(alike) >= 150 and sum(alike) >= 0.98 * len(alike)
    assert not any(joined[i] for i, s in near.items() if s < 0.8)


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(7)
    sets = [(rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, 5, n)) for n in (1, 2, 7, 300, 5000, 1, 40)]
    together = minhash.signatures(sets, 140)
    for (h, n), sig in zip(sets, together):
        assert (minhash.signature(h, n, 140) == sig).all() and (sig != 0).all()


def test_texts_of_very_many_words_and_of_few(spark):
    long = " ".join(f"x{i % 977} y{i % 31}" for i in range(150_000))
    rows = [(1, long), (2, long + " more"), (3, "one"), (4, "One"), (5, "one two three four"), (6, " ".join(["same"] * 50_000)), (7, None), (8, "")]
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7, 8: 8}
