"""The pipeline against plain restatements of what its stages keep."""

import random
from collections import Counter

import corpus_pipeline
from test_operators import DOCS, brute_classes, near_copies, prose


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    rows = near_copies(5) + [(1000 + i, prose(rng, 80) + f" mail me at p{i}@x.org", "en", f"s{i % 3}", 0) for i in range(30)] + [(2000, "too short", "en", "s1", 0), (2001, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        docs = spark.read.parquet(str(tmp_path / f"out{i}"))
        kept.append(docs.collect())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    good, first, clean, mixed, ids = kept
    assert {r.doc_id for r in good} == {r[0] for r in rows} - {2000, 2001}
    classes = brute_classes(good)
    assert len(first) == len(set(classes))
    assert all("@" not in r.text and r.n_chars == len(r.text) for r in clean) and len(clean) == len(first)
    assert set(Counter(r.doc_id for r in mixed).values()) <= {1, 2} and len(ids) == len(mixed)
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, ids))
