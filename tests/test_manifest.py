"""Stored tables by manifest: what a read opens, removal marks, compaction, versions."""

import pytest
from pyspark.sql import functions as F

from sheetwright.sources import manifest as M


def rows_of(spark, lo, hi, tag):
    return spark.createDataFrame([(f"d{i:04d}", i, tag) for i in range(lo, hi) for _ in range(2)], "doc_id string, n int, tag string").repartition(2, "doc_id")


def docs(df):
    return sorted({(r.doc_id, r.tag) for r in df.collect()})


def test_one_document_opens_only_the_files_that_may_hold_it(spark, tmp_path):
    path = str(tmp_path / "t")
    # Ranges overlap, so only the bitmaps can tell.
    for b in range(6):
        M.commit(rows_of(spark, 0, 600, f"b{b}").where(F.col("n") % 6 == b), path, b)
    assert M.read_all(spark, path).count() == 1200
    found = M.read_one(spark, path, "d0100")
    assert docs(found) == [("d0100", "b4")] and found.count() == 2
    files = found.inputFiles()
    assert len(files) == 1 and M.entries(spark, path).where(F.endswith("file", F.lit(files[0].rsplit("/", 1)[1]))).first().batch == "4"
    assert M.read_one(spark, path, "d9999").isEmpty() and M.read_one(spark, path, "nothing").isEmpty()


def test_marks_hide_what_was_there_before_them(spark, tmp_path):
    path = str(tmp_path / "t")
    M.commit(rows_of(spark, 0, 10, "old"), path, 1)
    M.commit(rows_of(spark, 10, 20, "old"), path, 2)
    before = M.read_all(spark, path)
    registry = spark.createDataFrame([(f"d{i:04d}", i) for i in range(20)], "doc_id string, ingested_at int")
    gone = M.retire(spark, path, registry, F.lit(12))
    assert gone.count() == 12 and docs(M.read_all(spark, path)) == [(f"d{i:04d}", "old") for i in range(12, 20)]
    M.commit(rows_of(spark, 3, 4, "new"), path, 3)  # comes again
    assert docs(M.read_one(spark, path, "d0003")) == [("d0003", "new")] and M.read_one(spark, path, "d0004").isEmpty()
    assert before.count() == 40  # who began to read earlier goes on
    want = docs(M.read_all(spark, path))
    M.compact(spark, path, files=2)
    assert docs(M.read_all(spark, path)) == want and {r.kind for r in M.entries(spark, path).collect()} == {"data"}
    assert before.count() == 40
    assert M.vacuum(spark, path, keep_versions=1) > 0 and docs(M.read_all(spark, path)) == want
    assert len(M.versions(spark, path)) == 1


def test_a_repeated_batch_replaces_itself_and_a_cut_short_one_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        M.commit(rows_of(spark, 0, 5, "x"), path, "007")
    M.commit(rows_of(spark, 5, 6, "x"), path, 7)
    assert M.read_all(spark, path).count() == 12
    # Files without a version, and a version without its end mark.
    rows_of(spark, 50, 60, "lost").write.parquet(f"{path}/data/lost")
    M.entries(spark, path).where("false").write.parquet(f"{path}/manifest/v=99")
    (tmp_path / "t/manifest/v=99/_SUCCESS").unlink()
    assert M.read_all(spark, path).count() == 12
    with pytest.raises(ValueError):
        M.read_all(spark, str(tmp_path / "none"))


def test_null_documents_are_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    M.commit(spark.createDataFrame([(None, 1), ("a", 2)], "doc_id string, n int").coalesce(1), path, 0)
    M.remove(spark.createDataFrame([("b",), (None,)], "doc_id string"), path)
    assert M.read_all(spark, path).count() == 2 and M.read_one(spark, path, "a").count() == 1
