"""Tables on disk: cells, headers, text blocks, registry and question log.

Every write goes to one ``batch=<id>`` folder and replaces that folder only, so
a repeated batch leaves the same state and no document gets a folder (and tiny
files) of its own. Rows are sorted by document inside a file, so that a read for
one document skips most row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.session import written


TABLES = ("rows", "headers", "columns", "text_blocks")


def write_batch(df: DataFrame, path: str, batch_id: int | str, sort_by: list[str] | None = None) -> None:
    """Replace one batch of a stored table."""
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table with its ``batch`` column."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def has_table(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_document(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """One document's rows; the filter reaches the Parquet scan."""
    return read_table(spark, path).where(F.col("doc_id") == doc_id)


def log_questions(answers: DataFrame, path: str, batch_id: int | str) -> None:
    """Keep (ts, doc_id, question, n_rows, result) of answered questions."""
    write_batch(answers.select("ts", "doc_id", "question", "n_rows", "result"), path, batch_id)


def store_results(
    out_dir: str,
    batch_id: int | str,
    rows: DataFrame,
    headers: DataFrame,
    decisions: DataFrame,
    text_blocks: DataFrame | None = None,
) -> None:
    """Typed rows, headers, column decisions and text blocks of one batch."""
    write_batch(rows, f"{out_dir}/rows", batch_id, ["doc_id"])
    write_batch(headers, f"{out_dir}/headers", batch_id, ["doc_id"])
    write_batch(decisions, f"{out_dir}/columns", batch_id, ["doc_id"])
    if text_blocks is not None:
        write_batch(text_blocks, f"{out_dir}/text_blocks", batch_id, ["doc_id"])


def _place(spark: SparkSession, path: str):
    """File system and path of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Put a complete folder in the place of another."""
    fs, old = _place(spark, target)
    fs.delete(old, True)
    if not fs.rename(_place(spark, source)[1], old):
        raise OSError(f"{source} could not be moved to {target}")


def _settle(spark: SparkSession, path: str) -> None:
    """Put batches in place that were written whole when a run was cut short."""
    fs, pattern = _place(spark, f"{path}/_next-*")
    for status in fs.globStatus(pattern) or []:
        name = status.getPath().getName().removeprefix("_next-")
        present = fs.exists(_place(spark, f"{path}/batch={name}")[1])
        if not present and fs.exists(_place(spark, f"{path}/_next-{name}/_SUCCESS")[1]):
            _move(spark, f"{path}/_next-{name}", f"{path}/batch={name}")


def _remove(spark: SparkSession, path: str, gone: DataFrame, batches: dict[str, bool]) -> None:
    """Remove documents from the batches; ``batches`` tells which are gone as a whole.

    What stays is written beside the batch and moved into its place when it is
    complete, so nothing that lives depends on a half-written folder.
    """
    for batch, wholly in batches.items():
        fs, folder = _place(spark, f"{path}/batch={batch}")
        if not fs.exists(folder):
            continue
        if wholly:
            fs.delete(folder, True)
            continue
        kept = spark.read.parquet(f"{path}/batch={batch}").join(gone.select("doc_id"), "doc_id", "left_anti")
        kept.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/_next-{batch}")
        _move(spark, f"{path}/_next-{batch}", f"{path}/batch={batch}")


def retire(spark: SparkSession, store_dir: str, cutoff: Column, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """Remove documents ingested before ``cutoff``; returns them.

    A batch that holds only such documents is dropped, one that holds some is
    rewritten, others are left alone; a table may lack a batch. Tables come
    first and the registry last, so that a run that was cut short can be repeated.
    A store without documents has no registry folders; none are then returned.
    """
    for table in (*tables, "registry"):
        _settle(spark, f"{store_dir}/{table}")
    if not has_table(spark, f"{store_dir}/registry"):
        return spark.createDataFrame([], "doc_id string")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=([^/]*)/[^/]*$", 1)
    # The folder's own name: a batch called 007 is not batch 7.
    registry = read_table(spark, f"{store_dir}/registry").withColumn("batch", F.url_decode(name))
    late = F.coalesce(F.col("ingested_at") < cutoff, F.lit(False))
    marked = written(registry.select("doc_id", "batch", late.alias("late")), "marked")
    gone = marked.where("late")
    sums = marked.groupBy("batch").agg(F.bool_or("late").alias("some"), F.bool_and("late").alias("wholly")).where("some")
    batches = {r.batch: r.wholly for r in sums.toLocalIterator()}
    for table in tables:
        _remove(spark, f"{store_dir}/{table}", gone, batches)
    _remove(spark, f"{store_dir}/registry", gone, batches)
    return gone.select("doc_id")
