"""Files arriving in a folder become cleaned tables, each content once."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import drop_empty_rows, normalize_rows
from ..operators.registry import doc_id_of, fingerprint
from ..plans.session import written
from ..sources.csvtables import plain_path, read_csv_rows
from ..sources.routing import route_files, without_reader
from ..sources.store import has_table, read_table, store_results, write_batch
from .faults import failing, is_file_fault


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def with_file_path(files: DataFrame) -> DataFrame:
    """``binaryFile`` rows with the path in the form the other readers report."""
    return files.withColumn("path", F.col("_metadata.file_path"))


def _new_files(spark: SparkSession, files: DataFrame, out_dir: str, batch_id: int) -> DataFrame:
    """First file of each content that no *other* batch has stored."""
    firsts = (
        files.groupBy("source_id")
        .agg(F.min(F.struct("modificationTime", "path")).alias("first"))
        .select("source_id", "first.path", F.col("first.modificationTime").alias("ingested_at"))
    )
    if has_table(spark, f"{out_dir}/registry"):
        stored = read_table(spark, f"{out_dir}/registry").where(F.col("batch") != batch_id)
        firsts = firsts.join(stored.select("source_id"), "source_id", "left_anti")
    return written(firsts.withColumn("doc_id", doc_id_of(F.col("source_id"))), "new-files")


def _fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    read = spark.read.format("binaryFile").load([plain_path(unquote(p)) for p in paths])
    return with_file_path(read).select("path", "modificationTime", fingerprint(F.col("content")).alias("source_id"))


def _nowhere(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _readable(paths: list[str], read: Callable[[list[str]], DataFrame], empty: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """What ``read`` gives for the files it does not fail with, written, and why it fails with the others."""
    bad: dict[str, str] = {}
    while good := [p for p in paths if p not in bad]:
        try:
            return written(read(good), "read-files"), bad
        except (Py4JJavaError, PySparkException) as error:
            if not is_file_fault(error):
                raise
            found = failing(good, lambda some: _nowhere(read(some)))
            if not found:
                raise
            bad.update(found)
    return empty, bad


def _store(spark: SparkSession, new: DataFrame, paths: list[str], out_dir: str, batch_id: int, identifier_mode: str) -> None:
    rows, headers = read_csv_rows(spark, [plain_path(unquote(p)) for p in paths])
    names = new.select(F.col("path").alias("file"), "doc_id")

    def by_content(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("doc_id", "file").join(names, "file").drop("file")

    typed, decisions = normalize_rows(drop_empty_rows(by_content(rows)), identifier_mode)
    store_results(out_dir, batch_id, typed, by_content(headers), decisions)


def ingest_batch(files: DataFrame, batch_id: int, out_dir: str, identifier_mode: str = "all_values") -> None:
    """One batch of listed files (``path``, ``modificationTime``): tables first, the registry row last.

    Files that cannot be read here, such as workbooks and pictures, whose
    extracted cells have ways of their own, are kept in quarantine with a
    reason. So are files whose reading fails, with the error, and the others
    are stored all the same; if a copy of such a file can be read, that one is
    taken. ``files`` of the store tells of every file of the batch whether it
    is ``stored``, a ``duplicate`` or in ``quarantine``.

    A batch that is repeated after a loss replaces its own folders and leaves
    the same state; nothing counts as stored before its registry row exists.
    """
    spark = files.sparkSession
    # Only names and times: what is in the files is read file by file below.
    routed = written(route_files(files.select("path", "modificationTime")), "routed-files")
    paths = [r.path for r in routed.where(F.col("route") == "csv").select("path").toLocalIterator()]
    none = spark.createDataFrame([], "path string, modificationTime timestamp, source_id string")
    known, bad = _readable(paths, lambda some: _fingerprints(spark, some), none)
    while True:
        alive = known.where(~F.col("path").isin(*bad)) if bad else known
        new = _new_files(spark, alive, out_dir, batch_id)
        to_read = [r.path for r in new.select("path").toLocalIterator()]
        if not to_read:
            break
        try:
            _store(spark, new, to_read, out_dir, batch_id, identifier_mode)
            break
        except (Py4JJavaError, PySparkException) as error:
            if not is_file_fault(error):
                raise
            found = failing(to_read, lambda some: _nowhere(read_csv_rows(spark, [plain_path(unquote(p)) for p in some])[0]))
            if not found:
                raise
            bad.update(found)
    errors = spark.createDataFrame(list(bad.items()), "path string, reason string")
    refused = without_reader(routed, ["csv"]).select("path", "reason").unionByName(errors)
    outcome = known.select("path", "source_id").join(new.select("path", F.lit(True).alias("stored")), "path", "left")
    outcome = outcome.join(F.broadcast(errors), "path", "left_anti").select(
        "path", F.when(F.col("stored"), F.lit("stored")).otherwise(F.lit("duplicate")).alias("outcome"), "source_id")
    outcome = outcome.unionByName(refused.select("path", F.lit("quarantine").alias("outcome"), F.lit(None).cast("string").alias("source_id")))
    write_batch(refused, f"{out_dir}/quarantine", batch_id)
    write_batch(outcome, f"{out_dir}/files", batch_id)
    if to_read:
        write_batch(new, f"{out_dir}/registry", batch_id, ["source_id"])


def stream_ingest(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    max_files: int = 1000,
    identifier_mode: str = "all_values",
) -> StreamingQuery:
    """Ingest what is in ``in_dir`` and stop; run again for what came later.

    ``max_files`` bounds a batch and with it the list of paths on the driver.
    What is already known is looked up in the stored registry, not in stream
    state, so state does not grow with the number of documents.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(in_dir)
    )
    return (
        with_file_path(files).writeStream.foreachBatch(lambda df, n: ingest_batch(df, n, out_dir, identifier_mode))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
