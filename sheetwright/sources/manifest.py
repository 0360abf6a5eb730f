"""Stored tables whose files are named by a manifest.

A change never touches a file that a reader may have open: it writes files of
its own and then a new version of the manifest, and what counts is the newest
version that is complete. A version has one row per file: its batch, the
smallest and largest document in it, a bitmap of its documents by hash, and the
version that brought it. A read for one document opens only the files that may
hold it. Documents are removed by marks, which hide them in files of earlier
versions only, so one that comes again is seen again; ``compact`` writes what is
left in one job, whatever the number of batches, and ``vacuum`` deletes what no
kept version names. One writer at a time; readers need no lock.

Cases: a batch that is committed again replaces itself; a table without a
version is empty and has no columns to read, which is an error; documents that
are null are in no bitmap and are found by ``read_all`` only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BITS = 32_768  # of a file's bitmap, as Spark's bitmap functions have them
ENTRY = "kind string, batch string, file string, first string, last string, rows long, bitmap binary, version long"
FILE = "manifest_file"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the manifest, oldest first."""
    fs, pattern = _folder(spark, f"{path}/manifest/v=*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName().removeprefix("v=")) for s in fs.globStatus(pattern) or [])


def entries(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The files of the newest or of an earlier version."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).parquet(f"{path}/manifest/v={known[-1] if version is None else version}")


def _write_version(spark: SparkSession, path: str, rows: DataFrame, version: int) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={version}")


def _hash(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BITS))


def _described(spark: SparkSession, folder: str, key: str, kind: str, batch: str, version: int) -> DataFrame:
    """Entries of the files of a folder, from their documents alone."""
    name = F.col(key).cast("string")
    return spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(name).alias("first"), F.max(name).alias("last"), F.count(F.lit(1)).alias("rows"), F.bitmap_construct_agg(F.when(name.isNotNull(), _hash(F.col(key)))).alias("bitmap"),
    ).select(F.lit(kind).alias("kind"), F.lit(batch).alias("batch"), "file", "first", "last", "rows", "bitmap", F.lit(version).cast("long").alias("version"))


def _add(df: DataFrame, path: str, key: str, kind: str, batch: str, keep: Column) -> None:
    """Write ``df`` and a version that has its files beside those of the last version that ``keep`` holds for."""
    spark = df.sparkSession
    version = max(versions(spark, path), default=0) + 1
    folder = f"{path}/{kind}/{uuid.uuid4().hex}"
    df.sortWithinPartitions(key).write.parquet(folder)
    new = _described(spark, folder, key, kind, batch, version)
    _write_version(spark, path, entries(spark, path).where(keep).unionByName(new), version)


def commit(df: DataFrame, path: str, batch: int | str, key: str = "doc_id") -> None:
    """Add a batch, in the place of an earlier one of the same name."""
    same = (F.col("kind") == "data") & (F.col("batch") == str(batch))
    _add(df, path, key, "data", str(batch), ~same)


def remove(docs: DataFrame, path: str, key: str = "doc_id") -> None:
    """Hide the documents ``docs(doc_id)`` in all that was committed until now."""
    _add(docs.select(key).distinct(), path, key, "removed", "", F.lit(True))


def _read(spark: SparkSession, path: str, listed: DataFrame, key: str) -> DataFrame:
    found = [(r.kind, r.file, r.version) for r in listed.select("kind", "file", "version").toLocalIterator()]
    data = {f: v for k, f, v in found if k == "data"}
    marks = {f: v for k, f, v in found if k == "removed"}
    if not data:
        some = entries(spark, path).where("kind = 'data'").select("file").first()
        if some is None:
            raise ValueError(f"{path} holds no committed batch")
        return spark.read.parquet(some[0]).limit(0)
    rows = spark.read.parquet(*data)
    if not marks:
        return rows
    # Both lists are as long as the files that Spark itself lists for the read.
    def versioned(df: DataFrame, of: dict[str, int], name: str) -> DataFrame:
        table = spark.createDataFrame(list(of.items()), f"{FILE} string, {name} long")
        return df.withColumn(FILE, F.col("_metadata.file_path")).join(F.broadcast(table), FILE)

    hidden = versioned(spark.read.parquet(*marks), marks, "hidden_by").groupBy(F.col(key).alias("hidden_key")).agg(F.max("hidden_by").alias("hidden_by"))
    kept = versioned(rows, data, "committed").join(hidden, (F.col(key) == F.col("hidden_key")) & (F.col("committed") < F.col("hidden_by")), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in rows.columns])


def read_all(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    return _read(spark, path, entries(spark, path), key)


def read_one(spark: SparkSession, path: str, doc: object, key: str = "doc_id") -> DataFrame:
    """One document's rows, from the files that may hold it."""
    name = F.lit(doc).cast("string")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(_hash(name) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    may = (F.col("first") <= name) & (F.col("last") >= name) & (F.getbit(byte, (_hash(name) % 8).cast("int")) == 1)
    return _read(spark, path, entries(spark, path).where((F.col("kind") == "removed") | may), key).where(F.col(key) == F.lit(doc))


def compact(spark: SparkSession, path: str, key: str = "doc_id", files: int | None = None) -> None:
    """Write what is not hidden as files sorted by document, in one job; they replace all others."""
    rows = read_all(spark, path, key)
    _add(rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key), path, key, "data", "compacted", F.lit(False))


def retire(spark: SparkSession, path: str, registry: DataFrame, cutoff: Column, key: str = "doc_id") -> DataFrame:
    """Hide the documents of ``registry(doc_id, ingested_at)`` from before ``cutoff``; returns them. No data file is rewritten."""
    gone = registry.where(F.col("ingested_at") < cutoff).select(key).distinct()
    remove(gone, path, key)
    return gone


def vacuum(spark: SparkSession, path: str, keep_versions: int = 2) -> int:
    """Delete files and versions that none of the last ``keep_versions`` versions names; returns how many folders."""
    known = versions(spark, path)
    kept = known[-keep_versions:]
    named = {f.rsplit("/", 2)[1] for v in kept for f in (r.file for r in entries(spark, path, v).select("file").toLocalIterator())}
    deleted = 0
    for pattern in ("data/*", "removed/*", "manifest/v=*"):
        fs, place = _folder(spark, f"{path}/{pattern}")
        for s in fs.globStatus(place) or []:
            name = s.getPath().getName()
            old = name not in named if not name.startswith("v=") else int(name.removeprefix("v=")) not in kept
            if old:
                fs.delete(s.getPath(), True)
                deleted += 1
    return deleted
