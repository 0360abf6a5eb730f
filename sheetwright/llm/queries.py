"""One query per operator, over whole tables with production parameters, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontamination, divergence, extract, hamming, language, minhash, mixing, phrases, pieces, privacy, quality, toxicity
from .sql import CHECKS  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda no: F.size(F.filter("base", lambda s: s["kind"] == no)).cast("long")
    return found.select("row.doc_id", *[count(no).alias(f"n_{kind}") for no, kind in enumerate(privacy.PATTERNS)],
                        F.sha2(privacy.listed(F.col("base")), 256).alias("base_sha256"), privacy.listed(F.col("spans")).alias("spans"))


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machines = language.fit(docs.where(F.col("doc_id").isNotNull() & (_remainder(4) != 2)))
    found = language.identify(docs, machines, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "family_pred", "score")


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(hard, rows.schema))
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat.read_turns(chat.placed_turns(rows, path, pattern), path, pattern).withColumnRenamed("chat", "conv_id")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels.where(F.col("doc_id").isNotNull() & (_remainder(5) != 0)))
    found = toxicity.scored(docs, machine, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op7_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding"), 64).alias("code"))
    found = hamming.nearest(rows, rows.where(F.col("id") % 20 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.expr("aggregate(spans, 0L, (sum, s) -> sum + s.end - s.start)")
    return found.select("row.doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
