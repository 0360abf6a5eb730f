"""Training documents from raw ones: quality rules, near duplicates, personal data, source mix, token ids.

Each stage reads what the one before wrote. The first four return the columns
of ``documents``; the last returns, for each document of the mix, its number of
token ids and digests. A stage's result must be written before the next stage
is called: the call removes what the stage before it kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetwright.llm import minhash, mixing, pieces, privacy, quality
from sheetwright.plans.session import remove_written, written, written_paths

MODEL = "piece_bpe_32k.model"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_of_last_stage: list[str] = []


def clearing(stage: Stage) -> Stage:
    """``stage``, which first removes the intermediate tables of the stage called before."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_written(spark, _of_last_stage)
        before = set(written_paths())
        out = stage(spark, docs, sf_dir)
        _of_last_stage[:] = [p for p in written_paths() if p not in before]
        return out

    return run_stage


@clearing
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their hosts' verdicts keep."""
    return quality.accepted(docs)


@clearing
def keep_first_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.first_of_each(docs)


@clearing
def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that tell it, replaced; ``n_chars`` counts the new text."""
    return privacy.sanitised(docs).withColumn("n_chars", F.char_length("text").cast("long"))


@clearing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents none, one or two times, so that sources come near their target weights."""
    return mixing.repeated(docs)


@clearing
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of ids and decoded text of each document."""
    return pieces.digests(docs, public_tokenizers.path(MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_quality),
    ("near duplicates", keep_first_of_each),
    ("personal data", hide_personal_data),
    ("source mix", mix_sources),
    ("token ids", encode),
]

# SQL has no near-duplicate classes and no SentencePiece; the stages are tested
# against plain restatements in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs, outputs = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
            remove_written(spark, outputs)
            outputs = written_paths()[-1:]
    return docs
