"""Each chat's current document, kept up to date as attachments arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_current_doc(attachments: DataFrame, seq: str = "seq") -> DataFrame:
    """Streaming form of ``registry.current_doc``; the state is one row per chat.

    Late or reordered attachments do no harm: the latest by (ts, seq) wins
    whatever order they arrive in. Write it in ``update`` or ``complete`` mode.
    """
    return attachments.groupBy("chat_id").agg(
        F.max_by("doc_id", F.struct("ts", seq)).alias("doc_id"), F.max("ts").alias("ts")
    )


def stream_open_chats(attachments: DataFrame, retention: str = "24 hours", seq: str = "seq") -> DataFrame:
    """Current document per chat and retention window, for append output.

    The watermark lets Spark forget a chat once its window is older than the
    retention period, so state is bounded by the chats of that period.
    """
    return (
        attachments.withWatermark("ts", retention)
        .groupBy("chat_id", F.window("ts", retention).alias("period"))
        .agg(F.max_by("doc_id", F.struct("ts", seq)).alias("doc_id"), F.max("ts").alias("ts"))
        .select("chat_id", F.col("period.start").alias("period_start"), "doc_id", "ts")
    )
