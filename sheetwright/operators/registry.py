"""Which content is already stored, and which document a chat is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.messages import bare_question, file_ref, message_text, picture_urls, pictures, task_reply
from ..plans.session import written
from .joining import join_back
from .ordered import ROWS_PER_RANGE, carry_last


def fingerprint(content: Column) -> Column:
    """SHA-256 of the content as hex; it identifies a document."""
    return F.sha2(content, 256)


def doc_id_of(source_id: Column) -> Column:
    """The whole fingerprint: a shorter one would be shared by different documents at scale."""
    return source_id


def first_arrivals(incoming: DataFrame, arrival: str) -> DataFrame:
    """For each content the first arrival and how often it came."""
    return incoming.groupBy("source_id").agg(
        F.min(arrival).alias("first_arrival"), F.count("*").alias("n_arrivals")
    )


def ingest_once(incoming: DataFrame, arrival: str) -> DataFrame:
    """Add ``first_arrival`` and ``cached``: only a content's first arrival is
    ingested, later ones are answered from it. Contents that make up much of
    the input are joined apart, see ``join_back``.

    ``incoming`` has fingerprints, not contents; it is written once so that the
    contents are read and hashed once."""
    incoming = written(incoming, "incoming")
    firsts = first_arrivals(incoming, arrival)
    joined = join_back(incoming, firsts, ["source_id"], "n_arrivals")
    return joined.withColumn("cached", F.col(arrival) != F.col("first_arrival"))


def known_docs(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the stored ``doc_id`` (null when new) and ``cached``.

    ``registry`` has one row per ``source_id``. Incoming contents are made
    distinct first, so copies of one content meet the registry as one row.
    ``incoming`` has fingerprints, not contents, and is written once.
    """
    incoming = written(incoming, "incoming")
    counted = incoming.groupBy("source_id").agg(F.count("*").alias("n"))
    found = counted.join(registry.select("source_id", "doc_id"), "source_id", "left")
    return join_back(incoming, found, ["source_id"], "n").withColumn("cached", F.col("doc_id").isNotNull())


def new_contents(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct contents that are not stored yet."""
    return incoming.select("source_id").distinct().join(registry, "source_id", "left_anti")


def live_only(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Entries whose document still exists."""
    return entries.join(docs.select("doc_id"), "doc_id", "left_semi")


def current_doc(attachments: DataFrame, seq: str = "seq") -> DataFrame:
    """The document each chat is about now: its latest attachment."""
    return attachments.groupBy("chat_id").agg(
        F.max_by("doc_id", F.struct("ts", seq)).alias("doc_id"), F.max("ts").alias("ts")
    )


def resolve_chat_doc(
    questions: DataFrame, attachments: DataFrame, seq: str = "seq", rows_per_range: int = ROWS_PER_RANGE,
    docs: DataFrame | None = None,
) -> DataFrame:
    """The document each question is about at the time it is asked.

    A question's own ``doc_id`` (if the column exists) wins; else the last
    attachment in its chat at or before its time. ``found`` is false where
    there is none. With the stored ``docs``, a document that is not among them
    any more is not found either; the question does not fall back to an older
    one, and ``reason`` is then ``removed``, or ``none`` without any document.
    Attachments and questions are first reduced to one row per
    chat and time, then the last attachment is carried along; a busy chat is
    cut into time ranges, see ``ordered``.
    """
    marks = attachments.select("chat_id", "ts", F.struct(F.col(seq), "doc_id").alias("attached"), F.lit(0).alias("n"))
    asked = questions.select(
        "chat_id", "ts", F.lit(None).cast(marks.schema["attached"].dataType).alias("attached"), F.lit(1).alias("n")
    )
    moments = marks.unionByName(asked).groupBy("chat_id", "ts").agg(
        F.max("attached").alias("attached"), F.sum("n").alias("n")
    )
    moments = written(moments, "chat-moments")
    known = carry_last(moments, ["chat_id"], ["ts"], "attached", "current", rows_per_range).where(F.col("n") > 0)
    answers = known.select("chat_id", "ts", F.col("current.doc_id").alias("chat_doc"), "n")
    joined = join_back(questions, answers, ["chat_id", "ts"], "n")
    own = F.coalesce("doc_id", "chat_doc") if "doc_id" in questions.columns else F.col("chat_doc")
    resolved = joined.withColumn("doc_id", own).drop("chat_doc").withColumn("found", F.col("doc_id").isNotNull())
    if docs is None:
        return resolved
    resolved = written(resolved, "chat-answers")
    live = resolved.groupBy("doc_id").agg(F.count("*").alias("n")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    marked = join_back(resolved, live.withColumn("live", F.lit(True)), ["doc_id"], "n")
    gone = F.col("found") & F.col("live").isNull()
    return marked.select(
        *[F.col(f"`{c}`") for c in resolved.columns if c not in ("doc_id", "found")],
        F.when(~gone, F.col("doc_id")).alias("doc_id"),
        (F.col("found") & ~gone).alias("found"),
        F.when(gone, "removed").when(~F.col("found"), "none").alias("reason"),
    )


def file_refs(entries: DataFrame, entry_col: str = "entry") -> DataFrame:
    """(id, name, path) of usable attachment entries; all other columns stay."""
    others = [c for c in entries.columns if c != entry_col]
    return (
        entries.select(*others, file_ref(F.col(entry_col)).alias("ref"))
        .where(F.col("ref").isNotNull())
        .select(*others, "ref.*")
    )


def last_messages(messages: DataFrame, chat: str, order: str, role: str = "user") -> DataFrame:
    """The whole last message of each chat that has the role; combined on the map side."""
    row = F.struct(*[F.col(f"`{c}`") for c in messages.columns])
    last = messages.where(F.col("role") == role).groupBy(F.col(f"`{chat}`").alias("chat_")).agg(F.max_by(row, order).alias("last"))
    return last.select("last.*")


def last_questions(messages: DataFrame, chat: str = "conv_id", order: str = "turn") -> DataFrame:
    """The bare question of each chat's last user message, from ``content``."""
    return last_messages(messages, chat, order).select(chat, bare_question(message_text(F.col("content"))).alias("question"))


def background_replies(requests: DataFrame, task: str = "task") -> DataFrame:
    """Requests that are a background job, with their canned ``reply``."""
    return requests.where(F.col(task).isNotNull()).withColumn("reply", task_reply(F.col(task)))


def without_background(requests: DataFrame, task: str = "task") -> DataFrame:
    """Requests that are questions of a person."""
    return requests.where(F.col(task).isNull())


def inline_images(messages: DataFrame) -> DataFrame:
    """Pictures in ``messages(chat_id, ts, parts, files)``, one row each."""
    found = pictures(picture_urls(F.col("parts"), F.col("files")))
    return messages.select("chat_id", "ts", F.explode(found).alias("p")).select("chat_id", "ts", "p.name", "p.content")


def last_inline_images(messages: DataFrame) -> DataFrame:
    """Pictures in the last user message of each chat; those of earlier ones were taken when they came.

    ``messages`` also has ``role``. No user message, no pictures.
    """
    return inline_images(last_messages(messages, "chat_id", "ts"))


def attachments(files: DataFrame, inline: DataFrame) -> DataFrame:
    """Files and inline pictures together, each content once per chat.

    The content is shuffled only as its fingerprint; the name kept is that of
    the earliest mention.
    """
    both = files.select("chat_id", "ts", "name", "content").unionByName(
        inline.select("chat_id", "ts", "name", "content")
    )
    return (
        both.select("chat_id", "ts", "name", fingerprint(F.col("content")).alias("source_id"))
        .groupBy("chat_id", "source_id")
        .agg(F.min(F.struct("ts", "name")).alias("first"))
        .select("chat_id", "source_id", "first.ts", "first.name")
    )


def expired(docs: DataFrame, cutoff: Column) -> DataFrame:
    """Documents stored before the cutoff; one stored exactly then stays."""
    return docs.where(F.col("ingested_at") < cutoff)


def survivors(docs: DataFrame, cutoff: Column) -> DataFrame:
    return docs.where(~(F.col("ingested_at") < cutoff))
