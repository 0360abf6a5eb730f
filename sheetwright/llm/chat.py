"""Chats as token ids with a loss mask.

Every turn's text is encoded by itself, so no token spans two turns. The
template is spliced in as reserved ids beyond the vocabulary: one opens a
turn, one parts role and text, one closes the turn. Where each segment of a
chat begins is the running sum of the segments' lengths; the mask of the
assistant's texts follows from these offsets. Control strings that occur in a
text or a role are escaped by a backslash after their first character, and
backslashes are doubled, so written out as text a chat is unambiguous as well;
reading back undoes it.

Cases: a null text or role is empty; turns are put in order by number, then
role, then text, null numbers first; repeated rows are repeated turns; rows
with a null conversation belong to one chat; an empty table gives no chat;
texts are encoded whole at any length; other columns are not carried along.
``placed_turns`` keeps a row for each turn, so a chat of any length is spread
over tasks; only its digest is taken one turn after the other, as a digest is,
with one turn at a time in memory. ``format_chats`` makes a chat one value, of
2 GB at most.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import ROWS_PER_RANGE, running_sum
from ..plans.session import written
from .tables import small_batches

# Strings that mark turns in templates in use; fixed values.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|turn|>", "<|says|>", "<|over|>"]
TURN, SAYS, OVER = CONTROL[-3:]
MARKS = (TURN, SAYS, OVER)
ESCAPED = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    """Every backslash doubled, and one put behind the first character of each control string."""
    return ESCAPED.sub(lambda m: "\\\\" if m.group() == "\\" else m.group()[0] + "\\" + m.group()[1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Coder:
    """Byte-pair ids of a rank file; ``base`` and on are the reserved ids."""

    def __init__(self, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.coding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.base = max(ranks.values()) + 1

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.coding.encode_ordinary(text), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.coding.decode_bytes(ids.tolist()).decode("utf-8")


def encode_turns(rows: DataFrame, path: str, pattern: str, chat: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``chat, turn, role, text`` with ``role_ids`` and ``text_ids``, each turn by itself."""

    def over(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Coder(path, pattern)
        for texts in batches:
            yield pd.Series([coder.encode(escape(t)).tobytes() for t in texts], dtype=object)

    over.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    ids = F.pandas_udf(over, "binary")
    whole = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    one = small_batches(rows).select(F.col(f"`{chat}`").alias("chat"), F.col(f"`{turn}`").alias("turn"), whole(role).alias("role"), whole(text).alias("text"))
    return one.withColumn("role_ids", ids("role")).withColumn("text_ids", ids("text"))


def format_chats(rows: DataFrame, path: str, pattern: str, chat: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per chat: ``chat``, ``ids`` (little-endian unsigned 32-bit integers) and ``mask``, one byte per id, 1 under the loss."""
    turns = encode_turns(rows, path, pattern, chat, turn, role, text)

    def assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = np.arange(3, dtype="<u4") + np.uint32(Coder(path, pattern).base)
        segments: list[np.ndarray] = []
        lost: list[bool] = []
        now: list = []

        def done() -> pd.DataFrame:
            # A segment's place is the sum of the lengths before it.
            ends = list(accumulate(map(len, segments)))
            mask = np.zeros(ends[-1], np.uint8)
            for end, segment, loss in zip(ends, segments, lost):
                if loss:
                    mask[end - len(segment) : end] = 1
            one = pd.DataFrame({"chat": pd.Series(now, dtype="Int64" if integer else object), "ids": [np.concatenate(segments).tobytes()], "mask": [mask.tobytes()]})
            segments.clear(), lost.clear()
            return one

        for batch in batches:
            for c, r, role_ids, text_ids in zip(batch["chat"], batch["role"], batch["role_ids"], batch["text_ids"]):
                c = None if pd.isna(c) else int(c) if integer else c
                if segments and c != now[0]:
                    yield done()
                now[:] = [c]
                for s, loss in ((marks[:1], False), (np.frombuffer(role_ids, "<u4"), False), (marks[1:2], False), (np.frombuffer(text_ids, "<u4"), r == LOSS_ROLE), (marks[2:], False)):
                    segments.append(s)
                    lost.append(loss)
        if segments:
            yield done()

    kind = turns.schema["chat"].dataType.simpleString()
    integer = kind in ("bigint", "int", "smallint", "tinyint")
    ordered = turns.repartition("chat").sortWithinPartitions("chat", "turn", "role", "text").drop("turn", "text")
    return ordered.mapInPandas(assembled, f"chat {kind}, ids binary, mask binary")


def placed_turns(
    rows: DataFrame, path: str, pattern: str, chat: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per turn: ``chat``, ``at`` (place of its first id in the chat), ``ids``, and the places ``loss_from`` up to ``loss_to`` under the loss.

    The places are running sums of lengths, which stay spread over tasks when
    one chat holds most rows. ``ids`` are little-endian unsigned 32-bit integers.
    """
    base = Coder(path, pattern).base
    mark = lambda i: F.lit(bytearray(np.array([base + i], "<u4").tobytes()))
    turns = encode_turns(rows, path, pattern, chat, turn, role, text)
    turns = turns.select("chat", "turn", "role", "text", F.concat(mark(0), "role_ids", mark(1), "text_ids", mark(2)).alias("ids"),
                         (F.octet_length("role_ids") / 4).cast("long").alias("role_size"), (F.octet_length("text_ids") / 4).cast("long").alias("text_size"))
    turns = written(turns.withColumn("size", F.col("role_size") + F.col("text_size") + 3), "turns")
    placed = running_sum(turns, ["chat"], ["turn", "role", "text"], "size", "upto", rows_per_range).withColumn("at", F.col("upto") - F.col("size"))
    begin = F.col("at") + 2 + F.col("role_size")
    return placed.select("chat", "at", "ids", begin.alias("loss_from"), F.when(F.col("role") == LOSS_ROLE, begin + F.col("text_size")).otherwise(begin).alias("loss_to"))


def read_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """What ``read_back`` tells of whole chats, from the rows of ``placed_turns``."""
    kind = turns.schema["chat"].dataType.simpleString()
    names = ["chat", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now = Coder(path, pattern), None

        def row() -> pa.RecordBatch:
            (of, as_type), n, said, lost, loss, length, ids = now
            return pa.RecordBatch.from_arrays([pa.array([of], as_type), *[pa.array([v]) for v in (n, said.hexdigest(), lost, loss.hexdigest(), length, ids)]], names)

        for batch in batches:
            as_type = batch.schema.field("chat").type
            for of, at, raw, begin, end in zip(*(batch.column(c).to_pylist() for c in ("chat", "at", "ids", "loss_from", "loss_to"))):
                if now is None or now[0][0] != of:
                    if now is not None:
                        yield row()
                    now = [(of, as_type), 0, sha256(), 0, sha256(), 0, 0]
                ids = np.frombuffer(raw, "<u4")
                opens, parts, closes = (np.flatnonzero(ids == coder.base + i) for i in range(3))
                for o, p, c in zip(opens, parts, closes):
                    role, text = coder.decode(ids[o + 1 : p]), coder.decode(ids[p + 1 : c])
                    now[1] += 1
                    now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    now[5] += sum(map(len, (*MARKS, role, text)))
                under = unescape(coder.decode(ids[begin - at : end - at]))
                now[3] += len(under)
                now[4].update(under.encode())
                now[6] += len(ids)
        if now is not None:
            yield row()

    ordered = small_batches(turns).repartition("chat").sortWithinPartitions("chat", "at")
    return ordered.mapInArrow(told, f"chat {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def read_back(chats: DataFrame, path: str, pattern: str) -> DataFrame:
    """What the ids say again: number of turns, digests of turns and of the text under the mask, and lengths in characters."""

    def over(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        coder = Coder(path, pattern)
        for ids_of, mask_of in batches:
            out = []
            for raw, mask in zip(ids_of, mask_of):
                ids, mask = np.frombuffer(raw, "<u4"), np.frombuffer(mask, np.uint8)
                at = np.flatnonzero(ids >= coder.base)
                turns, length = sha256(), 0
                opens, parts, closes = (at[ids[at] == coder.base + i] for i in range(3))
                for o, p, c in zip(opens, parts, closes):
                    role, text = coder.decode(ids[o + 1 : p]), coder.decode(ids[p + 1 : c])
                    length += sum(map(len, (*MARKS, role, text)))
                    turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                loss = unescape(coder.decode(ids[mask == 1]))
                out.append((len(opens), turns.hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), length, len(ids)))
            yield pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    over.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    read = F.pandas_udf(over, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
    return chats.select("chat", read("ids", "mask").alias("r")).select("chat", "r.*")
