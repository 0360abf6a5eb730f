"""Documents that hold passages of benchmark texts.

Wu-Manber search for many test strings at once, over words instead of letters.
The test strings are all runs of ten words of an item, or the whole item where
it is shorter. A table tells for each block of two words how far it stands from
the end of a test string at least, so a position whose last block is in none
lets the search skip nearly a whole test string. Where the distance is nought,
the suffix hash of the words up to there picks the bucket of test strings to be
compared word by word.

A task searches a batch of documents in many lanes at once, each with its own
position. Test strings of another length are searched by tables of their own.
The benchmark is searched in parts of about ``PART`` words, so what is sent to
the executors is bounded whatever its size; the documents pass once for each
part and are never shuffled.

Null and empty texts have no words and hit nothing; items without words hit
nothing. An item whose id is null marks words and is listed nowhere. Repeated
items count once, repeated documents each for itself; an empty table of items
leaves every document clean, an empty table of documents gives no rows. Only
the columns named by ``keep`` are carried along. Texts of any length are
searched whole, with about four bytes for each word beside the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.session import remove_written, written, written_paths
from .expr import whole
from .tables import small_batches

# Lower-case letters and digits, and everything beyond ASCII, in UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LONGEST = 10
# Words of the benchmark searched at once, and of an item kept in one row.
PART = 500_000
PIECE = 1_000
# Bytes of text turned into words at once, and positions of a lane.
BLOCK = 4_000_000
LANE = 256
SHIFTS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def _blocks(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Place in the shift table of the blocks of these words."""
    return ((first.astype(np.uint64) * MIX + last.astype(np.uint64)) * MIX) >> np.uint64(64 - SHIFTS.bit_length() + 1)


def _hashed(words: Iterable[np.ndarray]) -> np.ndarray:
    """Hash of test strings, given as their last words, their last but one and so on."""
    out = np.uint64(0)
    for w in words:
        out = out * MIX + w.astype(np.uint64)
    return out


class Strings:
    """Test strings of one length: shifts by block, and buckets in the order of their suffix hash.

    ``words`` are numbers from 1 on, with 0 between passages; ``ends`` are the
    places where a test string ends, and ``items`` the item of each.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray, items: np.ndarray, size: int):
        self.size, self.block = size, min(2, size)
        self.shifts = np.full(SHIFTS, size - self.block + 1, dtype=np.uint8)
        for back in range(size - self.block, -1, -1):
            at = ends - back
            self.shifts[_blocks(words[at - self.block + 1], words[at])] = back
        self.strings, which = np.unique(words[ends[:, None] - np.arange(size)], axis=0, return_inverse=True)
        hashes = _hashed(self.strings.T)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.strings = hashes[order], self.strings[order]
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        # Items of each test string, once each.
        pairs = np.unique(np.stack([place[which.reshape(-1)], items]), axis=1)
        self.items, self.first_item = pairs[1], np.searchsorted(pairs[0], np.arange(len(order) + 1))
        _, bucket = np.unique(self.hashes, return_counts=True)
        self.fullest = bucket.max(initial=0)

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of all occurrences in ``words``, and the test string of each."""
        size, block, last = self.size, self.block, len(words)
        at = np.arange(size - 1, last, LANE)
        until = np.minimum(at + LANE, last)
        maybe = []
        while len(at):
            end, begin = words[at], words[at - block + 1]
            # No test string goes over a word that is in none.
            shift = np.where(end == 0, size, np.where(begin == 0, size - block + 1, self.shifts[_blocks(begin, end)])).astype(np.int64)
            maybe.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < until
            at, until = at[going], until[going]
        ends = np.sort(np.concatenate(maybe)) if maybe else np.empty(0, dtype=np.int64)
        hashes = _hashed(words[ends - i] for i in range(size))
        bucket = np.searchsorted(self.hashes, hashes)
        out = [(ends[:0], bucket[:0])]
        for i in range(self.fullest):
            candidate = np.minimum(bucket + i, len(self.hashes) - 1)
            same = (self.hashes[candidate] == hashes) & (bucket + i < len(self.hashes))
            for j in range(size):
                same[same] = self.strings[candidate[same], j] == words[ends[same] - j]
            out.append((ends[same], candidate[same]))
        return np.concatenate([e for e, _ in out]), np.concatenate([c for _, c in out])


class Tests:
    """All test strings of a part of the benchmark."""

    def __init__(self, passages: pa.Table):
        ids = passages.column("item").to_pylist()
        self.ids = sorted({i for i in ids if i is not None}, key=lambda i: i.encode())
        numbers = {i: n for n, i in enumerate(self.ids)}
        self.words: dict[bytes, int] = {}
        flat, ends, items = [0], {}, {}
        for item, words in zip(ids, passages.column("words").to_pylist()):
            size = min(LONGEST, len(words))
            begin = len(flat)
            flat.extend(self.words.setdefault(w.encode(), len(self.words) + 1) for w in words)
            flat.append(0)
            ends.setdefault(size, []).extend(range(begin + size - 1, len(flat) - 1))
            items.setdefault(size, []).extend([numbers.get(item, -1)] * (len(words) - size + 1))
        flat = np.array(flat, dtype=np.int32)
        self.sizes = [Strings(flat, np.array(ends[s]), np.array(items[s]), s) for s in sorted(ends)]

    def numbers(self, text: bytes) -> list[np.ndarray]:
        """The text's words as numbers, 0 for one that is in no test string."""
        out, at = [], 0
        while at < len(text):
            end = at + BLOCK
            if end < len(text):
                # Up to the end of the word that goes over the block's end.
                word = WORD.match(text, end - 1)
                end = word.end() if word else end
            words = WORD.findall(text, at, end)
            out.append(np.fromiter(map(self.words.get, words, repeat(0)), np.int32, len(words)))
            at = end
        return out

    def search(self, texts: list[bytes], before: list[tuple[list, list]]) -> list[tuple[int, list[dict], list[str]]]:
        """Per text its number of words, the runs of words hit, and the items found, with those ``before`` them."""
        parts, begins, sizes, at = [], [], [], 0
        for t in texts:
            numbers = self.numbers(t.translate(LOWER))
            begins.append(at)
            sizes.append(sum(map(len, numbers)))
            parts += [*numbers, np.zeros(1, dtype=np.int32)]
            at += sizes[-1] + 1
        words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        begins, edge = np.array(begins, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int32)
        items: dict[int, set[str]] = {}
        for strings in self.sizes:
            ends, which = strings.found(words)
            np.add.at(edge, ends - strings.size + 1, 1)
            np.add.at(edge, ends + 1, -1)
            docs = np.searchsorted(begins, ends, side="right") - 1
            for doc, string in np.unique(np.stack([docs, which]), axis=1).T.tolist():
                numbers = strings.items[strings.first_item[string] : strings.first_item[string + 1]]
                items.setdefault(doc, set()).update(self.ids[n] for n in numbers.tolist() if n >= 0)
        for i, (spans, found) in enumerate(before):
            for s in spans:
                edge[begins[i] + s["start"]] += 1
                edge[begins[i] + s["end"]] -= 1
            if found:
                items.setdefault(i, set()).update(found)
        hit = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]]).astype(np.int8)
        starts, stops = (np.flatnonzero(np.diff(hit) == way) for way in (1, -1))
        out: list[tuple[int, list[dict], list[str]]] = [(n, [], []) for n in sizes]
        for a, b in zip(starts.tolist(), stops.tolist()):
            doc = int(np.searchsorted(begins, a, side="right")) - 1
            out[doc][1].append({"start": a - int(begins[doc]), "end": b - int(begins[doc])})
        for doc, found in items.items():
            out[doc][2].extend(sorted(found, key=lambda i: i.encode()))
        return out


def passages(tests: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The items' words, each item in rows of ``PIECE`` test strings at most."""
    lower = F.translate(whole(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    rows = tests.select(F.col(item).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0).distinct()
    last = F.greatest(F.size("words") - LONGEST, F.lit(0))
    pieces = rows.select("item", "words", F.explode(F.sequence(F.lit(0), last, F.lit(PIECE))).alias("at"))
    return pieces.select("item", F.slice("words", F.col("at") + 1, PIECE + LONGEST - 1).alias("words")).distinct()


def contaminated(docs: DataFrame, tests: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", part: int = PART) -> DataFrame:
    """Per document the columns ``keep`` as ``row``, ``n_words``, the runs of words hit as ``spans``, and the sorted ``items`` found.

    A word is hit if it is inside any occurrence of a test string.
    """
    spark = docs.sparkSession
    known = written(passages(tests, item), "passages")
    total = known.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, ceil(total / part))
    rows = small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), whole(text).cast("binary").alias("text"))
    rows = rows.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<start:long,end:long>>"), "items": F.array().cast("array<string>")})
    schema, kind = rows.schema, F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    earlier: list[str] = []
    for number in range(parts):
        if number:
            # One Python worker at a time, and each part's documents are written before the next part.
            rows = written(rows, "searched")
            remove_written(spark, earlier)
            earlier = written_paths()[-1:]
        tests_here = cloudpickle.dumps(Tests(known.where(kind == number).toArrow()))
        rows = _searched(rows, spark.sparkContext.broadcast(tests_here), schema)
    return rows.drop("text")


def _searched(rows: DataFrame, tests: Broadcast, schema: T.StructType) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cloudpickle.loads(tests.value)
        for batch in batches:
            texts, before = batch.column("text").to_pylist(), list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()))
            n_words, spans, items = zip(*known.search(texts, before)) if texts else ((), (), ())
            columns = {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, batch.schema.field("spans").type),
                       "items": pa.array(items, batch.schema.field("items").type)}
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], batch.schema.names)

    return rows.mapInArrow(search, schema)
