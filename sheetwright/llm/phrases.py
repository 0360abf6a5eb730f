"""Phrases whose words occur together more often than their parts explain.

Top-order marginalisation. The only thing counted in the texts is the longest
window: at each word it and the words that lead it by one to four places, null
from the end of the piece on. Every occurrence of a phrase begins exactly one
window, so a ROLLUP over the window's columns, which sums successively shorter
prefixes, gives the count of every phrase of each length.

A phrase that occurs often enough has only words and neighbours that do. Words
and then runs of two and three frequent words are therefore counted first, and
a window is also null from the first word, pair or triple that is too rare on:
no count that is reported changes, as no such phrase could be. Runs are counted
by hash, in ``COUNTERS`` counters dealt over the tasks, and what is frequent is
told to the tasks by a table of ``SLOTS`` bits. Both have a fixed size, and a
rare run that meets a frequent one there looks frequent and costs a row. Windows are
counted by one task for each core, which adds equal ones of its blocks up and
holds up to ``HELD`` bytes of them: it gives a window out once, not once for
each block, and the tasks that give it out do not grow in number with the input.

Texts that are null or empty have no words; an empty table gives no rows.
Repeated rows count each time; columns other than text and language are not
read. Equal scores are put in order by count, then by the phrase's bytes. A
text's words are taken in blocks of about ``BLOCK`` bytes that end at a piece's
end; one piece is held whole by a task, at any length.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..plans.session import written
from .expr import whole
from .tables import joined, small_batches

ENDS = b".,;:!?\n\x0b\x0c\r"
PIECE_END = re.compile(rb"[.,;:!?\x0A-\x0D]")
TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LONGEST = 5
WINDOW = [f"w{i + 1}" for i in range(LONGEST)]
BLOCK = 8_000_000
HELD, ROWS_OUT = 1 << 26, 1 << 16
SLOTS = 1 << 26
COUNTERS, PARTS = 1 << 31, 1 << 10
# The score of a cut, in decimals of 38 digits.
EXACT = "1000 * CAST(a AS DECIMAL(20)) * CAST(n AS DECIMAL(18)) DIV (CAST(l AS DECIMAL(19)) * CAST(r AS DECIMAL(19)))"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _cut(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of at least ``BLOCK`` bytes, cut where a piece ends."""
    at = 0
    while len(text) - at > BLOCK and (end := PIECE_END.search(text, at + BLOCK)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Per block of texts of one language: the language, its distinct words, and the place of each word in them.

    A piece's end is the place -1.
    """

    def taken(waiting: dict[str, list[bytes]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, texts in waiting.items():
            tokens = TOKEN.findall(b"\n".join(texts).translate(LOWER))
            if tokens:
                places, words = pd.factorize(np.array(tokens, dtype=object))
                places[np.array([w[0] in ENDS for w in words])[places]] = -1
                yield lang, words, places

    waiting, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in _cut(text.as_py()):
                waiting[lang].append(part)
                size += len(part)
                if size >= BLOCK:
                    yield from taken(waiting)
                    waiting, size = defaultdict(list), 0
    yield from taken(waiting)


def _hashed(words: np.ndarray, lang: str) -> np.ndarray:
    both = pd.util.hash_array(np.append(words, lang.encode()).astype(object), categorize=False)
    return both[:-1] ^ (both[-1:] * MIX)


def _joined(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of runs that are one word longer."""
    return (hashes ^ (hashes >> np.uint64(29))) * MIX + word


def _counters(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * MIX) >> np.uint64(65 - COUNTERS.bit_length())).astype(np.uint32)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the counters' bits are set; a bit stands for as many counters as there are for each bit."""
    slots = _counters(hashes) // np.uint32(COUNTERS // SLOTS)
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _bits(spark: SparkSession, cells: pa.Table) -> Broadcast:
    """A table of ``SLOTS`` bits from ``cell, bits``, its parts that are not empty, on every executor."""
    bits = np.zeros((PARTS, SLOTS // PARTS // 8), dtype=np.uint8)
    for cell, value in zip(cells["cell"].to_pylist(), cells["bits"].to_pylist()):
        bits[cell] = np.frombuffer(value, np.uint8)
    return spark.sparkContext.broadcast(bits.reshape(-1))


def _frequent(counted: DataFrame, least: int) -> Broadcast:
    """Bits of the counters that reach ``least``.

    ``counted`` has a block's counts of one part of the counters in each row:
    ``cell``, places in the part, and counts, both as unsigned 32-bit integers.
    """
    each, bits = COUNTERS // PARTS, COUNTERS // SLOTS

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(cell: int, sums: np.ndarray) -> pa.RecordBatch:
            often = (sums >= least).reshape(-1, bits).any(axis=1)
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.packbits(often, bitorder="little").tobytes()], pa.binary())], ["cell", "bits"])

        now, sums = None, np.zeros(each, dtype=np.int64)
        for batch in batches:
            for cell, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if cell != now:
                    if now is not None:
                        yield row(now, sums)
                    now, sums = cell, np.zeros(each, dtype=np.int64)
                sums[np.frombuffer(places, "<u4")] += np.frombuffer(counts, "<u4")
        if now is not None:
            yield row(now, sums)

    dealt = counted.repartition("cell").sortWithinPartitions("cell")
    return _bits(counted.sparkSession, dealt.mapInArrow(marked, "cell int, bits binary").toArrow())


def _dealt(counters: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Distinct counters in order, and their counts, as one row for each part of the counters."""
    each = COUNTERS // PARTS
    cells = counters // np.uint32(each)
    edges = np.searchsorted(cells, np.arange(PARTS + 1))
    some = np.flatnonzero(np.diff(edges))
    rows = lambda x: pa.array([x[edges[i] : edges[i + 1]].astype("<u4").tobytes() for i in some], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), rows(counters % np.uint32(each)), rows(counts)], ["cell", "places", "counts"])


def _summed(counters: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct counters in order and how often each occurs."""
    if counts is not None:
        distinct, at = np.unique(counters, return_inverse=True)
        return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)
    counters = np.sort(counters)
    edges = np.flatnonzero(np.concatenate([[True], counters[1:] != counters[:-1], [True]])) if len(counters) else np.zeros(1, np.int64)
    return counters[edges[:-1]], np.diff(edges)


DEALT = "cell int, places binary, counts binary"


def _texts(words: np.ndarray) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _word_counts(texts: DataFrame) -> DataFrame:
    """Per language and word the number of its occurrences; the null word's is that of all words."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, places in _blocks(batches):
            places = places[places >= 0]
            n = np.bincount(places, minlength=len(words))
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(found) + 1)), pa.concat_arrays([_texts(words[found]), pa.nulls(1, pa.string())]),
                                              pa.array(np.append(n[found], len(places)))], ["lang", "word", "n"])

    return texts.mapInArrow(counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a"))


def _word_counters(words: DataFrame) -> DataFrame:
    """Counters of the words of ``lang, word``, each as often as ``a``."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, names = (np.array(batch.column(i).to_pylist(), dtype=object) for i in range(2))
            hashes = np.empty(batch.num_rows, dtype=np.uint64)
            for lang in set(langs):
                hashes[langs == lang] = _hashed(names[langs == lang], lang)
            yield _dealt(*_summed(_counters(hashes), np.minimum(batch.column(2).to_numpy(), 1 << 31)))

    return words.select("lang", F.col("word").cast("binary"), "a").mapInArrow(counts, DEALT)


def _run_counters(texts: DataFrame, frequent: Broadcast) -> DataFrame:
    """Counters of the runs of two and three frequent words."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, places in _blocks(batches):
            hashes = _hashed(words, lang)
            known = np.append(_has(frequent.value, hashes), False)[places]
            first = np.flatnonzero(known[:-1] & known[1:])
            pairs = _joined(hashes[places[first]], hashes[places[first + 1]])
            longer = first + 2 < len(places)
            longer[longer] = known[first[longer] + 2]
            triples = _joined(pairs[longer], hashes[places[first[longer] + 2]])
            yield _dealt(*_summed(np.concatenate([_counters(pairs), _counters(triples)])))

    return texts.mapInArrow(counts, DEALT)


def _added_up(blocks: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The windows of all blocks with equal ones added up; given out before the end where the distinct ones alone are half of ``HELD``."""

    def added(tables: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(tables).group_by(["lang", *WINDOW], use_threads=False).aggregate([("n", "sum")])
        return sums.rename_columns(["lang", *WINDOW, "n"])

    held, size = [], 0
    for table in blocks:
        held.append(table)
        size += table.nbytes
        if size > HELD:
            held = [added(held)]
            size = held[0].nbytes
            if size > HELD // 2:
                yield from held[0].to_batches(ROWS_OUT)
                held, size = [], 0
    if held:
        yield from added(held).to_batches(ROWS_OUT)


def _windows(texts: DataFrame, frequent: Broadcast, runs: Broadcast) -> DataFrame:
    """Per language the longest windows, each with its lead columns and number, null from the first rare word or run on."""

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for lang, words, places in _blocks(batches):
            hashes = _hashed(words, lang)
            known = np.append(_has(frequent.value, hashes), False)[places]
            first = np.flatnonzero(known[:-1] & known[1:])
            pairs = _joined(hashes[places[first]], hashes[places[first + 1]])
            often = _has(runs.value, pairs)
            first, pairs = first[often], pairs[often]
            # Whether a frequent pair, and a frequent triple, begins at a word.
            two, three = np.zeros(len(places) + LONGEST, dtype=bool), np.zeros(len(places) + LONGEST, dtype=bool)
            two[first] = True
            longer = two[first + 1]
            three[first[longer]] = _has(runs.value, _joined(pairs[longer], hashes[places[first[longer] + 2]]))
            if not len(first):
                continue
            lead, key, going = [places[first]], places[first], np.ones(len(first), dtype=bool)
            for k in range(1, LONGEST):
                going = going & (two[first] if k == 1 else three[first + k - 2])
                lead.append(np.where(going, places[np.minimum(first + k, len(places) - 1)], -1))
                key = pd.factorize(key * (len(words) + 1) + lead[-1] + 1)[0]
            # One row for each distinct window of the block.
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            text = _texts(words)
            columns = [text.take(pa.array(c[at], mask=c[at] < 0)) for c in lead]
            yield pa.Table.from_arrays([pa.array([lang] * len(at)), *columns, pa.array(n)], ["lang", *WINDOW, "n"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _added_up(of_blocks(batches))

    kinds = ", ".join(f"{w} string" for w in WINDOW)
    dealt = texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(counts, f"lang string, {kinds}, n long").groupBy("lang", *WINDOW).agg(F.sum("n").alias("n"))


def _marginal(windows: DataFrame, least: int) -> DataFrame:
    """Count of every phrase of two words up to the whole window, by rolling the window's columns up.

    On each level the last column that is left must hold a word: a row whose
    last column is null is a window that is shorter than the level.
    """
    sums = windows.rollup("lang", *WINDOW).agg(F.sum("n").alias("a"), F.grouping_id().alias("rolled"))
    length = F.lit(None).cast("int")
    for k in range(2, LONGEST + 1):
        length = F.when((F.col("rolled") == (1 << (LONGEST - k)) - 1) & F.col(WINDOW[k - 1]).isNotNull(), k).otherwise(length)
    sums = sums.where(F.col("a") >= least).withColumn("words", length).where("words IS NOT NULL")
    return sums.select("lang", "words", F.concat_ws(" ", *WINDOW).alias("phrase"), F.array_compact(F.array(*WINDOW)).alias("parts"), "a")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, share: int = 100, best: int = 2000) -> DataFrame:
    """Each language's ``best`` phrases of two to five words that occur ``least`` times or more.

    A phrase's score is the lowest, over its cuts in two, of 1000 times the
    ratio of its count to the one its parts' counts let expect, rounded down. A
    phrase is left out if a longer one that holds it occurs at least ``share``
    percent as often. Returns ``lang`` (``und`` where null), ``rank``,
    ``phrase``, its count ``a``, its parts' counts ``l`` and ``r``, the
    language's words ``n`` and ``score``. Counts are exact, and so is the
    score: products are decimals of 38 digits.
    """
    texts = small_batches(docs).select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), whole(text).cast("binary").alias("text"))
    counts = _word_counts(texts)
    counts = written(counts.where((F.col("a") >= least) | F.col("word").isNull()), "words")
    words = counts.where("word IS NOT NULL")
    totals = counts.where("word IS NULL").select("lang", F.col("a").alias("n"))
    frequent = _frequent(_word_counters(words), least)
    runs = _frequent(_run_counters(texts, frequent), least)
    phrases = written(_marginal(_windows(texts, frequent, runs), least), "phrases")

    known = written(phrases.select("lang", "phrase", "a").unionByName(words.select("lang", F.col("word").alias("phrase"), "a")), "counts")
    part = lambda begin, size: F.array_join(F.slice("parts", begin, size), " ")
    cuts = phrases.select("lang", "phrase", "a", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("parts") - F.col("cut")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        cuts = joined(cuts, known.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    cuts = joined(cuts, totals, ["lang"])
    lowest = F.min(F.struct(F.expr(EXACT).cast("long").alias("score"), "cut", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest.alias("cut"))

    # A phrase that holds another holds one that is longer by one word and at least as frequent as itself.
    inside = phrases.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(F.array(
        part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (
        F.lit(100).cast("decimal(20)") * F.col("longer") < F.lit(share).cast("decimal(18)") * F.col("a")))
    order = W.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
                         F.col("cut.score").alias("score"))
