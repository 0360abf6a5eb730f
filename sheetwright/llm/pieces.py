"""SentencePiece encoding of merge models by backtracking, and decoding.

A merge model joins the best-scored neighbouring pair again and again. Its
result is the only sequence of pieces in which every two neighbours would be
left as they are if they were merged alone. So pieces can be chosen from left
to right: the longest piece that starts here (all matches come from one
Aho-Corasick pass), if merging it with the piece before gives just these two;
else the next shorter one; and where none is left, the position is marked in a
bit field and the piece before is taken back. Characters that the model lacks
become their bytes.

Whether two pieces stay apart is told without merging strings: for every piece
the model's tables hold what its own merging leaves at its edges step by step,
and with which score the next step comes. Two pieces are merged again by going
through both lists, the better step first; they do not stay apart if at some
moment the two symbols that meet make a piece of a better score than both steps.

No piece runs into the space after it, so texts are cut there, and a task keeps
the ids of words it has met. Words that it has not met are taken together, those
of ``AT_ONCE`` words of text at a time: pieces are matched, chosen and taken back
in all of them at once, one step after the other, in arrays. Words of more than
``LONGEST_KEPT`` characters are cut also where no piece goes on, such as between
a letter and others; cuts that are still longer are gone through alone. The
tables are made once, on the driver, and sent to the executors; their size is
the vocabulary's.

Cases: a null text is an empty one; the empty text has only the ids for begin
and end; texts are taken whole at any length; other columns are carried along.
A model that changes texts before encoding them in other ways than marking
spaces, or is none of merges, is refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from .tables import small_batches

SPACE = "▁"
KEPT = 300_000  # encoded words kept by a task, and pairs checked in long cuts
PAIRS = 1 << 18  # places for pairs checked in words that go together
LONGEST_KEPT = 64
AT_ONCE = 1 << 16
SPACED = re.compile(" *[^ ]+| +")
LAST = float("-inf")  # no step follows
# Texts by which a model is known to be of the kind that is encoded here.
PROBES = ("a", " a", "a  b ", "\n\ta", "The quick brown fox, 1234.5!", "ﬁnal Å ½ ｆｕｌｌ", "e\u0301\u200b\u00ad", "ñandú größer ça", "▁x ▁ y", "\U0001f600 中文字")


def keep(table: dict) -> dict:
    """``table``, emptied when it is full."""
    if len(table) >= KEPT:
        table.clear()
    return table


class Pieces:
    """A merge model read from a file: its pieces, scores and byte pieces."""

    def __init__(self, path: str):
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        self.byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        usual = [i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.text = {i: m.id_to_piece(i) for i in usual}
        self.id = {t: i for i, t in self.text.items()}
        self.score = {t: m.get_score(i) for i, t in self.text.items()}
        self.single = {t for t in self.id if len(t) == 1}
        # Only pieces that merging their own characters gives can occur.
        histories = {t: self._history(t) for t in self.id}
        sound = {t: self.id[t] for t, steps in histories.items() if steps[-1][0] == t}
        # What a piece's merging leaves at its end or beginning, each with the score of the next step.
        edges = lambda t, side: [(self.id[x[side]], after[2]) for x, after in zip(histories[t], [*histories[t][1:], (None, None, LAST)])]
        self.first = {i: edges(t, 0) for t, i in sound.items()}
        self.last = {i: edges(t, 1) for t, i in sound.items()}
        self.joins = {self.id[t[:n]] << 32 | self.id[t[n:]]: self.score[t]
                      for t in self.id for n in range(1, len(t)) if t[:n] in sound and t[n:] in sound}
        self.size = {i: len(t) for t, i in sound.items()}
        self.shorter = {i: next((sound[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in sound), None) for t, i in sound.items()}
        self.found = ahocorasick.Automaton()
        for t, i in sound.items():
            self.found.add_word(t, i)
        self.found.make_automaton()
        self.pair: dict[int, bool] = {}
        self.cuts = self._cuts()
        self.word: dict[str, bytes] = {}
        self.checked: np.ndarray | None = None
        self._arrays(len(every))
        self._automaton(sound)

    def _arrays(self, n: int) -> None:
        """The tables once more, as arrays by id."""
        used = {c for t in self.id for c in t}
        self.gap = next(c for c in map(chr, range(1, 0x110000)) if c not in used)
        self.of_char = np.full(max(map(ord, {*used, self.gap})) + 2, -1, dtype=np.int32)
        for t in self.single:
            self.of_char[ord(t)] = self.id[t]
        self.of_byte = np.array(self.byte_ids, dtype=np.int32)
        self.sizes, self.shorters = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int32)
        for i, size in self.size.items():
            self.sizes[i], self.shorters[i] = size, -1 if self.shorter[i] is None else self.shorter[i]

        def flat(edges: dict[int, list[tuple[int, float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Where each piece's steps begin, and of all steps the edge and the score of the next."""
            begin = np.zeros(n + 1, dtype=np.int64)
            for i, steps in edges.items():
                begin[i + 1] = len(steps)
            every = [step for i in sorted(edges) for step in edges[i]]
            return begin.cumsum(), np.array([x for x, _ in every], dtype=np.int64), np.array([after for _, after in every])

        self.lasts, self.firsts = flat(self.last), flat(self.first)
        self.meeting, self.meeting_score = pd.Index(np.array([*self.joins], dtype=np.int64)), np.array([*self.joins.values(), LAST])

    def _automaton(self, sound: dict[str, int]) -> None:
        """The Aho-Corasick automaton of pieces of two characters or more as arrays: steps, failures and the next match that ends here."""
        node, steps = {"": 0}, {}
        for t in sound:
            for n, c in enumerate(t):
                steps[node[t[:n]] << 21 | ord(c)] = node.setdefault(t[: n + 1], len(node))
        self.step, self.stepped = pd.Index(np.array([*steps], dtype=np.int64)), np.array([*steps.values(), 0])
        self.fail, self.ending, self.after = np.zeros(len(node), dtype=np.int64), np.full(len(node), -1, dtype=np.int32), np.zeros(len(node), dtype=np.int64)
        for t in sorted(node, key=len):
            fail = next((node[t[n:]] for n in range(1, len(t)) if t[n:] in node), 0)
            self.fail[node[t]] = fail
            if len(t) > 1 and t in sound:
                self.ending[node[t]] = sound[t]
            self.after[node[t]] = fail if self.ending[fail] >= 0 else self.after[fail]

    def _cuts(self) -> re.Pattern:
        """Pattern whose matches cover a text and end where no piece goes on.

        Texts are cut before space marks, and between letters and others.
        Letters that some piece has next to others, such as a raised two and
        a full stop, count as others. A model for which this does not hold is
        cut only before space marks, one whose pieces run over them nowhere.
        """
        bare = [t.lstrip(SPACE) for t in self.id]
        if any(SPACE in t for t in bare):
            return re.compile(r"(?s).+")
        mixed = [t for t in bare if not re.fullmatch(r"[^\W\d_]*|[\W\d_]*", t)]
        joining = "".join(sorted({c for t in mixed for c in t if re.fullmatch(r"[^\W\d_]", c)}))
        letter = rf"[^\W\d_{re.escape(joining)}]"
        if any(re.search(letter, t) and not re.fullmatch(f"{letter}+", t) for t in bare):
            return re.compile(f"(?s){SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(rf"{SPACE}*{letter}+|{SPACE}*(?:[^\w{SPACE}]|[\d_{re.escape(joining)}])+|{SPACE}+")

    def _history(self, text: str) -> list[tuple[str, str, float]]:
        """First part, last part and score of each step of merging as defined: the best-scored pair, of equal ones the leftmost.

        The first row is the text's single characters.
        """
        parts = list(text)
        steps = [(parts[0], parts[-1], 0.0)]
        while len(parts) > 1:
            pairs = [(s, -i) for i in range(len(parts) - 1) if (s := self.score.get(parts[i] + parts[i + 1])) is not None]
            if not pairs:
                break
            score, i = max(pairs)
            parts[-i : 2 - i] = [parts[-i] + parts[1 - i]]
            steps.append((parts[0], parts[-1], score))
        return steps

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' characters gives just these two."""
        left, right, joins, i, j = self.last[a], self.first[b], self.joins, 0, 0
        while True:
            (x, step), (y, other) = left[i], right[j]
            meeting = joins.get(x << 32 | y)
            if meeting is not None and meeting > step and meeting >= other:
                return False
            if step >= other:
                if step == LAST:
                    return True
                i += 1
            else:
                j += 1

    def _fits(self, a: int, b: int) -> bool:
        known = keep(self.pair)[a << 32 | b] = self._apart(a, b)
        return known

    def _run(self, s: str) -> list[int]:
        """Ids of a run of characters that are all pieces."""
        size, shorter, pair, n = self.size, self.shorter, self.pair, len(s)
        longest = [0] * n
        for end, i in self.found.iter(s):
            longest[end + 1 - size[i]] = i  # later matches of a start are longer
        dead = bytearray(n // 8 + 1)
        ids: list[int] = []
        at, last, piece = 0, None, longest[0]
        while at < n:
            while piece is not None:
                end = at + size[piece]
                if not dead[end >> 3] >> (end & 7) & 1:
                    if last is None:
                        break
                    fits = pair.get(last << 32 | piece)
                    if fits or fits is None and self._fits(last, piece):
                        break
                piece = shorter[piece]
            if piece is None:
                dead[at >> 3] |= 1 << (at & 7)
                gone = ids.pop()
                at, piece, last = at - size[gone], shorter[gone], ids[-1] if ids else None
            else:
                ids.append(piece)
                at, last = end, piece
                piece = longest[at] if at < n else None
        return ids

    def _all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_apart`` of many pairs; a place keeps the pair last checked of those that have it."""
        if self.checked is None:
            self.checked = np.full(PAIRS, -1, dtype=np.int64)
        pair = a.astype(np.int64) << 32 | b
        place = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - PAIRS.bit_length())).astype(np.int64)
        known = self.checked[place]
        apart = known & 1 == 1
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            apart[new] = self._compared(a[new], b[new])
            self.checked[place[new]] = pair[new] << 1 | apart[new]
        return apart

    def _compared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (at, left, left_step), (of, right, right_step) = self.lasts, self.firsts
        apart, open_, i, j = np.ones(len(a), dtype=bool), np.arange(len(a)), at[a], of[b]
        while len(open_):
            step, other = left_step[i], right_step[j]
            meeting = self.meeting_score[self.meeting.get_indexer(left[i] << 32 | right[j])]  # the last score is for those that make no piece
            joined = (meeting > step) & (meeting >= other)
            apart[open_[joined]] = False
            lefts = step >= other
            on = ~(joined | lefts & (step == LAST))
            i, j, open_ = (i + lefts)[on], (j + ~lefts)[on], open_[on]
        return apart

    def _ids_of(self, codes: np.ndarray) -> np.ndarray:
        """The pieces that single characters are, -1 for none."""
        return self.of_char[np.minimum(codes, len(self.of_char) - 1)]

    def _longest(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The longest piece that starts at each character of the runs of ``codes``."""
        longest, order = self._ids_of(codes), np.argsort(-length)
        ends, node = begin[order], np.zeros(len(begin), dtype=np.int64)
        for n in range(int(length.max(initial=0))):
            alive = int(np.searchsorted(-length[order], -n))
            node, at = node[:alive], ends[:alive] + n
            code, left = codes[at].astype(np.int64), np.arange(alive)
            while len(left):
                found = self.step.get_indexer(node[left] << 21 | code[left])
                go = (found >= 0) | (node[left] == 0)
                node[left] = np.where(go, self.stepped[found], self.fail[node[left]])
                left = left[~go]
            match = np.where(self.ending[node] >= 0, node, self.after[node])
            while len(some := np.flatnonzero(match)):
                match, at = match[some], at[some]
                ids = self.ending[match]
                longest[at + 1 - self.sizes[ids]] = ids  # later matches of a start are longer
                match = self.after[match]
        return longest

    def _runs(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_run`` of many runs of ``codes``, a step in all of them at a time. Each is followed by a character that is no piece.

        Returns an array in which a run's pieces stand from its begin on, and their numbers.
        """
        longest = self._longest(codes, begin, length)
        ids, dead, chosen, stop = np.zeros(len(codes), dtype=np.int32), np.zeros(len(codes), dtype=bool), length.copy(), begin + length
        run, at, top, piece, last = np.arange(len(begin)), begin, begin, longest[begin], np.full(len(begin), -1, dtype=np.int32)
        while len(run):
            back = piece < 0
            end = np.where(back, at, at + self.sizes[piece])
            fits = ~(back | dead[end])
            second = np.flatnonzero(fits & (last >= 0))
            fits[second] = self._all_apart(last[second], piece[second])
            ids[top[fits]] = piece[fits]
            dead[at[back]] = True
            # The piece taken back is the last one.
            top = top + fits - back
            at = np.where(back, at - self.sizes[last], np.where(fits, end, at))
            piece = np.where(fits, longest[at], self.shorters[np.where(back, last, piece)])
            last = np.where(fits | back, np.where(top > begin[run], ids[top - 1], -1), last)
            on = at < stop[run]
            if not on.all():
                chosen[run[~on]] = (top - begin[run])[~on]
                run, at, top, piece, last = run[on], at[on], top[on], piece[on], last[on]
        return ids, chosen

    def _together(self, strings: list[str], before: str = "") -> list[bytes]:
        """``_cut`` of many strings, with ``before`` put before each."""
        if not strings:
            return []
        codes = np.frombuffer("".join([before, f"{self.gap}{before}".join(strings), self.gap]).replace(" ", SPACE).encode("utf-32-le"), "<u4")
        after = np.cumsum(np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) + len(before) + 1)
        usual, gap = self._ids_of(codes) >= 0, np.zeros(len(codes), dtype=bool)
        gap[after - 1] = True
        edges = np.diff(usual.astype(np.int8), prepend=0)
        begin = np.flatnonzero(edges == 1)
        ids, chosen = self._runs(codes, begin, np.flatnonzero(edges == -1) - begin)
        # How many ids stand for each place: one where a piece stands, the bytes of a character that the model lacks.
        held = np.zeros(len(codes), dtype=np.int64)
        held[begin] = 1
        held[begin + chosen] -= 1
        held = np.cumsum(held)
        lacking = ~(usual | gap)
        held[lacking] = 1 + sum((codes[lacking] >= least).astype(np.int64) for least in (0x80, 0x800, 0x10000))
        flat = np.repeat(ids, held)
        flat[np.repeat(lacking, held)] = self.of_byte[np.frombuffer(codes[lacking].tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)]
        stops = (4 * np.cumsum(held)[after - 1]).tolist()
        out = flat.astype("<u4").tobytes()
        return [out[i:end] for i, end in zip([0, *stops], stops)]

    def _cut(self, s: str) -> bytes:
        if self.single.issuperset(s):
            return array("I", self._run(s)).tobytes()
        out: list[int] = []
        for known, part in groupby(s, self.single.__contains__):
            run = "".join(part)
            out += self._run(run) if known else [self.byte_ids[b] for b in run.encode("utf-8")]
        return array("I", out).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of ``words`` that are not known, each after one space, into ``word``."""
        new = [w for w in words if w not in self.word]
        if len(self.word) + len(new) > KEPT:
            self.word.clear()
            new = list(words)
        short = [w for w in new if len(w) <= LONGEST_KEPT]
        self.word.update(zip(short, self._together(short, SPACE)))
        for w in new if len(short) < len(new) else ():
            if len(w) > LONGEST_KEPT:
                cuts = self.cuts.findall(SPACE + w.replace(" ", SPACE))
                short = [c for c in set(cuts) if len(c) <= LONGEST_KEPT]
                known = dict(zip(short, self._together(short))) | {c: self._cut(c) for c in set(cuts) if len(c) > LONGEST_KEPT}
                self.word[w] = b"".join([known[c] for c in cuts])

    def _words(self, text: str) -> list[str]:
        """The parts of ``text`` that stand after one space each; further spaces before a word are its own."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if text[0] == " " or "  " in text:
            return [w[1:] for w in SPACED.findall(" " + text)]
        return text.split(" ")

    def _of_words(self, texts: list[list[str]]) -> Iterator[bytes]:
        words = set().union(*texts)
        self._learn(words)
        for text in texts:
            yield b"".join(map(self.word.__getitem__, text))
        for w in words:
            if len(w) > LONGEST_KEPT:
                del self.word[w]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Of each text the ids as 32-bit integers, without begin and end."""
        waiting, n = [], 0
        for text in texts:
            words = self._words(text)
            if n + len(words) > AT_ONCE:
                yield from self._of_words(waiting)
                waiting, n = [], 0
            if len(words) > AT_ONCE:
                yield b"".join(ids for i in range(0, len(words), AT_ONCE) for ids in self._of_words([words[i : i + AT_ONCE]]))
            else:
                waiting.append(words)
                n += len(words)
        yield from self._of_words(waiting)

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers, without begin and end."""
        return next(self.encode_all([text]))


def _tables(docs: DataFrame, path: str) -> Broadcast:
    """The model's tables, checked against the library, for all executors."""
    pieces = Pieces(path)
    for probe in PROBES:
        if np.frombuffer(pieces.encode(probe), "<u4").tolist() != pieces.model.encode(probe):
            raise ValueError(f"{path} is not a merge model that takes texts as they are")
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(pieces))


def encoded(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, the text's ids between begin and end, as binary of little-endian unsigned 32-bit integers.

    ``path`` is the model's file. ``keep`` names the columns
    carried along, all by default; one called ``ids`` is replaced.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c != "ids"]
    tables = _tables(docs, path)

    def over(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = cloudpickle.loads(tables.value)
        first, last = (array("I", [i]).tobytes() for i in (pieces.model.bos_id(), pieces.model.eos_id()))
        for texts in batches:
            yield pd.Series([first + ids + last for ids in pieces.encode_all(t or "" for t in texts)], dtype=object)

    over.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return small_batches(docs).select(*[F.col(f"`{c}`") for c in carried], F.pandas_udf(over, "binary")(F.col(f"`{text}`")).alias("ids"))


def decoded(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text that the model's own decoding gives for the ids."""

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def over(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.decode(np.frombuffer(b, "<u4").tolist()) for b in batch], dtype=object)

    over.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return small_batches(rows).withColumn(into, F.pandas_udf(over, "string")(F.col(f"`{ids}`")))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids and the digests of ids and decoded text.

    Encodes and decodes in one pass. A task holds the words of texts that have
    ``AT_ONCE`` words together, or of one longer text, and the ids of one text.
    """
    tables = _tables(docs, path)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = cloudpickle.loads(tables.value)
        first, last = (array("I", [i]).tobytes() for i in (pieces.model.bos_id(), pieces.model.eos_id()))
        for batch in batches:
            out = []
            for ids in pieces.encode_all(t.as_py() or "" for t in batch.column(1)):
                ids = first + ids + last
                text = pieces.model.decode(np.frombuffer(ids, "<u4").tolist())
                out.append((len(ids) // 4, sha256(ids).hexdigest(), sha256(text.encode()).hexdigest()))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()))]],
                                             [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(key, text).mapInArrow(over, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
