"""Phrases, source divergence and benchmark passages against plain restatements."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheetwright.llm import decontamination, divergence, phrases

DOCS = "doc_id long, text string, lang string, source string"
# Names that the operators use inside, as extra columns.
EXTRA = ", row string, n long, term string, w1 string, spans string, items string, part string, a string, lang_total string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_extra(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, "t", "w", "s", "i", "p", "a", "l") for r in rows], DOCS + EXTRA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = "the of Big dog ran ÄPFEL été 中文 x1 l'eau a".split()
    texts = []
    for _ in range(120):
        out = []
        for _ in range(rng.randint(0, 40)):
            out.append(rng.choice(["new york city hall", "of the", *words, *words]))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; ", " ", " "]))
        texts.append("".join(out))
    texts += [texts[3], texts[3], "", None, " \t", "...", "one", "the big dog ran " * 3000]
    langs, sources = ["en", "en", "en", "fr", None, "und", ""], ["s1", "s1", "s2", "s3", None, "", "only"]
    out = [(i, t, rng.choice(langs), rng.choice(sources)) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "null id of the big dog", "en", "s9"), (900, None, "xx", "lonely"), (901, "rare words here", "yy", "a"), (902, None, "yy", "b")]


def plain_collocations(rows, least, share, best):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = []
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            score, cut = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best])]
    return sorted(out)


@pytest.mark.parametrize("least,share,best,block", [(5, 100, 2000, 8_000_000), (5, 80, 7, 300), (1, 100, 50, 40)])
def test_collocations(spark, rows, least, share, best, block, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", block)
    out = phrases.collocations(with_extra(spark, rows), least=least, share=share, best=best)
    assert sorted(map(tuple, out.collect())) == plain_collocations(rows, least, share, best)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_stay_right_when_every_counter_is_shared(spark, rows, monkeypatch):
    """Few counters let nearly everything look frequent; the counts stay the same."""
    monkeypatch.setattr(phrases, "COUNTERS", 1 << 13)
    monkeypatch.setattr(phrases, "SLOTS", 1 << 13)
    out = phrases.collocations(with_extra(spark, rows), least=20)
    assert sorted(map(tuple, out.collect())) == plain_collocations(rows, 20, 100, 2000)


@pytest.mark.parametrize("held", [1 << 26, 3000, 1])
def test_windows_of_many_blocks_are_added_up_in_their_task(spark, rows, held, monkeypatch):
    """Each core's task gives a window out once, and in more rows only where it cannot hold them; the result stays the same."""
    monkeypatch.setattr(phrases, "BLOCK", 300)
    monkeypatch.setattr(phrases, "HELD", held, raising=False)
    kind = type(spark.range(1))
    given, plain = [], kind.mapInArrow

    def recorded(df, function, schema, *args):
        out = plain(df, function, schema, *args)
        if schema.startswith("lang string, w1"):
            given.append((df.rdd.getNumPartitions(), out.count(), out.select("lang", *phrases.WINDOW).distinct().count()))
        return out

    monkeypatch.setattr(kind, "mapInArrow", recorded)
    out = phrases.collocations(with_extra(spark, rows).repartition(64), least=5)
    assert sorted(map(tuple, out.collect())) == plain_collocations(rows, 5, 100, 2000)
    (tasks, windows, distinct), = given
    assert tasks <= spark.sparkContext.defaultParallelism
    assert distinct <= windows and (held < 1 << 26 or windows <= tasks * distinct)


def test_equal_windows_are_given_out_once(monkeypatch):
    block = pa.table({"lang": ["en"] * 3, **{w: pa.array(["a", "a", "b"] if w < "w3" else [None, "c", None], pa.string()) for w in phrases.WINDOW}, "n": [1, 2, 3]})
    for held, times in ((1 << 26, 1), (3 * block.nbytes, 1), (1, 50)):
        monkeypatch.setattr(phrases, "HELD", held)
        out = pa.Table.from_batches(phrases._added_up(iter([block] * 50)))
        assert out.num_rows == 3 * times and sum(out["n"].to_pylist()) == 300 and len({tuple(r.values())[:-1] for r in out.to_pylist()}) == 3


def test_products_beyond_64_bits(spark):
    """a, n, l and r as they may be on 100 TB."""
    row = spark.range(1).select(F.lit(9 * 10**12).alias("a"), F.lit(2 * 10**13).alias("n"), F.lit(10**13).alias("l"), F.lit(9 * 10**12).alias("r"))
    assert row.select(F.expr(phrases.EXACT)).first()[0] == 1000 * 9 * 10**12 * 2 * 10**13 // (10**13 * 9 * 10**12) == 2000
    odd = row.withColumn("a", F.lit(10**12 + 7)).withColumn("r", F.lit(3 * 10**12 + 1)).withColumn("l", F.lit(10**12 + 9))
    assert odd.select(F.expr(phrases.EXACT)).first()[0] == 1000 * (10**12 + 7) * 2 * 10**13 // ((10**12 + 9) * (3 * 10**12 + 1))


def plain_divergence(rows, documents, best):
    uses, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        groups.add((lang, source))
        uses[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, d in seen[lang].items() if d >= documents]
        sources = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: uses[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(uses[lang, s]) for s in sources}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:best])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("documents,best,block,places", [(10, 10, 8_000_000, 1_000_000), (2, 3, 200, 7), (10_000, 10, 50, 1)])
def test_divergence(spark, rows, documents, best, block, places, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "PLACES", places)
    out = divergence.divergence(with_extra(spark, rows), documents=documents, best=best)
    assert sorted(map(tuple, out.collect())) == plain_divergence(rows, documents, best)


def plain_contaminated(rows, tests):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    windows = defaultdict(set)
    for item, text in tests:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    out = []
    for doc, text, *_ in rows:
        w, hit, items = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    items |= found
        out.append((doc, len(w), sorted(hit), sorted((str(i) for i in items if i is not None))))
    return sorted(out, key=str)


def seen(found):
    return sorted(((r.row.doc_id, r.n_words, [j for s in r.spans for j in range(s.start, s.end)], list(r["items"])) for r in found.collect()), key=str)


@pytest.fixture(scope="module")
def tests(rows):
    rng = random.Random(5)
    long = [t.translate(UPPER).split() for _, t, *_ in rows if t and len(t.split()) > 25]
    some = [" ".join(t[k : k + rng.choice([10, 11, 14, 25])]) for t in rng.sample(long, 12) for k in [rng.randint(0, 10)]]
    return [*enumerate(some), (20, some[0]), (20, some[0]), (21, some[1] + " the END"), (22, "Dog ran"), (23, "éTÉ"), (24, "x1"), (25, None), (26, "..."), (None, "big dog ran"),
            (27, "no document holds these ten words in this order ever"), (28, "the big dog ran " * 40)]


@pytest.mark.parametrize("part,lane,block,piece", [(500_000, 256, 4_000_000, 1_000), (60, 3, 9, 4)])
def test_contaminated(spark, rows, tests, part, lane, block, piece, monkeypatch):
    for name, value in (("LANE", lane), ("BLOCK", block), ("PIECE", piece)):
        monkeypatch.setattr(decontamination, name, value)
    known = spark.createDataFrame([(i, t, "x", "y") for i, t in tests], "item_id long, text string, words string, item string")
    found = decontamination.contaminated(with_extra(spark, rows), known, ["doc_id", "row", "spans"], part=part)
    assert seen(found) == plain_contaminated(rows, tests)
    assert found.columns == ["row", "n_words", "spans", "items"] and found.first().row.spans == "s"


def test_no_tests_and_short_tests_only(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert seen(decontamination.contaminated(with_extra(spark, rows), none, ["doc_id"])) == plain_contaminated(rows, [])
    one = spark.createDataFrame([(1, "dog")], "item_id long, text string")
    assert seen(decontamination.contaminated(with_extra(spark, rows), one, ["doc_id"])) == plain_contaminated(rows, [(1, "dog")])


def test_skipping_looks_at_few_positions(spark):
    """Where no block of a text is in a test string, the search moves on by nearly a whole one."""
    import pyarrow as pa

    tests = decontamination.Tests(pa.table({"item": ["a"], "words": [[f"t{i}" for i in range(30)]]}))
    (strings,) = tests.sizes
    assert strings.size == 10 and strings.shifts.max() == 9
    known = [tests.words[f"t{i}".encode()] for i in range(30)]
    assert strings.shifts[decontamination._blocks(*(tests.numbers(b"t0 t1")[0][i : i + 1] for i in range(2)))] == 8
    assert strings.shifts[decontamination._blocks(*(tests.numbers(b"t8 t9")[0][i : i + 1] for i in range(2)))] == 0 and len(known) == 30


def test_empty_tables(spark, rows):
    none = with_extra(spark, rows[:1]).limit(0)
    assert phrases.collocations(none).isEmpty() and divergence.divergence(none).isEmpty()
    tests = spark.createDataFrame([(1, "dog")], "item_id long, text string")
    assert decontamination.contaminated(none, tests, ["doc_id"]).isEmpty()
