"""The operators against plain restatements, and their stated cases."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sheetwright.llm import chat, extract, graph, hamming, language, minhash, mixing, pieces, privacy, quality, sampling, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside, as extra columns.
EXTRA = ", row string, rid long, size string, kept string, ids string, host string, score string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = [a + b for a in "ka mi to re sun lo pe".split() for b in "ra di no be lak".split()]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts += [texts[5], texts[5], texts[6] + " more", None, "", " \n\t", "x" * 5000, "one two", "one two", ("a b c d e f g h " * 30)]
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 4}", 0) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "null id here", None, "s1", None)]
    df = spark.createDataFrame([(*r, "r", 1, "z", "k", "i", "h", "sc") for r in rows], DOCS + EXTRA)
    return df.cache()


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_quality_measures(docs):
    for r in quality.judge(docs).collect():
        t = next(x.text for x in docs.collect() if x.doc_id == r.doc_id) or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))


def test_bad_host_is_rejected_with_its_good_documents(spark):
    good, bad = prose(random.Random(1), 60), "short"
    rows = [(i, good, "en", f"h{i % 9}", 0) for i in range(180)] + [(500 + i, bad if i < 19 else good, "en", "worst", 0) for i in range(20)]
    rows += [(900, bad, "en", "tiny", 0), (901, good, "en", None, 0)]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not out[519].base_failed and not out[519].kept and out[0].kept and out[901].kept
    assert out[900].host_rate < 1.0


def test_quality_stage_keeps_rows_as_they_are(docs, none):
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.accepted(none).count() == 0


def brute_classes(rows, threshold=0.8):
    sets = []
    for r in rows:
        w = (r.text or "").lower().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    parent = list(range(len(rows)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = sum((sets[i] & sets[j]).values())
                if both >= threshold * (sum(sets[i].values()) + sum(sets[j].values()) - both):
                    parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near_copies(seed):
    rng, rows = random.Random(seed), []
    for g in range(6):
        words = prose(rng, 150).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    return rows


@pytest.mark.parametrize("part_texts", [1024, 5])
def test_classes_match_all_pairs(spark, monkeypatch, part_texts):
    monkeypatch.setattr(minhash, "PART_TEXTS", part_texts)
    df = spark.createDataFrame(near_copies(4), DOCS)
    found = minhash.near_duplicates(df).collect()
    rows = df.collect()
    want, got = defaultdict(set), defaultdict(set)
    for r, c in zip(rows, brute_classes(rows)):
        want[c].add(r.doc_id)
    for r in found:
        got[r.class_id].add(r.doc_id)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))
    assert all(r.class_size == len(got[r.class_id]) for r in found)


def test_first_of_each_class(docs, none):
    out = minhash.first_of_each(docs)
    rows = out.collect()
    assert out.columns == docs.columns
    assert sum(r.text == "one two" for r in rows) == 1 and sum(r.text in (None, "", " \n\t") for r in rows) == 3
    assert minhash.first_of_each(none).count() == 0 and minhash.near_duplicates(none).count() == 0


def test_signature_agrees_as_weighted_jaccard():
    rng = np.random.default_rng(5)
    for a, b in (([1] * 40 + [0] * 10, [1] * 50), ([5, 1, 1, 9], [1, 5, 1, 9]), ([0.3] * 9, [0.2] * 9)):
        a, b, same = np.array(a, float), np.array(b, float), []
        for _ in range(20):
            h = rng.integers(0, 2**63, len(a)).astype(np.uint64)
            same.append(np.mean(minhash.signature(h[a > 0], a[a > 0], 140) == minhash.signature(h[b > 0], b[b > 0], 140)))
        assert abs(np.mean(same) - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    out = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(out[i] == 0 for i in range(1, 41)) and out[95] == out[100] == 90 and 7 in out


HARD = ["a@b.c_d@e.f ü x@y.z. 1.2.3.4.5 999.1.1.1 é q@q.q.q.", "+1 (319) 555-5132 then 4111 1111 1111 1111, 10.0.0.255", "a@" * 300 + "b.c", "1" * 3000, None, "", "+49 30 1234567 +1"]


def brute_spans(t):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for no, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, t or ""):
            d = re.sub(r"\D", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_spans(spark):
    rng = random.Random(2)
    texts = HARD + ["".join(rng.choice(["1.2", ".", "@", "a", "+4", " ", "55-", "12345678", "b.c"]) for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in privacy.find(df).select("row.doc_id", privacy.listed(F.col("base")).alias("b")).collect():
        assert r.b == brute_spans(texts[r.doc_id]), texts[r.doc_id]


def test_terms_that_tell_a_value_are_hidden(spark):
    rows = [(i, f"the account of Zorblax is x{9}@mail.org today {i}") for i in range(4)] + [(10 + i, "the account of others is open today") for i in range(40)]
    rows += [(60, "Zorblax without address"), (61, None)]
    out = {r.doc_id: r.text for r in privacy.sanitised(spark.createDataFrame(rows, "doc_id long, text string"), privacy.Disclosure(disclosure=0.8)).collect()}
    assert out[0] == "the account of [term] is [email] today 0"
    assert out[10] == rows[4][1] and out[60] == "Zorblax without address" and out[61] is None


def test_privacy_cases(docs, none):
    out = privacy.sanitised(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert privacy.sanitised(none).count() == 0 and privacy.find(none).count() == 0


def brute_targets(size, weights=(3, 1, 2)):
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(w[s] for s in names if s not in full)
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / rest if rest else 0
        new = {s for s in names if s not in full and w[s] * level > 2 * size[s]}
        if not new:
            return {s: 2 * size[s] if s in full else w[s] * level for s in names}
        full |= new


@pytest.mark.parametrize("shard_rows", [5000, 7])
def test_mix(docs, none, shard_rows):
    mix = mixing.Mix(shard_rows=shard_rows, block_words=4)
    rows = mixing.mixed(docs, mix).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(size)
    for r in rows:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 4 * (2 + 60 / shard_rows) for s in size)
    again = mixing.mixed(docs.repartition(5), mix).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixed(none).count() == 0 and mixing.repeated(docs).columns == docs.columns


def test_apportionment_is_by_highest_quotients(spark):
    rng = random.Random(8)
    rows = [(g, i, float(rng.choice([0, 1, 5, 20, 300]))) for g in range(8) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "g int, i int, w double").withColumn("seats", F.lit(37).cast("long"))
    got = {(r.g, r.i): r.n for r in mixing.apportion(df, ["g"], ["i"], "w", "seats", "n").collect()}
    for g in range(8):
        items = {i: w for gg, i, w in rows if gg == g}
        seats = dict.fromkeys(items, 0)
        for _ in range(37 if any(items.values()) else 0):
            best = max(items, key=lambda i: (items[i] / (2 * seats[i] + 1), -i))
            seats[best] += 1
        assert {i: got[g, i] for i in items} == seats


def test_pieces_as_the_library():
    p, rng = pieces.Pieces(MODEL), random.Random(6)
    vocabulary = list(p.id)
    odd = [" ", "  ", "▁", "\n", "\t", "😀", "　", "\x00", "ﬁ", "中", "​", "²", "<s>", "<0x0A>", "é"]
    texts = ["".join(rng.choice(odd if rng.random() < 0.4 else vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    for t in texts + ["a" * 20000, " " * 999, "ab" * 3000, prose(rng, 3000)]:
        assert p.encode(t) == np.array(p.model.encode(t), "<u4").tobytes(), t[:80]


@pytest.mark.parametrize("at_once,kept", [(1 << 16, 300_000), (40, 25), (3, 2)])
def test_words_are_encoded_together_as_the_library_does(at_once, kept, monkeypatch):
    monkeypatch.setattr(pieces, "AT_ONCE", at_once)
    monkeypatch.setattr(pieces, "KEPT", kept)
    p, rng = pieces.Pieces(MODEL), random.Random(7)
    vocabulary, parts = list(p.id), [" ", " ", "  ", "▁", "\n", "\t", "\x01", p.gap, "😀", "中文", "é", "\n" * 70]
    texts = ["".join(rng.choice(parts if rng.random() < 0.4 else vocabulary) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    texts += ["", " ", "   ", "x ", " x", "\n", prose(rng, 300), prose(rng, 300), "b, c\n" * 50]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in p.encode_all([*texts, "ab" * 3000])] == p.model.encode([*texts, "ab" * 3000])
    # Only what is too long to go together is gone through alone.
    alone, run = [], pieces.Pieces._run
    monkeypatch.setattr(pieces.Pieces, "_run", lambda self, s: alone.append(s) or run(self, s))
    p.word.clear()
    usual = [prose(rng, 300), "b, c\n" * 50]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in p.encode_all(usual)] == p.model.encode(usual) and not alone
    assert len(p.word) <= max(kept, at_once)


def test_piece_digests(docs, none):
    model = pieces.Pieces(MODEL).model
    rows = {r.doc_id: r for r in pieces.digests(docs, MODEL).collect()}
    for d in docs.collect():
        ids = model.encode(d.text or "", add_bos=True, add_eos=True)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    back = pieces.decoded(pieces.encoded(docs, MODEL), MODEL).select("doc_id", "decoded").collect()
    assert {r.doc_id: r.decoded for r in back}[0] == docs.first().text
    assert pieces.digests(none, MODEL).count() == 0


def test_language_families_and_cases(spark):
    rng = random.Random(1)
    syllables = {"en": "th ing he er and", "de": "sch ung ein ich keit", "es": "ción ado que ll os", "fr": "eau tion ré oi eux"}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang].split()) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang, 30), lang, "s", 0) for i, lang in enumerate(list(syllables) * 30)]
    machines = language.fit(spark.createDataFrame(rows, DOCS), language.Fit(bound=20))
    assert set(machines) == {"", "germanic", "romance"}
    test = [(i, make(lang, 12), lang, None, 0) for i, lang in enumerate(list(syllables) * 20)] + [(900, None, "en", "s", 0), (901, "12 34 !", "en", "s", 0)]
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(test, DOCS), machines).collect()}
    assert sum(out[i].lang_pred == lang for i, lang in enumerate(list(syllables) * 20)) >= 78
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[900].score == 0.0 and all(0 <= r.score <= 1 for r in out.values())
    assert language.fit(spark.createDataFrame([], DOCS)) == {}


def test_language_of_few_texts_with_many_copies_is_learned(spark, monkeypatch):
    seen = []
    votes = language._votes
    monkeypatch.setattr(language, "_votes", lambda x, names, how: (seen.append(Counter(names.tolist())), votes(x, names, how))[1])
    copies = spark.range(30_000).selectExpr("id % 900 AS doc_id", "concat('tekst ', translate(cast(id % 30 AS string), '0123456789', 'abcdefghij')) AS text", "'da' AS lang")
    few = spark.createDataFrame([(i, f"text {chr(97 + i)}", "en") for i in range(20)] + [(None, "no key", "en")], "doc_id long, text string, lang string")
    language.fit(copies.unionByName(few), language.Fit(dims=64, rounds=1))
    assert {"da": 30, "en": 21} in seen


def test_factorization_machine_learns_a_pair(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        rows.append((i, " ".join([prose(rng, 10), *["insult"] * insult, *["folk"] * group]), "en", "s", 0))
        labels.append((i, 1, int(insult and group)))
    how = toxicity.Fit(rounds=40)
    machine = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), how)
    cases = spark.createDataFrame([(0, "insult folk"), (1, "insult"), (2, "folk"), (3, None), (4, "")], "doc_id long, text string")
    out = {r.doc_id: r.predicted for r in toxicity.scored(cases, machine, how).collect()}
    assert out == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0}


def test_factorization_machine_learns_a_pair_of_words_without_effect_alone():
    rng = random.Random(2)
    how = toxicity.Fit()

    def made(n):
        rows, labels = [], []
        for i in range(n):
            insult, group = rng.random() < 0.5, rng.random() < 0.5
            said = {*prose(rng, 10).split(), *["insult"] * insult, *["folk"] * group}
            rows.append({t for w in said for t in toxicity.hashed(w, how)})
            labels.append(int(insult != group))
        return rows, np.array(labels)

    machine = toxicity.train(*made(1200), how)
    rows, labels = made(400)
    scores = [toxicity.chance(toxicity.margin(machine, np.array(sorted(machine.place[t] for t in r if t in machine.place), np.int64))) for r in rows]
    assert np.mean((np.array(scores) >= 0.5) == labels) > 0.95


def test_chat_reads_back(spark):
    rng = random.Random(3)
    parts = chat.CONTROL + ["\\", "<", "s>", "hello", "é😀", "\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a<s>b"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(50, 0, None, None), (50, None, "assistant", "x"), (50, 0, None, None), (51, 0, "assistant", "word " * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.chat: r for r in chat.read_back(chat.format_chats(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><div class="ad7">Buy</div><div class="story s%d"><h1>Head &amp; tail</h1><p>First <b>para<br>graph.<p>Second\n one.</p><div id=comments><p>Bad</div></div><footer>&copy;</footer></body></html>'


def test_main_text_by_host(spark):
    rows = [(i, f"https://www.Ex.org:80/{i}", PAGE % i) for i in range(6)]
    rows += [(10, None, "<p>No host</p>"), (11, "https://ex.org/z", None), (12, "http://b.org", ""), (13, "x", "plain < text"), (14, "http://b.org", "<script>var t='</p>'</script><article><p>A</article><p>B")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = {r.page_id: r.text for r in extract.main_text(pages).select("row.page_id", "text").collect()}
    assert out[0] == "Head & tail\nFirst para graph.\nSecond one."
    assert (out[10], out[11], out[12], out[13], out[14]) == ("No host", "", "", "plain < text", "A")
    assert extract.main_text(pages.limit(0)).count() == 0


def plain(page):
    return extract.chosen(extract.blocks(page), [])


@pytest.mark.parametrize("n", [5000, 1_000_000])
def test_main_text_long_attributes(n):
    long = "data:" + "a<b>'" * (n // 5)
    assert plain(f'<article><p>One <img src="{long}"> two</article>') == "One two"
    assert plain(f'<article><p>One</p><nav data-props="{long}">Menu</nav><div data-x="{long}"><p>Two</p></div><p>Three</article>') == "One\nTwo\nThree"
    assert plain(f'<article><p {"a=b " * (n // 4)}>One</article>') == "One"


def test_main_text_odd_attributes():
    assert plain("<article><p title=it's>One</p><p title='x>Two</p></article>") == "One\nTwo"
    assert plain('<article><svg width="1"/><p>One</p><svg><text>no</text></svg><p>Two</article>') == "One\nTwo"
    assert plain('<article><p style="overflow:hidden" title="class=hidden">One <a href=/x/>link</a> on</article>') == "One link on"
    assert extract.blocks("<p><a href=/x/>link</a>")[0][2] == 4
    assert plain("<article><p hidden>No</p><p>One <b and 1 < 2</article>") == "One <b and 1 < 2"
    for part in ('<a x="<a" ', "<a/x=", "<a x='", '<a x="', "<a <", "<a x=<b ", "<p a=' \""):
        plain(part * 50_000)


@pytest.mark.parametrize("given", ['class="post has-sidebar"', 'class="no-sidebar content"', 'class="navy-text"', 'class="with-comments"', 'id="related-work"', 'class="widget"'])
def test_main_text_names_that_only_sound_like_menus(given):
    assert plain(f"<body><div {given}><p>A long text of the article.</p><p>More.</div></body>") == "A long text of the article.\nMore."
    assert plain(f"<article><p>One</p><h2 {given}>Head</h2><pre>x <span {given}># note</span></pre></article>") == "One\nHead\nx # note"


def test_main_text_marked_containers_and_figures():
    page = '<article><p>One long text</p>%s<p>Two</article>'
    for given in ('class="sidebar"', "id=comments", 'class="x comment-list"', 'role="navigation"', 'class="related-2"'):
        assert plain(page % f"<div {given}><p>No</p></div>") == plain(page % f"<ul {given}><li>No</ul>") == "One long text\nTwo"
    assert plain(page % "<figure><table><tr><td>1</table><figcaption>Caption</figcaption></figure><p><math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>") == "One long text\n1\nCaption\nx=1\nTwo"
    assert plain("<body><div class=sidebar><p>Twice as long as the text</p></div><div class=story><p>Just the text</p></div></body>") == "Just the text"


def test_main_text_is_the_whole_article(spark):
    body = "<p>" + "The body goes on and on. " * 12 + "</p>"
    text = ("The body goes on and on. " * 12).strip()
    links = "<div class=more><a href=/1>Another story</a> <a href=/2>One more</a></div>"
    bodies = {
        f"<article><h1>Head</h1><p>Lead</p><div class=content>{body}</div>{links}</article><div class=foot>Imprint</div>": f"Head\nLead\n{text}",
        f"<article><section class=a><p>First</section><section class=b>{body}</section><section class=c><p>Last</section></article>": f"First\n{text}\nLast",
        f"<main><h1>Head</h1>{links}<article>{body}</article></main><div>Imprint</div>": f"Head\n{text}",
        f"<div class=page><div class=top><h1>Head</h1></div><div class=in>{body}</div>{links}<div class=sidebar>Side</div></div>": f"Head\n{text}",
        f"<h1>Head</h1><div class=one>{body}{body}</div><div class=two>{body}</div><div class=foot>Imprint</div>": "\n".join(["Head", text, text, text]),
    }
    for inner, want in bodies.items():
        assert plain(f"<html><body>{inner}</body></html>") == plain(inner) == want
    rows = [(10 * h + i, f"http://h{h}.org/{i}", f"<html><body>{inner}</body></html>") for h, inner in enumerate(bodies) for i in range(3)]
    out = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("row.page_id", "text").collect()
    assert {r.page_id: r.text for r in out} == {10 * h + i: want for h, want in enumerate(bodies.values()) for i in range(3)}


@pytest.mark.parametrize("block_codes,part_queries", [(16384, 2048), (50, 7)])
def test_hamming_search_is_exact(spark, block_codes, part_queries):
    rng = random.Random(4)
    codes = [rng.getrandbits(63) & rng.getrandbits(63) for _ in range(150)]
    codes += [codes[0]] * 30 + [codes[1] ^ 1 << rng.randrange(60) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(codes)) + [(999, None)], "id long, code long")
    found = hamming.nearest(rows, rows.where("id % 9 = 0"), hamming.Search(block_codes=block_codes, part_queries=part_queries)).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.distance, r.id))
    assert set(got) == {i for i in range(len(codes)) if i % 9 == 0}
    for q, answers in got.items():
        assert answers == sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:10]


def test_a_class_of_billions_is_thinned_without_overflow(spark):
    rows = spark.range(100_000).withColumn("class_rows", F.lit(30_000_000_000))
    assert 4_500 < sampling.thinned(rows, 750_000_000, "id").count() < 5_500  # one in twenty


def test_long_turns_are_encoded_without_seams(spark):
    coder = chat.Coder(RANKS, public_tokenizers.PATTERN)
    for text in ("word" * 15_000, "ab cd. " * 9_000, "é" * 60_000):
        assert coder.encode(text).tolist() == coder.coding.encode_ordinary(text)
        assert coder.decode(coder.encode(text)) == text


def test_a_vector_wider_than_its_code_is_refused(spark):
    rows = spark.createDataFrame([(1, [0.5] * 65)], "id long, v array<double>")
    with pytest.raises(Exception, match="65 elements"):
        rows.select(hamming.sign_code(F.col("v"), 64)).collect()
    with pytest.raises(ValueError):
        hamming.sign_code(F.col("v"), 65)


def _main(spark, pages):
    rows = spark.createDataFrame([(i, url, page) for i, (url, page) in enumerate(pages)], "page_id long, url string, html string")
    return {r.row.page_id: r.text for r in extract.main_text(rows).collect()}


LINES = [f"Sentence number {i} tells a good deal about the matter at hand." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)


def test_a_form_around_the_article_and_one_beside_it(spark):
    around = f'<body><form action="x"><input name="v"><div class="content">{BODY}</div><button>Send it</button></form></body>'
    beside = f'<body><div class="content">{BODY}<form><p>Write us what you think</p><label>Name</label><input></form></div><form><div><p>Search this site</p></div></form></body>'
    only = "<body><form><label>User</label><input><button>Log in</button></form></body>"
    assert _main(spark, [("http://a.example/1", around), ("http://b.example/1", beside), ("http://c.example/1", only)]) == {0: "\n".join(LINES), 1: "\n".join(LINES), 2: ""}


def test_an_article_keeps_its_header_and_loses_what_is_not_shown(spark):
    page = (f'<body><header><h1>Site name</h1></header><article><header><h1>Headline</h1><p>The lead.</p></header>{BODY}'
            '<p style="color:red; DISPLAY : none">secret</p><p hidden>gone</p><p aria-hidden="true">shown</p><p style="display:nonesuch">odd</p></article></body>')
    assert _main(spark, [("http://a.example/", page)]) == {0: "\n".join(["Headline", "The lead.", *LINES, "shown", "odd"])}


def test_each_template_of_a_host_votes_for_itself(spark):
    """Twelve templates with side boxes; a plain extractor that knows each template tells the texts."""
    pages, want = [], {}
    for t in range(12):
        for n in range(5):
            lines = [f"Page {n} of kind {t}: {x}" for x in LINES[: 2 + n % 3]]
            content = "".join(f"<p>{x}</p>" for x in lines)
            box = f'<div class="box{"abcdefghijkl"[t]}"><p>Most read today</p></div>'
            want[len(pages)] = "\n".join(lines)
            pages.append(("http://many.example/p", f'<body>{box}<div class="kind-{"abcdefghijkl"[t]}">{content}</div></body>'))
    pages.append(("http://many.example/q", f'<body><div class="never-seen">{BODY}</div></body>'))
    want[len(want)] = "\n".join(LINES)
    assert _main(spark, pages) == want
    rows = spark.createDataFrame(pages, "url string, html string")
    (host,) = extract.host_paths(rows).collect()
    assert host.host_pages == 61 and {f"html>body>div.kind-{c}" for c in "abcdefghijkl"} <= {"html>" + p if not p.startswith("html") else p for p in host.ranked}


def brute_telling(rows, limits):
    """Terms hidden per row, from counts of all entities and terms."""
    n, with_c, with_t, with_ct, of = len(rows), Counter(), Counter(), Counter(), {}
    for i, text in enumerate(rows):
        spans = [x.split(":") for x in brute_spans(text).split(",") if x]
        entities, bare = set(), text
        for kind, a, b in spans:
            value = text[int(a) : int(b)]
            bare = bare[: int(a)] + " " * (int(b) - int(a)) + bare[int(b) :]
            digits = re.sub("[^0-9]", "", value)
            if kind == "email":
                value = value.lower()
                entities |= {value, "domain " + value.rsplit("@", 1)[1]} | {"word " + w for w in re.split("[^a-z]+", value.split("@", 1)[0]) if len(w) > 2}
            elif kind == "ip":
                entities |= {value, "net " + ".".join(value.split(".")[:3])}
            else:
                entities |= {kind + digits, kind + " from " + digits[:6]}
        terms = set(re.findall(r"[^\W\d_]\w+", bare.lower()))
        of[i] = (entities, terms)
        with_c.update(entities), with_t.update(terms)
        with_ct.update((c, t) for c in entities for t in terms)

    def told(c, t):
        return with_ct[c, t] >= limits.support and with_c[c] < n and (
            np.log2(n * with_ct[c, t] / (with_c[c] * (with_t[t] + limits.smooth))) >= limits.disclosure * np.log2(n / with_c[c]))

    return {i: {t for t in terms for c in entities if told(c, t)} for i, (entities, terms) in of.items()}


def test_terms_that_tell_what_values_share(spark):
    """No address occurs twice; name and place beside a shared domain, network or prefix are hidden."""
    rng = random.Random(9)
    texts = [f"Dr Zorblax lives with a{i}@zorblax.org near Quimby" for i in range(30)]
    texts += [f"Server rack Li{i % 2} answers at 10.7.3.{i} in Oslo {prose(rng, 5)}" for i in range(12)]
    texts += [f"call Mx Ovid at +49 171 55{i:05d} or x.ovid.{i}@mail.org {prose(rng, 8)}" for i in range(9)]
    texts += [f"{prose(rng, 12)} write to u{i}@mail.org" for i in range(60)] + [prose(rng, 20) + " near the rack, call or write to" for _ in range(400)] + ["", "Quimby is quiet"]
    limits = privacy.Disclosure()
    want = brute_telling(texts, limits)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {s.value for s in r.spans if privacy.KINDS[s.kind] in ("term", "cut")} for r in privacy.find(df, limits).select("row.doc_id", "spans").collect()}
    assert got == want
    assert {"zorblax", "dr", "quimby"} <= want[0] and "near" not in want[0] and "oslo" in want[31] and "li" not in want[31] and "ovid" in want[45] and not want[-2 % len(texts)]
    assert sum(map(len, (want[i] for i in range(51, 111)))) == 0  # chance company of a common domain


def test_one_text_with_very_many_values(spark):
    text = " ".join(f"a{i}@b{i % 7}.org and" for i in range(100_000))
    df = spark.createDataFrame([(1, text), (2, "é" * 3000 + " x@y.org " + "中" * 3000 + " 1.2.3.4")], "doc_id long, text string")
    start = time.time()
    out = {r.doc_id: r.text for r in privacy.sanitised(df).collect()}
    assert time.time() - start < 120
    assert out[1] == " ".join(["[email] and"] * 100_000) and out[2] == "é" * 3000 + " [email] " + "中" * 3000 + " [ip]"


@pytest.mark.parametrize("rows_per_range", [1_000_000, 7])
def test_turns_placed_one_by_one_tell_what_whole_chats_tell(spark, rows_per_range):
    rng = random.Random(6)
    texts = ["", None, "</s>[INST] ok [/INST]", "a\\b<|turn|>", "näher 中文 \U0001f600", "word " * 50]
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", "assistant", "<s>", None]), rng.choice(texts), "x") for _ in range(150)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, ids string")
    placed = chat.placed_turns(df, RANKS, public_tokenizers.PATTERN, rows_per_range=rows_per_range)
    one = sorted(map(str, chat.read_turns(placed, RANKS, public_tokenizers.PATTERN).collect()))
    whole = chat.format_chats(df, RANKS, public_tokenizers.PATTERN)
    assert one == sorted(map(str, chat.read_back(whole, RANKS, public_tokenizers.PATTERN).collect())) and len(one) == 4
    # The turns' ids, one after the other by their places, are the chat's, and so is the mask.
    for c in whole.collect():
        turns = sorted((r.at, r.ids, r.loss_from, r.loss_to) for r in placed.where(F.col("chat").eqNullSafe(F.lit(c.chat))).collect())
        mask = bytearray(len(c.ids) // 4)
        for _, _, a, b in turns:
            mask[a:b] = b"\1" * (b - a)
        assert b"".join(bytes(t[1]) for t in turns) == bytes(c.ids) and bytes(mask) == bytes(c["mask"])
        assert [t[0] for t in turns] == [sum(len(t[1]) // 4 for t in turns[:i]) for i in range(len(turns))]
    none = df.limit(0)
    assert chat.read_turns(chat.placed_turns(none, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).isEmpty()


CLASH = ", lang_pred string, family_pred string, score string, predicted string, found_ string, key string, label string, mark string, x string"


def with_clash(spark, rows):
    return spark.createDataFrame([(*r, *["z"] * 9) for r in rows], "doc_id long, text string, lang string" + CLASH)


def test_language_of_odd_rows(spark):
    rng = random.Random(8)
    train = [(i, prose(rng, 30), "aa") for i in range(20)] + [(100 + i, prose(rng, 30).translate(str.maketrans("aeio", "xyzw")), "bb") for i in range(20)]
    train += [train[0]] * 50 + [(None, "no key here", "aa"), (500, None, "bb"), (501, "", None)]
    machines = language.fit(with_clash(spark, train))
    odd = [(1, None, None), (2, "", "aa"), (3, "123 !", "aa"), (4, "中", None), (5, train[3][1] * 2000, None), (6, train[25][1], None), (6, train[25][1], None)]
    out = language.identify(with_clash(spark, odd), machines)
    assert out.columns == ["doc_id", "text", "lang", "predicted", "found_", "key", "label", "mark", "x", "lang_pred", "family_pred", "score"]
    got = [(r.doc_id, r.lang_pred) for r in out.collect()]
    assert sorted(got)[:3] == [(1, "und"), (2, "und"), (3, "und")] and got.count((6, "bb")) == 2 and (5, "aa") in got
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert language.identify(with_clash(spark, odd).limit(0), machines).isEmpty()
    # A tie, as no machine has seen these letters, goes to the same name every time.
    assert len({r.lang_pred for _ in range(2) for r in language.identify(with_clash(spark, [(i, "中文", None) for i in range(9)]), machines).collect()}) == 1


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, f"{prose(rng, 20)} {'vile thing' if i % 3 == 0 else 'kind thing'}", "en") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(0, 1), (None, 1), (7, None), (8, 5)], "doc_id long, toxic int")
    how = toxicity.Fit(rounds=30)
    machine = toxicity.fit(with_clash(spark, rows + [rows[0]] * 500), labels, how)
    odd = [(1, None, None), (2, "", None), (3, "unseen", None), (4, rows[0][1] + " padding" * 100_000, None), (5, "vile thing", None), (5, "vile thing", None)]
    out = toxicity.scored(with_clash(spark, odd), machine, how)
    found = [(r.doc_id, r.score, r.predicted) for r in out.collect()]
    assert len(found) == 6 and all(0 <= s <= 1 and p == int(s >= 0.5) for _, s, p in found)
    assert found[0][1:] == found[1][1:] == found[2][1:] and [p for d, _, p in found if d == 5] == [1, 1] and out.columns.count("score") == 1
    assert toxicity.scored(with_clash(spark, odd).limit(0), machine, how).isEmpty()
    none = toxicity.fit(with_clash(spark, rows[:1]).limit(0), labels.limit(0), how)
    assert all(r.score < 1e-9 for r in toxicity.scored(with_clash(spark, odd), none, how).collect())
