"""Running values with several ranges, hot keys, joins back, chats."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sheetwright.operators import joining
from sheetwright.operators.joining import join_back
from sheetwright.operators.ordered import carry_last, numbered, rank_within, running_sum, with_ranges
from sheetwright.operators.registry import current_doc, ingest_once, known_docs, live_only, new_contents, resolve_chat_doc
from sheetwright.operators.questions import all_frequent, in_interval, running_total


def hot_events(seed, n=900):
    rnd = random.Random(seed)
    moments = rnd.sample(range(n * 3), n)
    return [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), t, rnd.choice([None, None, rnd.randint(1, 99)])) for t in moments]


@pytest.mark.parametrize("rows_per_range", [10, 60, 10_000])
def test_carry_and_running_sum(spark, rows_per_range):
    data = hot_events(1)
    df = spark.createDataFrame(data, "k string, t bigint, v bigint")
    if rows_per_range == 10:
        ranged, several = with_ranges(df, "t", 10)
        assert several
        most = ranged.groupBy("order_range").count().agg(F.max("count")).first()[0]
        assert most <= 40
    carried = {(r.k, r.t): r.out for r in carry_last(df, ["k"], ["t"], "v", "out", rows_per_range).collect()}
    summed = {(r.k, r.t): r.out for r in running_sum(df, ["k"], ["t"], "v", "out", rows_per_range).collect()}
    counted = {(r.k, r.t): r.out for r in numbered(df, ["k"], ["t"], "out", rows_per_range).collect()}
    last, total, n = {}, {}, {}
    for k, t, v in sorted(data, key=lambda r: r[1]):
        last[k] = v if v is not None else last.get(k)
        total[k] = total.get(k) if v is None else (total.get(k) or 0) + v
        n[k] = n.get(k, 0) + 1
        assert carried[(k, t)] == last[k]
        assert summed[(k, t)] == total[k]
        assert counted[(k, t)] == n[k]
    assert len(carried) == len(summed) == len(data)


def test_many_small_keys_need_no_ranges(spark):
    df = spark.createDataFrame([(i % 50, i) for i in range(500)], "k int, t int")
    assert with_ranges(df, "t", 100)[1] and not with_ranges(df, "t", 100, ["k"])[1] and with_ranges(df, "t", 9, ["k"])[1]
    got = {(r.k, r.t): r.out for r in numbered(df, ["k"], ["t"], "out", 100).collect()}
    assert got == {(i % 50, i): i // 50 + 1 for i in range(500)}


@pytest.mark.parametrize("rows_per_range", [3, 10_000])
def test_null_keys_and_moments_are_kept(spark, rows_per_range):
    data = [(None, 1, 5), (None, 9, None), ("a", None, 7), ("a", 3, None)] + [("b", i, None) for i in range(20)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    got = {(r.k, r.t): r.out for r in carry_last(df, ["k"], ["t"], "v", "out", rows_per_range).collect()}
    assert len(got) == len(data) and got[(None, 9)] == 5 and got[("a", 3)] == 7 and got[("b", 19)] is None


@pytest.mark.parametrize("rows_per_range", [5, 10_000])
def test_rank(spark, rows_per_range):
    rnd = random.Random(2)
    data = [(rnd.choice("aaab"), rnd.randint(0, 40)) for _ in range(300)] + [("a", 7)] * 200
    df = spark.createDataFrame(data, "k string, v bigint")
    got = sorted((r.k, r.v, r["rank"]) for r in rank_within(df, ["k"], "v", "rank", rows_per_range).collect())
    want = sorted((k, v, 1 + sum(1 for k2, v2 in data if k2 == k and v2 > v)) for k, v in data)
    assert got == want


def test_join_back_with_a_hot_key(spark, monkeypatch):
    """The hot key goes the broadcast way, the others the plain way; nothing is lost."""
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(3000)] + [(None, -1)], "k string, i int")
    summary = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("first")).where("k is not null")
    monkeypatch.setattr(joining, "HOT_ROWS", 500)
    monkeypatch.setattr(joining, "BROADCAST_BYTES", 0)
    out = join_back(rows, summary, ["k"], "n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
    got = out.collect()
    assert len(got) == 3001
    first = {r.k: r["first"] for r in summary.collect()}
    assert all(r["first"] == first.get(r.k) for r in got)


def test_typing_with_a_hot_table(spark, monkeypatch):
    """One table holds most rows and the decisions count as too many to broadcast."""
    from sheetwright.operators.clean import normalize_rows

    monkeypatch.setattr(joining, "HOT_ROWS", 300)
    monkeypatch.setattr(joining, "BROADCAST_BYTES", 0)
    data = [("hot", "t", i, [f"{i}.000", str(40_000_000 + i), "x"]) for i in range(1, 900)] + [
        (f"d{i % 30}", "t", i, [f"{i},5", str(50_000_000 + i), None]) for i in range(1, 300)]
    rows = spark.createDataFrame(data, "doc_id string, table_name string, row_no bigint, cells array<string>")
    typed, _ = normalize_rows(rows)
    got = {(r.doc_id, r.row_no): r.cells for r in typed.collect()}
    assert len(got) == len(data)
    for doc, _, i, cells in data:
        a, b, c = got[(doc, i)]
        assert a.num == (i * 1000.0 if doc == "hot" else i + 0.5)
        assert b.text == cells[1] and b.num is None
        assert c.text == cells[2]


@pytest.mark.parametrize("rows_per_range", [7, 10_000])
def test_chat_document_at_the_time(spark, rows_per_range):
    rnd = random.Random(4)
    marks = [(rnd.choice(["hot"] * 4 + ["a", "b"]), rnd.randint(0, 300), s, f"d{s}") for s in range(200)]
    asked = [(rnd.choice(["hot"] * 4 + ["a", "b", "none"]), rnd.randint(0, 300), q, rnd.choice([None, None, None, "own"])) for q in range(300)]
    attachments = spark.createDataFrame(marks, "chat_id string, ts bigint, seq bigint, doc_id string")
    questions = spark.createDataFrame(asked, "chat_id string, ts bigint, q bigint, doc_id string")
    got = {r.q: (r.doc_id, r.found) for r in resolve_chat_doc(questions, attachments, rows_per_range=rows_per_range).collect()}
    for chat, ts, q, own in asked:
        before = [(t, s, d) for c, t, s, d in marks if c == chat and t <= ts]
        want = own or (max(before)[2] if before else None)
        assert got[q] == (want, want is not None), q
    assert len(got) == len(asked)
    now = {r.chat_id: r.doc_id for r in current_doc(attachments).collect()}
    assert now == {c: max((t, s, d) for c2, t, s, d in marks if c2 == c)[2] for c in {m[0] for m in marks}}


def test_same_content_once(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "x")], "arrival int, source_id string")
    got = {r.arrival: (r.first_arrival, r.cached) for r in ingest_once(df, "arrival").collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (1, True), 4: (1, True)}
    stored = spark.createDataFrame([("x", "doc-x")], "source_id string, doc_id string")
    known = {r.arrival: (r.doc_id, r.cached) for r in known_docs(df, stored).collect()}
    assert known == {1: ("doc-x", True), 2: (None, False), 3: ("doc-x", True), 4: ("doc-x", True)}
    assert [r.source_id for r in new_contents(df, stored).collect()] == ["y"]
    assert live_only(stored, spark.createDataFrame([("other",)], "doc_id string")).count() == 0


def test_running_total_has_one_row_per_moment(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("a", 4, 1.0), ("b", 2, 5.0)], "k string, t int, v double")
    got = sorted((r.k, r.t, r.running_total) for r in running_total(df, ["k"], "t", "v").collect())
    assert got == [("a", 1, 5.0), ("a", 4, 6.0), ("b", 2, 5.0)]


@pytest.mark.parametrize("levels", [1, 3, 12])
def test_interval_join_of_widths_of_all_sizes(spark, levels):
    rnd = random.Random(levels)
    points = [(i, rnd.choice([rnd.uniform(-1e6, 1e6), rnd.uniform(-5, 5), 0.0, None, float("nan"), 1e9])) for i in range(150)]
    spans = [(i, x := rnd.choice([rnd.uniform(-1e6, 1e6), rnd.uniform(-5, 5), 0.0]), x + 10 ** rnd.uniform(-3, 9)) for i in range(60)]
    spans += [(60, 5.0, 5.0), (61, 9.0, 1.0), (62, None, 3.0), (63, float("-inf"), float("inf")), (64, 0.0, float("nan"))]
    df = in_interval(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "s int, low double, high double"), "x", "low", "high", levels)
    got = sorted((r.p, r.s) for r in df.collect())
    assert got == sorted((p, s) for p, x in points for s, lo, hi in spans if x is not None and lo is not None and lo <= x < hi)


@pytest.mark.parametrize("rows_per_range", [20, 1_000_000])
def test_totals_of_the_intervals_of_a_point(spark, rows_per_range):
    rnd = random.Random(rows_per_range)
    points = [(i % 140, rnd.choice([rnd.uniform(-1e6, 1e6), rnd.uniform(-5, 5), 0.0, -0.0, None, float("nan"), 1e9, float("inf")])) for i in range(150)]
    spans = [(i, x := rnd.choice([rnd.uniform(-1e6, 1e6), rnd.uniform(-5, 5), 0.0]), x + 10 ** rnd.uniform(-3, 9)) for i in range(60)]
    spans += spans[:9] + [(None, -2.0, 3.0), (60, 5.0, 5.0), (61, 9.0, 1.0), (62, None, 3.0), (63, float("-inf"), float("inf")), (64, 0.0, float("nan"))]
    totals = {"n": ("count", "*"), "known": ("count", "s"), "first": ("min", "s"), "last": ("max", "s"), "keys": ("sum", "s")}
    spans_df = spark.createDataFrame(spans, "s int, low double, high double")
    df = in_interval(spark.createDataFrame(points, "p int, x double"), spans_df, "x", "low", "high", totals=totals, rows_per_range=rows_per_range)
    want = []
    for p, x in points:
        held = [s for s, lo, hi in spans if x is not None and lo is not None and lo <= x < hi]
        some = [s for s in held if s is not None]
        if held:
            want.append((p, x, len(held), len(some), min(some), max(some), sum(some)))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    none = in_interval(spark.createDataFrame(points, "p int, x double"), spans_df.limit(0), "x", "low", "high", totals=totals)
    assert none.isEmpty()


def test_totals_of_many_intervals_make_no_pairs(spark):
    """Ten thousand million pairs, of which none is made."""
    n = 100_000
    points = spark.range(n).select(F.col("id").alias("p"), F.col("id").cast("double").alias("x"))
    spans = spark.range(n).select("id", (-F.col("id")).cast("int").alias("low"), F.lit(n).alias("high"))
    df = in_interval(points, spans, "x", "low", "high", totals={"n": ("count", "*"), "keys": ("sum", "id")})
    assert df.agg(F.count("*"), F.min("n"), F.max("n"), F.max("keys")).first() == (n, n, n, n * (n - 1) // 2)


def test_a_wide_interval_has_few_pieces(spark):
    days = spark.createDataFrame([(i, date(2000, 1, 1) + timedelta(i)) for i in range(300)], "p int, x date")
    spans = [(i, date(2000, 1, 1) + timedelta(i * 3), date(2000, 1, 1) + timedelta(i * 3 + 2 ** (i % 20))) for i in range(100)]
    df = in_interval(days, spark.createDataFrame(spans, "s int, low date, high date"), "x", "low", "high")
    assert df.count() == sum(1 for i in range(300) for _, lo, hi in spans if lo <= date(2000, 1, 1) + timedelta(i) < hi)
    assert in_interval(days, spark.createDataFrame([], "s int, low date, high date"), "x", "low", "high").isEmpty()


def test_most_frequent_per_column(spark):
    cells = spark.createDataFrame([("d", "t", 0, x) for x in "bbaac"] + [("d", "t", 1, None)], "doc_id string, table_name string, col_no int, text string")
    (r,) = all_frequent(cells).collect()
    assert (r.value, r.n) == ("a", 2)


@pytest.mark.parametrize("rows_per_range", [2, 1_000_000])
def test_rank_of_nulls_and_null_keys(spark, rows_per_range):
    rows = [("g", "a", None), ("g", "b", 5.0), ("g", "c", 9.0), ("g", "d", float("nan")), (None, "e", 1.0), (None, "f", 2.0)]
    out = rank_within(spark.createDataFrame(rows, "k string, i string, v double"), ["k"], "v", rows_per_range=rows_per_range).collect()
    assert {r.i: r["rank"] for r in out} == {"d": 1, "c": 2, "b": 3, "a": 4, "f": 1, "e": 2}


def _as(kind, i):
    if i % 11 == 0:
        return None
    if kind == "double":
        return [float("nan"), float("inf"), float("-inf"), i / 4][min(i % 9, 3)]
    return {"string": f"name {i % 7:02d}", "decimal(12,2)": Decimal(i) / 4, "date": date(2024, 1, 1) + timedelta(i), "boolean": i % 2 == 0,
            "struct<a:string,b:int>": (f"x{i % 5}", None if i % 4 == 0 else i)}[kind]


@pytest.mark.parametrize("kind", ["string", "double", "decimal(12,2)", "date", "boolean", "struct<a:string,b:int>"])
def test_any_order_gives_the_same_with_many_ranges(spark, kind):
    rows = [("hot" if i % 3 else "b", _as(kind, i), i, i % 5 if i % 6 else None) for i in range(60)]
    df = spark.createDataFrame(rows, f"k string, o {kind}, i int, v bigint")
    for run in (carry_last, running_sum):
        few, many = ({r.i: r.out for r in run(df, ["k"], ["o", "i"], "v", "out", n).collect()} for n in (1_000_000, 2))
        assert few == many and len(few) == 60
    ranged, several = with_ranges(df, "o", 2)
    assert several
    # Ranges follow the order of the values, and equal values share one.
    lows = [r.order_range for r in ranged.orderBy("o").collect()]
    assert lows == sorted(lows) and ranged.groupBy("o").agg(F.count_distinct("order_range").alias("n")).where("n > 1").isEmpty()


def test_an_order_of_nulls_only(spark):
    df = spark.createDataFrame([("k", None, i) for i in range(9)], "k string, o string, v bigint")
    assert {r.out for r in running_sum(df, ["k"], ["o"], "v", "out", 2).collect()} <= {sum(range(i + 1)) for i in range(9)} | {36}
    assert sorted(r.out for r in numbered(df, ["k"], ["o", "v"], "out", 2).collect()) == list(range(1, 10))


def test_tables_are_alike_by_names_and_types(spark):
    from sheetwright.operators.questions import cross_doc, table_signatures

    tables = {  # (names, types) per document
        "a": (["Betrag", "Jahr"], ["number", "text"]),
        "b": (["JAHR ", " betrag"], ["text", "number"]),  # other order and case
        "c": (["Betrag", "Jahr"], ["number", "number"]),  # other type
        "d": (["Betrag", "Jahr", "Ort"], ["number", "text", "text"]),  # one more
        "e": (["Wert", "Wert"], ["number", "number"]),  # names made distinct
        "f": (["Wert", "Wert"], ["number", "number"])}
    headers = spark.createDataFrame([(d, "table1", n) for d, (n, _) in tables.items()], "doc_id string, table_name string, header array<string>")
    decisions = spark.createDataFrame([(d, "table1", i, t) for d, (_, ts) in tables.items() for i, t in enumerate(ts)], "doc_id string, table_name string, col_no int, type string")
    signed = {r.doc_id: r.signature for r in table_signatures(headers, decisions).collect()}
    assert signed["a"] == signed["b"] and signed["e"] == signed["f"] and len(set(signed.values())) == 4
    cells = spark.createDataFrame([(d, "table1", i, float(10 ** i * (k + 1))) for k, (d, (n, _)) in enumerate(tables.items()) for i in range(len(n))],
                                  "doc_id string, table_name string, col_no int, num double")
    found = {(r.signature, r.name): (r.total, r.n, r.n_docs) for r in cross_doc(cells, headers, decisions, "BETRAG").collect()}
    assert found == {(signed["a"], "betrag"): (1.0 + 20.0, 2, 2), (signed["c"], "betrag"): (3.0, 1, 1), (signed["d"], "betrag"): (4.0, 1, 1)}
    every = cross_doc(cells, headers, decisions).where(F.col("signature") == signed["e"]).collect()
    assert sorted((r.total, r.n_docs) for r in every) == [(11.0, 2), (110.0, 2)]
