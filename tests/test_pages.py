"""Page tables, markdown, headers, routes and text blocks."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sheetwright.functions.headers import unique_names
from sheetwright.operators.clean import normalize_rows
from sheetwright.operators.fragments import merge_page_tables
from sheetwright.plans.ingest import ingest_images, ingest_pages
from sheetwright.sources.markdown import markdown_fragments
from sheetwright.sources.pages import page_routes, text_blocks
from sheetwright.sources.routing import route_files

FRAGMENT = "doc_id string, page_no int, index_on_page int, rows array<array<string>>"


def merged(spark, pieces, pages_per_range=256):
    rows, headers = merge_page_tables(spark.createDataFrame(pieces, FRAGMENT), pages_per_range)
    tables = {(h.doc_id, h.table_name): (list(h.header), []) for h in headers.collect()}
    for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.table_name, r.row_no)):
        body = tables[(r.doc_id, r.table_name)][1]
        assert r.row_no == len(body)
        body.append((r.source_page, tuple(r.cells)))
    return tables


def test_continues_without_header(spark):
    got = merged(spark, [("d", 1, 0, [["Ware", "Stück"], ["A", "10"], ["B", "20"]]),
                         ("d", 2, 0, [["C", "30"], ["D", "40"]])])
    assert got == {("d", "table1"): (["Ware", "Stück"], [(1, ("A", "10")), (1, ("B", "20")), (2, ("C", "30")), (2, ("D", "40"))])}


def test_repeated_header_is_dropped(spark):
    got = merged(spark, [("d", 1, 0, [["Ware", "Stück"], ["A", "10"]]), ("d", 2, 0, [["Ware", "Stück"], ["B", "20"]])])
    assert got[("d", "table1")][1] == [(1, ("A", "10")), (2, ("B", "20"))]


@pytest.mark.parametrize("second,n", [
    ((2, 0, [["Teil", "Preis"], ["B", "2"]]), 2),          # other header, same width
    ((3, 0, [["B", "2"]]), 2),                             # a page is skipped
    ((2, 1, [["B", "2"]]), 2),                             # not the first on its page
    ((2, 0, [["B", "2", "3"]]), 2),                        # other width
    ((2, 0, [["  B ", "2", "x"][:2]]), 1),
    ((2, 0, [["", " "], [None, ""]]), 1),                  # nothing on it
])
def test_what_ends_a_table(spark, second, n):
    got = merged(spark, [("d", 1, 0, [["Ware", "Stück"], ["A", "1"]]), ("d", *second)])
    assert len(got) == n


def test_header_only_tables_do_not_count(spark):
    got = merged(spark, [("d", 1, 0, [["a", "b"]]), ("d", 1, 1, [["c", "d"], ["x", "1"]]), ("e", 1, 0, [["a", "b"]])])
    assert list(got) == [("d", "table1")] and got[("d", "table1")][0] == ["c", "d"]


def test_ragged_rows_fit_the_header(spark):
    got = merged(spark, [("d", 1, 0, [["a", "b"], ["x", "1", "extra"], ["y"]])])
    assert got[("d", "table1")][1] == [(1, ("x", "1")), (1, ("y", ""))]


def is_heading(row):
    """Words only, by the same pattern the expressions use, in Python's dialect."""
    words = [c for c in row if c != ""]
    return words != [] and all(NUMBER.fullmatch(c) is None for c in words)


NUMBER = re.compile(r"[+-]?[0-9.,\s]+(?:€|%|EUR)?", re.IGNORECASE)


def expected_tables(pieces):
    """Tables of one document: pieces are linked to their predecessors first,
    then every chain of linked pieces is cut where another heading comes up."""
    tidy = []
    for page, index, rows in pieces:
        rows = [[" ".join((c or "").split()) for c in r] for r in rows]
        rows = [r for r in rows if r != [""] * len(r)]
        if rows:
            tidy.append((page, index, rows))
    tables, heading = [], None
    for i, (page, index, rows) in enumerate(tidy):
        linked = False
        if i and index == 0:
            page_before, _, rows_before = tidy[i - 1]
            linked = page - page_before == 1 and len(rows[0]) == len(rows_before[0])
        own = rows[0] if is_heading(rows[0]) else None
        if not linked or own not in (None, heading):
            heading = own
            tables.append(([""] * len(rows[0]) if own is None else own, []))
        names, body = tables[-1]
        for row in rows if own is None else rows[1:]:
            padded = row + [""] * (len(names) - len(row))
            body.append((page, tuple(padded[: len(names)])))
    filled = [t for t in tables if any(c for _, row in t[1] for c in row)]
    return {f"table{n}": t for n, t in enumerate(filled, 1)}


@pytest.mark.parametrize("pages_per_range", [2, 5, 256])
def test_random_documents(spark, pages_per_range):
    rnd = random.Random(11)
    pieces, expected = [], {}
    for d in range(150):
        doc = []
        page = rnd.randint(0, 3)
        while len(doc) < 14:
            for index in range(rnd.choice([0, 1, 1, 1, 2])):
                width = rnd.choice([2, 2, 2, 3])
                rows = []
                if rnd.random() < 0.4:
                    rows.append([rnd.choice("AB")] * width)
                for _ in range(rnd.randint(0, 2)):
                    rows.append([rnd.choice(["1", "2,5 €", "", " "]) for _ in range(rnd.choice([width, width, width + 1]))])
                doc.append((page, index, rows))
            page += rnd.choice([1, 1, 1, 1, 2])
        pieces += [(f"d{d}", *p) for p in doc]
        for name, table in expected_tables(doc).items():
            expected[(f"d{d}", name)] = table
    rnd.shuffle(pieces)
    got = merged(spark, pieces, pages_per_range)
    assert got == {k: (h, b) for k, (h, b) in expected.items()}


def test_one_huge_document(spark):
    n = 3000
    pieces = spark.range(n).select(
        F.lit("big").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page_no"), F.lit(0).alias("index_on_page"),
        F.when(F.col("id") == 0, F.array(F.array(F.lit("Teil"), F.lit("Menge")), F.array(F.lit("x"), F.lit("0"))))
        .otherwise(F.array(F.array(F.lit("x"), F.col("id").cast("string")))).alias("rows"))
    rows, headers = merge_page_tables(pieces, 64)
    assert headers.count() == 1
    r = rows.agg(F.count("*"), F.min("row_no"), F.max("row_no"), F.sum((F.col("row_no") + 1 != F.col("source_page")).cast("int"))).first()
    assert tuple(r) == (n, 0, n - 1, 0)


def test_one_huge_page(spark):
    n = 2000
    pieces = spark.range(n).select(
        F.lit("big").alias("doc_id"), F.lit(1).alias("page_no"), F.col("id").cast("int").alias("index_on_page"),
        F.array(F.array(F.lit("Teil"), F.lit("Menge")), F.array(F.lit("x"), F.col("id").cast("string"))).alias("rows"))
    more = spark.createDataFrame([("big", 2, 0, [["y", "5"]])], FRAGMENT)
    rows, headers = merge_page_tables(pieces.unionByName(more))
    assert headers.count() == n
    got = {(r.table_name, r.row_no): list(r.cells) for r in rows.collect()}
    assert len(got) == n + 1 and got[("table7", 0)] == ["x", "6"]
    assert got[(f"table{n}", 1)] == ["y", "5"]


def expected_names(header):
    given = [" ".join((h or "").split()) for h in header]
    wanted = [f"column_{i}" if g in ("", "None", "nan", "NaN") else g for i, g in enumerate(given, 1)]
    used = []
    for w in wanted:
        choices = itertools.chain([w], (f"{w}_{k}" for k in itertools.count(2)))
        used.append(next(c for c in choices if c not in used))
    return used


def test_header_names(spark):
    rnd = random.Random(3)
    pool = [None, "", "a", "a_2", "a_2_2", " a ", "b", "nan", "column_1", "column_2", "b  c"]
    lists = [[None, "Menge", None, "Menge"], ["a", "a", "a_2", "a"], []] + [
        [rnd.choice(pool) for _ in range(rnd.randint(1, 9))] for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in lists], "h array<string>")
    for r in df.select("h", unique_names(F.col("h")).alias("n")).collect():
        assert r.n == expected_names(r.h)


def expected_markdown(text):
    def cells(line):
        return [part.strip().strip("*").strip() for part in line.strip("|").split("|")]

    def is_rule(row):
        marks = [c for c in row if c]
        return bool(marks) and all(set(c.strip(":")) == {"-"} and len(c.strip(":")) > 1 and "::" not in c for c in marks)

    lines = [line.strip() for line in text.splitlines()]
    blocks = itertools.groupby(lines, key=lambda line: line[:1] == "|" and line.count("|") > 1)
    tables = [[r for r in map(cells, block) if not is_rule(r)] for piped, block in blocks if piped]
    return [t for t in tables if len(t) > 1]


def test_markdown_tables(spark):
    rnd = random.Random(5)
    parts = ["| Ware | Zahl |", "|---|:--:|", "| A | 1 |", "text", "", "|x", "||5|", "  | **b** | 2|", "\t|c|3| ", "a|b|c", "|", "||", "| -- | |"]
    ends = ["\n", "\n", "\r\n", "\r", "\x0b", " ", "\x85"]
    texts = ["| Ware | Zahl |\n|---|---|\n| A | 1 |\n| B | 2 |", "", "no table"] + [
        "".join(rnd.choice(parts) + rnd.choice(ends) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in markdown_fragments(df).collect():
        got.setdefault(r.doc_id, {})[r.index_on_page] = [list(c) for c in r.rows]
    for i, text in enumerate(texts):
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == expected_markdown(text), text


def test_long_markdown_table(spark):
    text = "| a | b |\n|--|--|\n" + "".join(f"| x{i} | {i} |\n" for i in range(50_000))
    (r,) = markdown_fragments(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert len(r.rows) == 50_001


FACTS = ("doc_id string, page_no int, n_text_chars int, n_chars int, width double, height double, "
         "images array<struct<x0:double,x1:double,top:double,bottom:double>>, n_vector int, n_tables int")


def test_page_routes(spark):
    logo, full = [(40.0, 120.0, 40.0, 90.0)], [(30.0, 565.0, 30.0, 810.0)]
    facts = spark.createDataFrame([
        ("a", 1, 60, 60, 595.0, 842.0, [], 0, 0), ("a", 2, 13, 13, 595.0, 842.0, logo, 0, 0),
        ("a", 3, 0, 0, 595.0, 842.0, full, 0, 0), ("a", 4, 18, 18, 595.0, 842.0, full, 4, 1),
        ("a", 5, 0, 0, 595.0, 842.0, [], 50, 0), ("a", 6, 0, 0, 595.0, 842.0, [], 49, 0),
        ("a", 7, 39, 39, 595.0, 842.0, full, 0, 0), ("a", 8, 40, 40, 595.0, 842.0, full, 0, 0),
        ("a", 9, 0, 0, 0.0, 842.0, [(0.0, 1.0, 0.0, 0.3)], 0, 0),
    ], FACTS)
    got = [r.route for r in page_routes(facts).orderBy("page_no").collect()]
    assert got == ["text", "text", "scan", "table", "scan", "none", "scan", "text", "scan"]


def test_pages_end_to_end(spark):
    full = [(0.0, 600.0, 0.0, 800.0)]
    facts = spark.createDataFrame([("a", 1, 50, 50, 600.0, 800.0, [], 0, 1), ("a", 2, 0, 0, 600.0, 800.0, full, 0, 0),
                                   ("a", 3, 80, 80, 600.0, 800.0, [], 0, 0), ("a", 4, 0, 0, 600.0, 800.0, [], 0, 0)], FACTS)
    ruled = spark.createDataFrame([("a", 1, 0, [["part", "qty"], ["A", "1.234"]])], FRAGMENT)
    text = spark.createDataFrame([("a", 1, "  Bestand "), ("a", 2, "Seite\n| part | qty |\n|--|--|\n| B | 2.500 |"),
                                  ("a", 3, "| kein | Scan |\n| x | 1 |"), ("a", 4, "  ")], "doc_id string, page_no int, text string")
    typed, headers, decisions, blocks = ingest_pages(facts, ruled, text)
    assert [(r.table_name, r.source_page, r.cells[0].text, r.cells[1].num) for r in typed.orderBy("row_no").collect()] == [
        ("table1", 1, "A", 1234.0), ("table1", 2, "B", 2500.0)]
    assert [(r.block_index, r.content[:12]) for r in blocks.orderBy("block_index").collect()] == [
        (0, "[page 1]\nBes"), (1, "[page 2, rea"), (2, "[page 3]\n| k")]


def test_image_transcript(spark):
    df = spark.createDataFrame([("i", "| Ware | Zahl |\n|---|---|\n| A | 1 |\n| B | 2 |")], "doc_id string, text string")
    typed, headers, _, blocks = ingest_images(df)
    assert sorted((r.cells[0].text, r.cells[1].num, r.source_page) for r in typed.collect()) == [("A", 1.0, 1), ("B", 2.0, 1)]
    assert blocks.first()["content"].startswith("| Ware")


def test_file_routes(spark):
    names = ["a.CSV", "x/b.xlsx", "c.PDF", "d.webp", "e.xyz", "noext", ".csv", "f.tar.gz", "g.", "x.y/h"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    got = {r.path: (r.route, r.reason) for r in route_files(df).collect()}
    assert [got[n][0] for n in names] == ["csv", "spreadsheet", "pdf", "image"] + ["quarantine"] * 6
    assert got["noext"][1] == "Unsupported file type: (no extension)" and got["e.xyz"][1] == "Unsupported file type: .xyz"


def test_cells_of_pieces_are_cleaned_once(spark):
    """Labels and rows read the pieces as they were written once, not the ones they were made from."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<array<string>>")
    def counted(rows):
        made.add(1)
        return rows

    pieces = spark.createDataFrame([(d, p, 0, [["Name", "Wert"], ["  a  b ", "1"], [" ", ""]]) for d in range(4) for p in range(1, 6)], FRAGMENT)
    rows, _ = merge_page_tables(pieces.withColumn("rows", counted("rows")))
    assert {tuple(r.cells) for r in rows.collect()} == {("a b", "1")}
    assert made.value == 20
