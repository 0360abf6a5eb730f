"""Number formats, conversion gate, identifiers, typed cells."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sheetwright.functions import numbers as N
from sheetwright.functions.text import SPACE_CHARS, is_filled
from sheetwright.operators.clean import apply_decisions, drop_empty, normalize_rows, normalize_table, renumber, to_cells
from sheetwright.operators.profile import column_decisions, column_stats, typed_cell


def rows_of(spark, *columns):
    data = [("d", "t", i, list(r)) for i, r in enumerate(zip(*columns))]
    return spark.createDataFrame(data, "doc_id string, table_name string, row_no bigint, cells array<string>")


def converted(spark, *columns, **kw):
    typed, decisions = normalize_rows(rows_of(spark, *columns), **kw)
    got = typed.orderBy("row_no").collect()
    types = {r.col_no: r.type for r in decisions.collect()}
    out = []
    for i in range(len(columns)):
        field = {"number": "num", "text": "text"}.get(types.get(i), "text")
        out.append([r.cells[i][field] for r in got])
    return out


@pytest.mark.parametrize("given,expected", [
    (["4.321,09", "1.600,00", "88,50"], [4321.09, 1600.0, 88.5]),
    (["3.210", "4.700", "650"], [3210.0, 4700.0, 650.0]),
    (["6,543.10", "3,000.75", "21.5"], [6543.1, 3000.75, 21.5]),
    (["9.876,54 €", "31,00 EUR", "4 Stk."], [9876.54, 31.0, 4.0]),
    (["-1.234,5", "eur 7", "$ 8"], [-1234.5, 7.0, 8.0]),
    (["abc", "de", "f"], ["abc", "de", "f"]),
    (["1e3", "2", "1_000"], [1000.0, 2.0, 1000.0]),
    (["0077001", "0077002", "77"], ["0077001", "0077002", "77"]),
])
def test_columns(spark, given, expected):
    assert converted(spark, given)[0] == expected


def test_default_us(spark):
    assert converted(spark, ["1.234", "2.500", "750"], default="us")[0] == [1.234, 2.5, 750.0]


def test_both_formats_are_parsed_plainly(spark):
    # 19 plain US values and one German one: 95 % parse, the odd one is lost.
    assert converted(spark, ["12.5"] * 19 + ["1,5"])[0] == [12.5] * 19 + [None]
    assert converted(spark, ["12.5"] * 5 + ["1,5"] * 5)[0] == ["12.5"] * 5 + ["1,5"] * 5


@pytest.mark.parametrize("words,kind", [(1, "number"), (2, "text")])
def test_gate_at_nine_tenths(spark, words, kind):
    column = ["5"] * (10 - words) + ["x"] * words
    _, decisions = normalize_rows(rows_of(spark, column))
    assert decisions.first()["type"] == kind


@pytest.mark.parametrize("n_zero,kind", [(3, "number"), (4, "text")])
def test_leading_zero_share_is_strict(spark, n_zero, kind):
    column = ["01"] * n_zero + ["7"] * (10 - n_zero)
    _, decisions = normalize_rows(rows_of(spark, column))
    assert decisions.first()["type"] == kind


@pytest.mark.parametrize("n_long,kind", [(7, "number"), (8, "text")])
def test_long_share_is_strict(spark, n_long, kind):
    column = [str(10_000_000 + i) for i in range(n_long)] + [str(i) for i in range(1, 11 - n_long)]
    _, decisions = normalize_rows(rows_of(spark, column))
    assert decisions.first()["type"] == kind


@pytest.mark.parametrize("n,same,kind", [(20, 2, "number"), (40, 2, "text")])
def test_unique_share_is_strict(spark, n, same, kind):
    # 19 of 20 different is exactly 0.95 and not enough; 39 of 40 is.
    column = [str(10_000_000 + max(i, same - 1)) for i in range(n)]
    _, decisions = normalize_rows(rows_of(spark, column))
    assert decisions.first()["type"] == kind


def test_unique_amounts_depend_on_the_mode(spark):
    amounts = ["1.234,56", "2.500,00", "3.999,00"]
    assert converted(spark, amounts)[0] == amounts
    assert converted(spark, amounts, identifier_mode="digits_only")[0] == [1234.56, 2500.0, 3999.0]
    eans = ["40000001", "40000002", "40000003"]
    assert converted(spark, eans, identifier_mode="digits_only")[0] == eans


def test_real_numbers_and_dates_are_kept(spark):
    data = spark.createDataFrame(
        [("a", 0, None, 1.125, "2026-01-05 00:00:00", True), ("a", 1, None, 3.375, "2026-02-10 00:00:00", False),
         ("a", 2, "2.500", None, "2026-02-10 00:00:00", None)],
        "doc_id string, row_no bigint, t string, n double, d string, f boolean",
    )
    rows = data.select(
        "doc_id", F.lit("s").alias("table_name"), "row_no",
        F.array(
            typed_cell(text=F.col("t"), num=F.col("n")),
            typed_cell(ts=F.to_timestamp("d")),
            typed_cell(flag=F.col("f")),
        ).alias("cells"),
    )
    typed, decisions = normalize_rows(rows)
    got = typed.orderBy("row_no").collect()
    assert [r.cells[0].num for r in got] == [1.125, 3.375, 2500.0]
    assert {r.col_no: r.type for r in decisions.collect()} == {0: "number", 1: "timestamp", 2: "boolean"}
    assert got[0].cells[1].ts.day == 5 and got[1].cells[2].flag is False and got[2].cells[2].flag is None
    assert to_cells(typed).count() == 3 + 3 + 2


def test_flags_among_text_count_as_one_and_zero(spark):
    data = spark.createDataFrame([(0, True, None), (1, None, "5")], "row_no bigint, f boolean, t string")
    rows = data.select(
        F.lit("d").alias("doc_id"), F.lit("t").alias("table_name"), "row_no",
        F.array(typed_cell(flag=F.col("f"), text=F.col("t"))).alias("cells"),
    )
    typed, _ = normalize_rows(rows)
    assert [r.cells[0].num for r in typed.orderBy("row_no").collect()] == [1.0, 5.0]


REWRITE = {"german": {".": "", ",": "."}, "us": {",": ""}, "plain": {}}


def expected_number(value, fmt):
    """What Python's float() makes of a value once units and separators are out."""
    bare = re.sub(r"(?i)eur|stk\.?|st\.", "", value)
    bare = "".join(c for c in bare if not c.isspace() and c not in "€$£%").translate(str.maketrans(REWRITE[fmt]))
    try:
        number = float(bare)
    except ValueError:
        return None
    return number if number == number else None


def test_random_values_parse_like_python(spark):
    rnd = random.Random(7)
    alphabet = "0123456789.,.,-+eE_ €%   xfdEUR"
    values = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    values += ["inf", "-Infinity", "nan", "1.0d", "1.0f", "1_0", "1__0", "_1", ".5", "5.", ".", "+.5e-3", "12 Stk", "St. 4", "Stk.5"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", *[N.parse_number(F.col("v"), f).alias(f) for f in N.FORMATS]).collect()
    for r in got:
        for f in N.FORMATS:
            assert r[f] == expected_number(r.v, f), (r.v, f)


def test_wide_table(spark):
    df = spark.createDataFrame(
        [("0077001", "3.400", "0,35 €", 1, " "), ("0077002", "910", "21,75 €", 2, None), ("0077003", "5.100", " ", 3, "")],
        "Nummer string, Menge string, Preis string, n int, leer string",
    )
    out = normalize_table(drop_empty(df))
    assert out.columns == ["Nummer", "Menge", "Preis", "n"]
    assert [tuple(r) for r in out.orderBy("n").collect()] == [
        ("0077001", 3400.0, 0.35, 1), ("0077002", 910.0, 21.75, 2), ("0077003", 5100.0, None, 3)]


def test_empty_rows_go_and_numbers_are_dense(spark):
    rows = rows_of(spark, ["a", " ", None, "b"], ["1", "", None, None])
    typed, _ = normalize_rows(rows)
    kept = renumber(typed)
    assert [(r.row_no, r.cells[0].text) for r in kept.orderBy("row_no").collect()] == [(0, "a"), (1, "b")]


def test_tables_do_not_mix(spark):
    rows = rows_of(spark, ["1.234", "2.500"]).unionByName(
        rows_of(spark, ["1.23", "2.5"]).withColumn("doc_id", F.lit("e")))
    typed, _ = normalize_rows(rows)
    got = sorted((r.doc_id, r.row_no, r.cells[0].num) for r in typed.collect())
    assert got == [("d", 0, 1234.0), ("d", 1, 2500.0), ("e", 0, 1.23), ("e", 1, 2.5)]


def test_numbers_as_text_have_no_exponent(spark):
    from sheetwright.operators.profile import as_text

    rows = [(12345678.5,), (1e-5,), (2.5,), (3.0,), (1.5e20,)]
    none = [F.lit(None).cast(t) for t in ("string", "timestamp", "boolean")]
    got = spark.createDataFrame(rows, "n double").select(as_text(none[0], F.col("n"), none[1], none[2]).alias("t")).collect()
    assert [r.t for r in got] == ["12345678.5", "0.00001", "2.5", "3", "150000000000000000000"]


def test_quick_tests_agree_with_the_patterns(spark):
    """What the first test of a number turns down is a number under no format; a filled value is told by any of its characters."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("0123456789.,-+_eEinfINFtyA ") for _ in range(rnd.randint(1, 7))) for _ in range(4000)]
    texts += ["inf", "-Infinity", "+.5", ",5", "1e5", "-1.234,56", "", "iNf", "1_0"]
    found = F.lit(False)
    for fmt in N.FORMATS:
        found = found | N.is_number(N.to_plain(F.col("t"), fmt))
    found = found | F.col("t").rlike(N.GERMAN_SHAPE) | F.col("t").rlike(N.US_SHAPE)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(found & ~N.may_be_number(F.col("t"))).isEmpty() and df.where(found).count() > 100
    chars = [chr(i) for i in range(1, 0x3100)] + ["😀", "", None] + [a + b for a in "a  \x7f!~" for b in "b 　é"]
    for r in spark.createDataFrame([(c,) for c in chars], "t string").select("t", is_filled(F.col("t")).alias("f")).collect():
        assert r.f == bool(r.t and r.t.strip(SPACE_CHARS)), repr(r.t)
