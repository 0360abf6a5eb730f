"""Numbers, identifiers, names, blanks, typing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sheetwright.functions import numbers as N
from sheetwright.functions import text as X
from sheetwright.functions.headers import looks_like_header, sheet_table_names, unique_names
from sheetwright.operators import clean, profile, questions as Q

from .registry import query
from .render import german, german_lineitem, spread, table, us, with_unit

MONEY = {"identifier_mode": "digits_only"}


def _sum_by_flag(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy("l_returnflag").agg(F.round(F.sum(col), 2).alias("total"), F.count(col).alias("n"))


PRICE_BY_FLAG = """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*) AS n
    FROM lineitem GROUP BY l_returnflag"""


@query("german_sum", PRICE_BY_FLAG)
def german_sum(spark, sf):
    df = german_lineitem(spark, sf).select("l_returnflag", "price")
    return _sum_by_flag(clean.normalize_table(df, ["price"], **MONEY), "price")


@query("us_sum", PRICE_BY_FLAG)
def us_sum(spark, sf):
    df = spread(table(spark, sf, "lineitem")).select(
        "l_returnflag", with_unit(us(F.col("l_extendedprice")), F.col("l_orderkey")).alias("price"))
    return _sum_by_flag(clean.normalize_table(df, ["price"], **MONEY), "price")


@query("ambiguous_sum", """SELECT o_orderstatus, CAST(sum(o_custkey) AS DOUBLE) AS total, count(*) AS n
    FROM orders GROUP BY o_orderstatus""")
def ambiguous_sum(spark, sf):
    df = table(spark, sf, "orders").select("o_orderstatus", german(F.col("o_custkey"), 0).alias("amount"))
    out = clean.normalize_table(df, ["amount"], **MONEY)
    return out.groupBy("o_orderstatus").agg(F.sum("amount").alias("total"), F.count("amount").alias("n"))


@query("strip_units", """SELECT l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice) AS amount FROM lineitem""")
def strip_units(spark, sf):
    li = table(spark, sf, "lineitem")
    text = with_unit(F.replace(us(F.col("l_extendedprice")), F.lit(","), F.lit("")), F.col("l_orderkey"))
    return li.select("l_orderkey", "l_linenumber", N.strip_units(text).alias("amount"))


@query("parse_number", """SELECT l_returnflag, l_linestatus,
        round(sum(l_extendedprice), 2) AS german, round(sum(l_quantity), 2) AS us, round(sum(l_discount), 2) AS plain,
        CAST(0 AS BIGINT) AS n_words
    FROM lineitem GROUP BY ALL""")
def parse_number(spark, sf):
    li = table(spark, sf, "lineitem")
    parsed = li.select(
        "l_returnflag", "l_linestatus",
        N.parse_number(german(F.col("l_extendedprice")), "german").alias("german"),
        N.parse_number(us(F.col("l_quantity")), "us").alias("us"),
        N.parse_number(F.col("l_discount").cast("string"), "plain").alias("plain"),
        N.parse_number(F.concat(F.col("l_returnflag"), F.lit("1")), "german").alias("word"),
    )
    return parsed.groupBy("l_returnflag", "l_linestatus").agg(
        *[F.round(F.sum(c), 2).alias(c) for c in ("german", "us", "plain")], F.count("word").alias("n_words"))


def _format_rows(spark, sf):
    o = spread(table(spark, sf, "orders"))
    price = F.col("o_totalprice")
    cells = F.array(
        german(price), us(price), german(F.col("o_custkey") + 1000, 0),
        F.when(F.col("o_orderkey") % 2 == 0, german(price)).otherwise(us(price)),
        F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.lit(" "),
    )
    return o.select(
        F.col("o_orderpriority").alias("doc_id"), F.lit("data").alias("table_name"),
        F.col("o_orderkey").alias("row_no"), cells.alias("cells"))


@query("number_format", """SELECT doc_id, col_no, fmt, n_filled
    FROM (SELECT o_orderpriority AS doc_id, count(*) AS n_filled FROM orders GROUP BY 1),
         (VALUES (0, 'german'), (1, 'us'), (2, 'german'), (3, 'unknown'), (4, 'unknown'), (5, 'german')) f(col_no, fmt)""")
def number_format(spark, sf):
    return profile.column_stats(_format_rows(spark, sf)).select("doc_id", "col_no", "fmt", "n_filled")


@query("column_types", """SELECT doc_id, col_no, type
    FROM (SELECT DISTINCT o_orderpriority AS doc_id FROM orders),
         (VALUES (0, 'number'), (1, 'number'), (2, 'number'), (3, 'text'), (4, 'text'), (5, 'number')) f(col_no, type)""")
def column_types(spark, sf):
    return profile.column_decisions(_format_rows(spark, sf), **MONEY).select("doc_id", "col_no", "type")


@query("convert_gate", """SELECT o_orderstatus AS doc_id,
        CAST(sum(CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey END) AS DOUBLE) AS few_words,
        CAST(NULL AS DOUBLE) AS many_words, count(*) AS n_rows
    FROM orders GROUP BY 1""")
def convert_gate(spark, sf):
    """5 % words still make a number column, 15 % do not."""
    o = table(spark, sf, "orders")
    key, amount = F.col("o_orderkey"), german(F.col("o_custkey"), 0)
    rows = o.select(
        F.col("o_orderstatus").alias("doc_id"), F.lit("data").alias("table_name"), key.alias("row_no"),
        F.array(
            F.when(key % 20 == 0, "entfällt").otherwise(amount),
            F.when(key % 20 < 3, "entfällt").otherwise(amount),
        ).alias("cells"))
    typed, _ = clean.normalize_rows(rows, **MONEY)
    return typed.groupBy("doc_id").agg(
        F.sum(F.col("cells")[0]["num"]).alias("few_words"), F.sum(F.col("cells")[1]["num"]).alias("many_words"),
        F.count("*").alias("n_rows"))


def _part_rows(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("doc_id"), F.lit("data").alias("table_name"), key.alias("row_no"),
        F.array(
            F.when(key % 3 == 0, F.lpad(key.cast("string"), 7, "0")).otherwise(F.concat(F.lit("9"), key.cast("string"))),
            F.col("p_name"), (key + 40000000).cast("string"),
            F.when(key % 10 < 4, key.cast("string")).otherwise((key + 40000000).cast("string")),
            german(F.col("p_retailprice")),
        ).alias("cells"))


_IDENTIFIER_SQL = """
    WITH v AS (
        SELECT p_brand AS doc_id, unnest([0, 1, 2, 3, 4]) AS col_no, unnest([
            CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 7, '0') ELSE '9' || p_partkey END,
            p_name, CAST(p_partkey + 40000000 AS VARCHAR),
            CASE WHEN p_partkey % 10 < 4 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey + 40000000 AS VARCHAR) END,
            translate(format('{:,.2f}', p_retailprice), ',.', '.,')]) AS v
        FROM part)
    SELECT doc_id, col_no,
           avg(CASE WHEN regexp_full_match(v, '0\\d+') THEN 1 ELSE 0 END) > 0.3
           OR (avg(CASE WHEN length(v) >= 8 THEN 1 ELSE 0 END) > 0.7 AND count(DISTINCT v) / count(*) > 0.95) AS identifier
    FROM v GROUP BY 1, 2"""


@query("identifier_columns", _IDENTIFIER_SQL)
def identifier_columns(spark, sf):
    return profile.column_decisions(_part_rows(spark, sf), all_identifiers=True).select("doc_id", "col_no", "identifier")


@query("profile_two_batches", _IDENTIFIER_SQL)
def profile_two_batches(spark, sf):
    """The same from the states of three batches that are put together; rows are read again for open questions only."""
    rows = _part_rows(spark, sf)
    states = [profile.column_state(rows.where(F.col("row_no") % 3 == i)) for i in range(3)]
    state = profile.merged_states([profile.merged_states(states[:2]), states[2]])
    return profile.state_decisions(state, rows, all_identifiers=True).select("doc_id", "col_no", "identifier")


@query("typed_cells_keep_numbers", """SELECT o_orderstatus AS doc_id, round(sum(o_totalprice), 2) AS total,
        CAST(sum(o_custkey) AS DOUBLE) AS customers, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_day,
        count(*) FILTER (o_custkey % 2 = 0) AS n_even
    FROM orders GROUP BY 1""")
def typed_cells_keep_numbers(spark, sf):
    """Workbook cells: real numbers are not parsed again, dates and flags stay."""
    o = table(spark, sf, "orders")
    is_text = F.col("o_orderkey") % 4 == 0
    price = F.col("o_totalprice")
    rows = o.select(
        F.col("o_orderstatus").alias("doc_id"), F.lit("Sheet1").alias("table_name"), F.col("o_orderkey").alias("row_no"),
        F.array(
            profile.typed_cell(text=F.when(is_text, german(price)), num=F.when(~is_text, price)),
            profile.typed_cell(num=F.col("o_custkey")),
            profile.typed_cell(ts=F.col("o_orderdate").cast("timestamp")),
            profile.typed_cell(flag=F.col("o_custkey") % 2 == 0),
        ).alias("cells"))
    typed, _ = clean.normalize_rows(rows, **MONEY)
    c = F.col("cells")
    return typed.groupBy("doc_id").agg(
        F.round(F.sum(c[0]["num"]), 2).alias("total"), F.sum(c[1]["num"]).alias("customers"),
        F.date_format(F.min(c[2]["ts"]), "yyyy-MM-dd").alias("first_day"),
        F.count(F.when(c[3]["flag"], 1)).alias("n_even"))


@query("normalize_cells", """
    WITH v AS (
        SELECT p_brand AS doc_id, unnest([0, 3, 4]) AS col_no,
               unnest([CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE CAST('9' || p_partkey AS BIGINT) END,
                       CASE WHEN p_partkey % 10 < 4 THEN p_partkey ELSE p_partkey + 40000000 END, p_retailprice]) AS num
        FROM part),
    zeros AS (SELECT p_brand AS doc_id, avg(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS z,
                     avg(CASE WHEN p_partkey % 10 >= 4 THEN 1 ELSE 0 END) AS long FROM part GROUP BY 1)
    SELECT v.doc_id, v.col_no, round(sum(num), 2) AS total, count(*) AS n
    FROM v JOIN zeros USING (doc_id) WHERE NOT (col_no = 0 AND z > 0.3) AND NOT (col_no = 3 AND long > 0.7) GROUP BY 1, 2""")
def normalize_cells(spark, sf):
    """Many tables typed at once; codes stay text and so have no total."""
    typed, _ = clean.normalize_rows(_part_rows(spark, sf), **MONEY)
    totals = Q.all_totals(clean.to_cells(typed))
    return totals.select("doc_id", "col_no", F.round("total", 2).alias("total"), "n")


@query("blank_to_null", """SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN ' ' || o_orderpriority END AS value FROM orders""")
def blank_to_null(spark, sf):
    value = (F.when(F.col("o_custkey") % 6 == 0, F.lit("  \t")).when(F.col("o_custkey") % 3 == 0, F.lit(""))
             .otherwise(F.concat(F.lit(" "), F.col("o_orderpriority"))))
    return table(spark, sf, "orders").select("o_orderkey", X.blank_to_null(value).alias("value"))


@query("drop_empty", """SELECT CAST(o_orderkey AS VARCHAR) AS order_no, CASE WHEN o_custkey % 4 = 0 THEN o_orderstatus END AS status
    FROM orders WHERE o_custkey % 3 <> 0""")
def drop_empty(spark, sf):
    """Rows of blanks go, then the column that is blank throughout."""
    keep = F.col("o_custkey") % 3 != 0
    df = table(spark, sf, "orders").select(
        F.when(keep, F.col("o_orderkey").cast("string")).otherwise(F.lit(" ")).alias("order_no"),
        F.when(keep & (F.col("o_custkey") % 4 == 0), F.col("o_orderstatus")).otherwise(F.lit("")).alias("status"),
        F.lit("  ").alias("nothing"))
    return clean.drop_empty(df)


@query("renumbered_rows", """SELECT o_orderstatus AS doc_id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS row_no,
        CAST(o_orderkey AS VARCHAR) AS order_no FROM orders WHERE o_custkey % 3 <> 0""")
def renumbered_rows(spark, sf):
    keep = F.col("o_custkey") % 3 != 0
    rows = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("doc_id"), F.lit("data").alias("table_name"), F.col("o_orderkey").alias("row_no"),
        F.array(F.when(keep, F.col("o_orderkey").cast("string")).otherwise(F.lit(" ")), F.lit("")).alias("cells"))
    kept = clean.renumber(clean.drop_empty_rows(rows))
    return kept.select("doc_id", "row_no", F.col("cells")[0].alias("order_no"))


@query("header_names", """
    WITH h AS (
        SELECT p_partkey, unnest([1, 2, 3, 4, 5, 6]) AS pos,
               unnest([p_type, '', p_brand, p_type, split_part(p_name, ' ', 1), p_brand]) AS raw FROM part),
    n AS (SELECT p_partkey, pos, CASE WHEN raw = '' THEN 'column_' || pos ELSE raw END AS base FROM h),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, base ORDER BY pos) AS k FROM n)
    SELECT p_partkey, pos, CASE WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM k""")
def header_names(spark, sf):
    first_word = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    header = F.array(F.concat(F.lit(" "), "p_type"), F.lit("  "), "p_brand", "p_type", first_word, "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.posexplode(unique_names(header)).alias("i", "name")).select(
        "p_partkey", (F.col("i") + 1).alias("pos"), "name")


@query("header_rows", """SELECT p_partkey, p_size % 3 = 0 AS is_header FROM part""")
def header_rows(spark, sf):
    """Is a row a header: words only, or with a number among them."""
    size = F.col("p_size")
    row = F.array("p_name", F.when(size % 3 == 0, F.lit("")).when(size % 3 == 1, german(F.col("p_retailprice")))
                  .otherwise(F.concat(F.lit("- "), size.cast("string"), F.lit(" €"))))
    return table(spark, sf, "part").select("p_partkey", looks_like_header(row).alias("is_header"))


@query("cell_text", r"""SELECT doc_id, md5(trim(regexp_replace(text, '[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS hash
    FROM documents""")
def cell_text(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("hash"))


@query("safe_names", """SELECT p_partkey, regexp_replace(p_name || '.' || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS table_name,
        regexp_replace(p_name || '.' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS file_name FROM part""")
def safe_names(spark, sf):
    name = F.concat("p_name", F.lit("."), "p_brand")
    return table(spark, sf, "part").select(
        "p_partkey", X.safe_table_name(name).alias("table_name"), X.safe_file_name(name).alias("file_name"))


@query("table_profile", """SELECT doc_id, col_no, name, CASE WHEN (col_no = 0 AND z > 0.3) OR (col_no = 3 AND long > 0.7) THEN 'text' ELSE type END AS type, n_rows
    FROM (SELECT p_brand AS doc_id, count(*) AS n_rows, avg(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS z,
                 avg(CASE WHEN p_partkey % 10 >= 4 THEN 1 ELSE 0 END) AS long FROM part GROUP BY 1),
         (VALUES (0, 'Teil', 'number'), (1, 'Name', 'text'), (2, 'column_3', 'text'), (3, 'Teil_2', 'number'), (4, 'Preis', 'number')) c(col_no, name, type)""")
def table_profile(spark, sf):
    rows = _part_rows(spark, sf)
    headers = rows.select("doc_id", "table_name").distinct().withColumn(
        "header", F.array(*[F.lit(x) for x in ("Teil", "Name", "", "Teil", "Preis")]))
    decisions = profile.column_decisions(rows, **MONEY)
    return profile.table_profile(rows, decisions, headers).select("doc_id", "col_no", "name", "type", "n_rows")


@query("table_sample", """SELECT doc_id, p_partkey, place FROM (
        SELECT p_brand AS doc_id, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS place FROM part)
    WHERE place <= 5""")
def table_sample(spark, sf):
    sample = profile.table_sample(_part_rows(spark, sf))
    return sample.select("doc_id", F.col("row_no").alias("p_partkey"), "place")


@query("doc_tables", """SELECT lang AS doc_id, source AS table_name, count(*) AS n_rows, false AS is_text FROM documents GROUP BY 1, 2
    UNION ALL SELECT lang, 'document_text', CAST(sum(len(string_split(text, chr(10)))) AS BIGINT), true FROM documents GROUP BY 1""")
def doc_tables(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("lang").alias("doc_id"), F.col("source").alias("table_name"))
    blocks = d.select(F.col("lang").alias("doc_id"), F.explode(F.split("text", "\n")).alias("content"))
    return profile.doc_tables(rows, blocks)


@query("sheet_names", """
    WITH h AS (SELECT p_partkey, unnest([1, 2, 3, 4]) AS pos,
                      unnest([p_name, p_type, replace(p_name, ' ', '-'), 'document text']) AS raw FROM part),
    n AS (SELECT p_partkey, pos, regexp_replace(raw, '[^A-Za-z0-9_]', '_', 'g') AS base FROM h),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, base ORDER BY pos) AS k FROM n)
    SELECT p_partkey, pos, CASE WHEN base = 'document_text' THEN 'document_text_2' WHEN k = 1 THEN base ELSE base || '_' || k END AS name FROM k""")
def sheet_names(spark, sf):
    """Sheets whose safe names collide, or that would hide the text blocks."""
    sheets = F.array("p_name", "p_type", F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("document text"))
    named = table(spark, sf, "part").select("p_partkey", F.posexplode(sheet_table_names(sheets)).alias("i", "name"))
    return named.select("p_partkey", (F.col("i") + 1).alias("pos"), "name")
