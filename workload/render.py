"""Messy inputs rendered from the driver tables, so that the SQL check can
read the clean originals. Every rendering is a projection of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheetwright.plans.session import new_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input that is a single row group or so.

    The test files are read by one to three tasks whatever the cores. An input
    of at least as many splits as cores, as any large one, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def german(c: Column, places: int = 2) -> Column:
    """1234.5 as 1.234,50"""
    return F.translate(F.format_number(c, places), ",.", ".,")


def us(c: Column, places: int = 2) -> Column:
    return F.format_number(c, places)


def with_unit(text: Column, key: Column) -> Column:
    """A unit in front or behind, by key."""
    return (
        F.when(key % 5 == 0, F.concat(text, F.lit(" €")))
        .when(key % 5 == 1, F.concat(text, F.lit(" EUR")))
        .when(key % 5 == 2, F.concat(F.lit("€ "), text))
        .when(key % 5 == 3, F.concat(text, F.lit(" Stk.")))
        .otherwise(F.concat(F.lit("  "), text, F.lit("\t")))
    )


def german_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Line items whose numbers are German text."""
    li = spread(table(spark, sf, "lineitem"))
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate",
        with_unit(german(F.col("l_extendedprice")), F.col("l_orderkey")).alias("price"),
        german(F.col("l_quantity"), 0).alias("quantity"),
        german(F.col("l_discount")).alias("discount"),
    )


def order_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per order, a hundred pages per document, two rows per page.

    A page may start with one of two headers, so tables run on, repeat their
    header, or give way to another table of the same width.
    """
    o = spread(table(spark, sf, "orders"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    page_no = (key % 100 + 1).cast("int")

    def row(*cells: Column) -> Column:
        return F.array(*cells)

    body = F.array(
        row(F.concat(F.lit("Kunde "), cust.cast("string")), F.col("o_orderpriority"), german(F.col("o_totalprice"))),
        row(F.concat(F.lit("  Nr.  "), key.cast("string")), F.col("o_orderstatus"), german(cust.cast("double"))),
    )
    second = F.array(row(F.lit("Posten"), F.lit("Art"), F.lit("Wert")))
    first = F.array(row(F.lit("Kunde"), F.lit("Art"), F.lit(" Betrag ")))
    rows = (
        F.when(cust % 11 == 0, F.concat(second, body))
        .when((key % 100 == 0) | (cust % 5 == 0), F.concat(first, body))
        .otherwise(body)
    )
    return o.select(
        F.floor(key / 100).alias("doc_id"), page_no.alias("page_no"), F.lit(0).alias("index_on_page"), rows.alias("rows")
    )


# The same layout in SQL: page, current header, table number, straight from orders.
ORDER_PAGES_SQL = """
    pages AS (
        SELECT o_orderkey // 100 AS doc_id, o_orderkey % 100 + 1 AS page_no, o_orderkey, o_custkey,
               o_orderpriority, o_orderstatus, o_totalprice,
               CASE WHEN o_custkey % 11 = 0 THEN 2
                    WHEN o_orderkey % 100 = 0 OR o_custkey % 5 = 0 THEN 1 END AS head
        FROM orders
    ),
    heads AS (
        SELECT *, last_value(head IGNORE NULLS) OVER (
                   PARTITION BY doc_id ORDER BY page_no
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM pages
    ),
    numbered AS (
        SELECT *, sum(CASE WHEN head IS NOT NULL AND head IS DISTINCT FROM before THEN 1 ELSE 0 END)
                   OVER (PARTITION BY doc_id ORDER BY page_no) AS table_no
        FROM heads
    )
"""


def chat_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events as attachments (signup) and questions (view) of chats (users)."""
    e = table(spark, sf, "events")
    attached = e.where("event_type = 'signup'").select(
        F.col("user_id").alias("chat_id"), "ts", F.col("event_id").alias("seq"), F.col("event_id").alias("doc_id")
    )
    asked = e.where("event_type = 'view'").select(F.col("user_id").alias("chat_id"), "ts", "event_id")
    return attached, asked


def supplier_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as one-row markdown tables inside a sentence each."""
    s = table(spark, sf, "supplier")
    text = F.concat(
        F.lit("Seite des Lieferanten\n\n| Name | **Land** | Saldo |\n|:---|---|---:|\n| "),
        F.col("s_name"), F.lit(" | "), F.col("s_nationkey").cast("string"), F.lit(" | "),
        german(F.col("s_acctbal")), F.lit(" |\nEnde | der Seite\r\n  | Nr | \n| "),
        F.col("s_suppkey").cast("string"), F.lit(" |\n\n| allein |\n"),
    )
    return s.select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))


def write_supplier_files(spark: SparkSession, sf: str) -> str:
    """Suppliers as ';'-separated files, one per nation, each of them twice."""
    s = table(spark, sf, "supplier")
    path = new_path(spark, "supplier-files")
    copies = s.select(
        F.col("s_suppkey"), F.col("s_name"), german(F.col("s_acctbal")).alias("saldo"),
        F.col("s_nationkey").alias("nation"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"),
    )
    (
        copies.repartition("copy", "nation").sortWithinPartitions("copy", "nation", "s_suppkey")
        .write.partitionBy("copy", "nation").option("sep", ";").option("header", True).csv(path)
    )
    return path


def write_part_files(spark: SparkSession, sf: str) -> str:
    """Parts as delimited files in four separators and two encodings."""
    p = table(spark, sf, "part")
    path = new_path(spark, "part-files")
    cols = [F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("Teil"),
            F.concat(F.col("p_name"), F.lit(', "groß"')).alias("Name"), F.col("p_brand"),
            german(F.col("p_retailprice")).alias("Preis")]
    for i, (sep, charset) in enumerate([(";", "ISO-8859-1"), ("\t", "UTF-8"), (",", "UTF-8"), ("|", "ISO-8859-1")]):
        (
            p.where(F.col("p_size") % 4 == i).select(*cols).write
            .option("sep", sep).option("header", True).option("encoding", charset).option("escape", '"')
            .csv(f"{path}/{i}")
        )
    return path
