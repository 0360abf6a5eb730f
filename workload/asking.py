"""Questions on whole, cleaned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwright.operators import clean, questions as Q, results

from .registry import query
from .render import german, german_lineitem, spread, table


def _cleaned(spark, sf, *columns):
    """Line items with German text turned back into numbers."""
    df = german_lineitem(spark, sf).select(*columns)
    return clean.normalize_table(df, [c for c in columns if c in ("price", "quantity", "discount")], "digits_only")


def _rounded(df, *cols):
    return df.select(*[F.round(c, 2).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("q_total", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem")
def q_total(spark, sf):
    return _rounded(Q.total(_cleaned(spark, sf, "price"), "price"), "total")


@query("q_filtered_total", "SELECT sum(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= DATE '1996-01-01'")
def q_filtered_total(spark, sf):
    df = _cleaned(spark, sf, "quantity", "l_returnflag", "l_shipdate")
    return Q.total(df, "quantity", (F.col("l_returnflag") == "A") & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("date")))


@query("q_value", "SELECT round(sum(l_quantity * l_extendedprice)) AS total FROM lineitem")
def q_value(spark, sf):
    value = Q.total_product(_cleaned(spark, sf, "quantity", "price"), "quantity", "price")
    return value.select(F.round("total").alias("total"))


@query("q_distinct", "SELECT count(DISTINCT l_extendedprice) AS n FROM lineitem")
def q_distinct(spark, sf):
    return Q.n_distinct(_cleaned(spark, sf, "price"), "price")


@query("q_distinct_approx", "SELECT count(DISTINCT l_partkey) AS n, true AS near FROM lineitem")
def q_distinct_approx(spark, sf):
    """Distinct parts counted, and whether the estimate is within 10 % of that."""
    li = table(spark, sf, "lineitem")
    estimate = Q.n_distinct(li, "l_partkey", approx=True).scalar()
    return Q.n_distinct(li, "l_partkey").select("n", (F.abs(estimate - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query("q_group_total", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q_group_total(spark, sf):
    return Q.total_by(_cleaned(spark, sf, "l_returnflag", "l_linestatus", "quantity"), ["l_returnflag", "l_linestatus"], "quantity")


@query("q_having", "SELECT l_suppkey, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 15000")
def q_having(spark, sf):
    return Q.total_by(_cleaned(spark, sf, "l_suppkey", "quantity"), ["l_suppkey"], "quantity").where("total > 15000")


@query("q_largest", "SELECT o_orderkey, o_totalprice AS value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def q_largest(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", german(F.col("o_totalprice")).alias("price"))
    return Q.largest(clean.normalize_table(df, identifier_mode="digits_only"), "price", "o_orderkey")


@query("q_smallest", "SELECT o_orderkey, o_totalprice AS value FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def q_smallest(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", german(F.col("o_totalprice")).alias("price"))
    return Q.largest(clean.normalize_table(df, identifier_mode="digits_only"), "price", "o_orderkey", smallest=True)


@query("q_most_frequent", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def q_most_frequent(spark, sf):
    return Q.most_frequent(table(spark, sf, "part"), "p_name")


@query("q_count", "SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.05")
def q_count(spark, sf):
    return Q.n_rows(_cleaned(spark, sf, "discount"), F.col("discount") > 0.05)


def _order_docs(spark, sf):
    """Every customer's orders as a document of its own."""
    o = spread(table(spark, sf, "orders"))
    return o.select(
        F.col("o_custkey").alias("doc_id"), F.lit("data").alias("table_name"), F.col("o_orderkey").alias("row_no"),
        F.array(F.col("o_orderpriority"), german(F.col("o_totalprice")), german(F.col("o_orderkey") % 1000, 0),
                F.col("o_orderstatus")).alias("cells"))


@query("q_all_docs_totals", """SELECT doc_id, col_no, round(sum(v), 2) AS total, min(v) AS smallest, max(v) AS largest, count(*) AS n
    FROM (SELECT o_custkey AS doc_id, unnest([1, 2]) AS col_no, unnest([o_totalprice, CAST(o_orderkey % 1000 AS DOUBLE)]) AS v FROM orders)
    GROUP BY 1, 2""")
def q_all_docs_totals(spark, sf):
    typed, _ = clean.normalize_rows(_order_docs(spark, sf), "digits_only")
    return _rounded(Q.all_totals(clean.to_cells(typed)), "total").drop("table_name")


@query("q_all_docs_frequent", """SELECT doc_id, col_no, value, n FROM (
        SELECT doc_id, col_no, value, count(*) AS n, row_number() OVER (PARTITION BY doc_id, col_no ORDER BY count(*) DESC, value) AS r
        FROM (SELECT o_custkey AS doc_id, unnest([0, 3]) AS col_no, unnest([o_orderpriority, o_orderstatus]) AS value FROM orders)
        GROUP BY 1, 2, 3) WHERE r = 1""")
def q_all_docs_frequent(spark, sf):
    typed, _ = clean.normalize_rows(_order_docs(spark, sf), "digits_only")
    return Q.all_frequent(clean.to_cells(typed)).drop("table_name")


def _headers(rows, names):
    return rows.select("doc_id", "table_name").distinct().withColumn("header", F.array(*[F.lit(n) for n in names]))


@query("q_cross_doc", "SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n, count(DISTINCT o_custkey) AS n_docs FROM orders")
def q_cross_doc(spark, sf):
    rows = _order_docs(spark, sf)
    rows = rows.withColumn("cells", F.array(F.col("cells")[0], F.col("cells")[1], F.col("cells")[3]))
    typed, decisions = clean.normalize_rows(rows, "digits_only")
    found = Q.cross_doc(clean.to_cells(typed), _headers(rows, ["Rang", "Betrag", "Status"]), decisions, "Betrag")
    return _rounded(found, "total").select("total", "n", "n_docs")


@query("q_cross_doc_by_signature", """SELECT 'orders' AS kind, round(sum(o_totalprice), 2) AS total, count(*) AS n, count(DISTINCT o_custkey) AS n_docs FROM orders
    UNION ALL SELECT 'suppliers', round(sum(s_acctbal), 2), count(*), count(DISTINCT s_nationkey) FROM supplier""")
def q_cross_doc_by_signature(spark, sf):
    """Two kinds of documents whose tables have one name: orders, with columns in two orders and letter cases, and suppliers."""
    o, s = spread(table(spark, sf, "orders")), table(spark, sf, "supplier")
    price, status = german(F.col("o_totalprice")), F.concat(F.lit("Status "), F.col("o_orderstatus"))
    odd = F.col("o_custkey") % 2 == 1
    orders = o.select(F.concat(F.lit("o"), F.col("o_custkey")).alias("doc_id"), F.lit("table1").alias("table_name"), F.col("o_orderkey").alias("row_no"),
                      F.when(odd, F.array(price, status)).otherwise(F.array(status, price)).alias("cells"))
    suppliers = s.select(F.concat(F.lit("s"), F.col("s_nationkey")).alias("doc_id"), F.lit("table1").alias("table_name"), F.col("s_suppkey").alias("row_no"),
                         F.array(F.col("s_name"), german(F.col("s_acctbal"))).alias("cells"))
    rows = orders.unionByName(suppliers)
    names = F.when(F.startswith("doc_id", F.lit("s")), F.array(F.lit("Name"), F.lit("Betrag"))).when(
        F.substring("doc_id", 2, 20).cast("int") % 2 == 1, F.array(F.lit("Betrag"), F.lit("Status"))).otherwise(F.array(F.lit("STATUS"), F.lit(" betrag ")))
    headers = rows.select("doc_id", "table_name").distinct().withColumn("header", names)
    typed, decisions = clean.normalize_rows(rows, "digits_only")
    found = _rounded(Q.cross_doc(clean.to_cells(typed), headers, decisions, "Betrag"), "total")
    kind = Q.table_signatures(headers, decisions).groupBy("signature").agg(
        F.when(F.min(F.substring("doc_id", 1, 1)) == "o", F.lit("orders")).otherwise(F.lit("suppliers")).alias("kind"))
    return found.join(kind, "signature").select("kind", "total", "n", "n_docs")


@query("q_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10")
def q_top_k(spark, sf):
    return Q.top(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "p_partkey", 10)


@query("q_join_inner", """SELECT p_brand, sum(l_quantity) AS total, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def q_join_inner(spark, sf):
    items = _cleaned(spark, sf, "l_partkey", "quantity")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return Q.total_by(items.join(parts, F.col("l_partkey") == F.col("p_partkey")), ["p_brand"], "quantity")


def _cleaned_orders(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), german(F.col("o_totalprice")).alias("price"))
    return clean.normalize_table(df, ["price"], "digits_only")


@query("q_join_left", """SELECT c_custkey, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def q_join_left(spark, sf):
    sums = Q.total_by(_cleaned_orders(spark, sf), ["c_custkey"], "price").drop("n")
    joined = table(spark, sf, "customer").select("c_custkey").join(sums, "c_custkey", "left").na.fill(0.0, ["total"])
    return _rounded(joined, "total")


@query("q_join_right", """SELECT p_brand, sum(l_quantity) AS total, count(l_partkey) AS n, count(*) FILTER (l_partkey IS NULL) AS unsold
    FROM (SELECT * FROM lineitem WHERE l_quantity > 48) RIGHT JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def q_join_right(spark, sf):
    items = _cleaned(spark, sf, "l_partkey", "quantity").where("quantity > 48")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "right")
    return joined.groupBy("p_brand").agg(F.sum("quantity").alias("total"), F.count("l_partkey").alias("n"), F.count_if(F.col("l_partkey").isNull()).alias("unsold"))


@query("q_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def q_join_semi(spark, sf):
    big = _cleaned_orders(spark, sf).where("price > 400000")
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("q_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def q_join_anti(spark, sf):
    big = _cleaned_orders(spark, sf).where("price > 400000")
    return table(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_anti")


@query("q_join_full", """SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS n_orders, coalesce(b.n, 0) AS n_items
    FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n FROM lineitem GROUP BY 1) b ON a.day = b.day""")
def q_join_full(spark, sf):
    def days(name, col, out):
        return table(spark, sf, name).groupBy(F.date_format(col, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias(out))

    a, b = days("orders", "o_orderdate", "n_orders"), days("lineitem", "l_shipdate", "n_items")
    return a.join(b, "day", "full").na.fill(0, ["n_orders", "n_items"])


@query("q_join_interval", """SELECT c_custkey, count(*) AS n, min(s_suppkey) AS first FROM customer
    JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 250 GROUP BY 1""")
def q_join_interval(spark, sf):
    points = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    intervals = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 250).alias("high"))
    held = Q.in_interval(points, intervals, "c_acctbal", "low", "high", totals={"n": ("count", "*"), "first": ("min", "s_suppkey")})
    return held.groupBy("c_custkey").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


@query("q_join_interval_mixed", """SELECT c_custkey, count(*) AS n, min(s_suppkey) AS first, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM customer
    JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + power(10, s_suppkey % 7 - 1) GROUP BY 1""")
def q_join_interval_mixed(spark, sf):
    """Intervals whose widths go over six orders of magnitude."""
    points = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    width = F.pow(F.lit(10.0), F.col("s_suppkey") % 7 - 1)
    intervals = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + width).alias("high"))
    totals = {"n": ("count", "*"), "first": ("min", "s_suppkey"), "keys": ("sum", "s_suppkey")}
    held = Q.in_interval(points, intervals, "c_acctbal", "low", "high", totals=totals)
    return held.groupBy("c_custkey").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("keys").alias("keys"))


@query("q_rollup", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, count(*) AS n,
        CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def q_rollup(spark, sf):
    return Q.total_levels(_cleaned(spark, sf, "l_returnflag", "l_linestatus", "quantity"), ["l_returnflag", "l_linestatus"], "quantity")


@query("q_grouping_sets", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, count(*) AS n,
        CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def q_grouping_sets(spark, sf):
    return Q.total_sets(_cleaned(spark, sf, "l_returnflag", "l_linestatus", "quantity"), [["l_returnflag"], ["l_linestatus"], []], "quantity")


@query("q_cube", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, count(*) AS n,
        CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_cube(spark, sf):
    return Q.total_cube(_cleaned(spark, sf, "l_returnflag", "l_linestatus", "quantity"), ["l_returnflag", "l_linestatus"], "quantity")


@query("q_running_total", """SELECT l_returnflag, strftime(l_shipdate, '%Y-%m-%d') AS day, sum(l_quantity) AS total,
        sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate) AS running_total
    FROM lineitem GROUP BY l_returnflag, l_shipdate""")
def q_running_total(spark, sf):
    df = _cleaned(spark, sf, "l_returnflag", "l_shipdate", "quantity")
    out = Q.running_total(df, ["l_returnflag"], "l_shipdate", "quantity")
    return out.select("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "total", "running_total")


@query("q_running_by_name", """SELECT l_returnflag, name, sum(l_quantity) AS total,
        sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag ORDER BY name NULLS FIRST) AS running_total
    FROM (SELECT *, CASE WHEN p_size < 46 THEN p_name END AS name FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_returnflag, name""")
def q_running_by_name(spark, sf):
    """Running total in the order of part names, some of which are unknown, over many ranges of names."""
    items = _cleaned(spark, sf, "l_returnflag", "l_partkey", "quantity")
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") < 46, F.col("p_name")).alias("name"))
    return Q.running_total(items.join(names, "l_partkey"), ["l_returnflag"], "name", "quantity", rows_per_range=20)


@query("q_rank", """SELECT l_returnflag, l_suppkey, sum(l_quantity) AS total,
        rank() OVER (PARTITION BY l_returnflag ORDER BY sum(l_quantity) DESC) AS rank FROM lineitem GROUP BY 1, 2""")
def q_rank(spark, sf):
    return Q.rank_by_total(_cleaned(spark, sf, "l_returnflag", "l_suppkey", "quantity"), ["l_returnflag"], "l_suppkey", "quantity")


@query("q_union", """SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier""")
def q_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s)


@query("q_intersect", "SELECT l_partkey AS part FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def q_intersect(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), "l_returnflag")
    return li.where("l_returnflag = 'A'").select("part").intersect(li.where("l_returnflag = 'R'").select("part"))


@query("q_except", "SELECT l_suppkey AS supp, l_partkey AS part FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A'")
def q_except(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"), "l_returnflag")
    return li.where("l_returnflag = 'A'").drop("l_returnflag").subtract(li.where("l_returnflag <> 'A'").drop("l_returnflag"))


@query("q_distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def q_distinct_rows(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("text_search", """SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') AND contains(lower(text), 'the')""")
def text_search(spark, sf):
    return Q.text_search(table(spark, sf, "documents"), ["Tion", "THE"], "text").select("doc_id")


@query("text_search_patterns", """SELECT doc_id, text LIKE '%the %' AS likes, text ILIKE 'a%' AS starts, regexp_matches(text, '[0-9]{3}') AS digits,
        CAST(instr(text, 'on') AS INTEGER) AS place FROM documents""")
def text_search_patterns(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", t.like("%the %").alias("likes"), t.ilike("a%").alias("starts"), t.rlike("[0-9]{3}").alias("digits"),
        F.instr(t, "on").alias("place"))


@query("capped_result", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total_rows,
        'only the first 200 of ' || (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') || ' rows are shown' AS note
    FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200""")
def capped_result(spark, sf):
    df = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return results.capped(df, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()])


@query("capped_now", """SELECT l_suppkey, total, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS total_rows,
        'only the first 50 of ' || (SELECT count(DISTINCT l_suppkey) FROM lineitem) || ' rows are shown' AS note
    FROM (SELECT l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1) ORDER BY total DESC, l_suppkey LIMIT 50""")
def capped_now(spark, sf):
    """The suppliers with most items, and how many suppliers there are, from one run of the question."""
    df = Q.total_by(_cleaned(spark, sf, "l_suppkey", "quantity"), ["l_suppkey"], "quantity").select("l_suppkey", "total")
    return results.capped_now(df, [F.col("total").desc(), F.col("l_suppkey").asc()], 50)


@query("capped_list", """SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS total_items, md5(array_to_string(string_split(text, ' ')[1:200], '|')) AS first_items FROM documents""")
def capped_list(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return results.capped_list(words, "words").select("doc_id", "total_items", F.md5(F.array_join("first_items", "|")).alias("first_items"))


@query("to_records", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","region":null,"day":"2026-01-05T00:00:00.000"}' AS record FROM nation""")
def to_records(spark, sf):
    df = table(spark, sf, "nation").select(
        "n_nationkey", "n_name", F.lit(None).cast("string").alias("region"), F.lit("2026-01-05").cast("timestamp_ntz").alias("day"))
    return results.to_records(df)
