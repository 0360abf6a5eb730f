"""Workbook cells to tables; facts of files of all kinds."""

from datetime import datetime

from pyspark.sql import functions as F

from sheetwright.operators.registry import last_inline_images
from sheetwright.plans.ingest import ingest_sheets
from sheetwright.sources.pages import document_facts

SHEETS = "doc_id string, sheet_no int, sheet string, row_no bigint, cells array<struct<text:string,num:double,ts:timestamp,flag:boolean>>"


def cell(v):
    return {str: (v, None, None, None), float: (None, v, None, None), datetime: (None, None, v, None), bool: (None, None, None, v)}.get(type(v), (None,) * 4)


def sheet(doc, no, name, *rows):
    return [(doc, no, name, i, [cell(v) for v in r]) for i, r in enumerate(rows)]


def test_sheets_become_typed_tables_with_names_of_their_own(spark):
    day = datetime(2024, 5, 1)
    rows = [
        *sheet("a", 0, "Lager Süd", ["", None], ["Teil", "Menge", "am", 7.0], ["x", "1.234,5", day, None], ["  ", None, None, None], ["y", "2", day, None]),
        *sheet("a", 1, "Lager-Süd", ["Teil"], ["z"]),
        *sheet("a", 2, "document_text", ["n"], [3.0], [4.5]),
        *sheet("a", 3, "only a header", ["Teil", "Menge"]),
        *sheet("a", 4, "empty", [None], [""]),
        *sheet("b", 0, "Lager Süd", ["Teil"], ["q"]),
        *sheet("c", 0, "nothing", [None])]
    typed, headers, decisions, meta = ingest_sheets(spark.createDataFrame(rows, SHEETS), "digits_only")
    got = {}
    for r in typed.orderBy("row_no").collect():
        got.setdefault((r.doc_id, r.table_name), []).append([next((v for v in (c.text, c.num, c.ts, c.flag) if v is not None), None) for c in r.cells])
    assert got == {
        ("a", "Lager_Süd"): [["x", 1234.5, day, None], ["y", 2.0, day, None]], ("a", "Lager_Süd_2"): [["z"]], ("a", "document_text_2"): [[3.0], [4.5]],
        ("b", "Lager_Süd"): [["q"]]}
    assert {(r.doc_id, r.table_name): list(r.header) for r in headers.collect()} == {
        ("a", "Lager_Süd"): ["Teil", "Menge", "am", "7"], ("a", "Lager_Süd_2"): ["Teil"], ("a", "document_text_2"): ["n"], ("b", "Lager_Süd"): ["Teil"]}
    assert {r.doc_id: r.sheet_count for r in meta.collect()} == {"a": 3, "b": 1, "c": 0}
    assert ingest_sheets(spark.createDataFrame([], SHEETS))[0].isEmpty()


def test_facts_of_files_of_all_kinds(spark):
    files = spark.createDataFrame([("1", "/in/a b.PDF"), ("2", "/in/x/s.xlsx"), ("3", "p.jpeg"), ("4", "t.csv"), ("5", "/in/odd"), ("6", "none.pdf"), ("7", "none.xls")], "doc_id string, path string")
    paged = spark.createDataFrame([("1", 4, 1, "pdf_scanned")], "doc_id string, page_count bigint, vision_pages bigint, source_type string")
    sheets = spark.createDataFrame([("2", 3)], "doc_id string, sheet_count bigint")
    got = {r.doc_id: tuple(r)[1:] for r in document_facts(files, paged, sheets).collect()}
    assert got == {"1": ("a b.PDF", "pdf_scanned", 4, 1, None), "2": ("s.xlsx", "spreadsheet", None, 0, 3), "3": ("p.jpeg", "image", None, 1, None),
                   "4": ("t.csv", "csv", None, 0, 1), "5": ("odd", "quarantine", None, 0, None), "6": ("none.pdf", "pdf_text", 0, 0, None), "7": ("none.xls", "spreadsheet", None, 0, 0)}


def test_pictures_of_the_last_user_message_only(spark):
    kind = "chat_id string, ts int, role string, parts array<struct<type:string,text:string,image_url:string>>, files array<struct<type:string,id:string,name:string,path:string,url:string,file:struct<id:string,filename:string,path:string,meta:struct<name:string>>>>"
    picture = lambda data: [("image_url", None, f"data:image/png;base64,{data}")]
    rows = [("a", 1, "user", picture("b2xk"), None), ("a", 3, "user", picture("bmV3"), None), ("a", 4, "assistant", picture("Ym90"), None),
            ("b", 1, "user", picture("b2xk"), None), ("b", 2, "user", [("text", "no picture", None)], None), ("c", 1, "assistant", picture("Ym90"), None)]
    found = last_inline_images(spark.createDataFrame(rows, kind)).select("chat_id", "ts", F.decode("content", "UTF-8").alias("x")).collect()
    assert [tuple(r) for r in found] == [("a", 3, "new")]
