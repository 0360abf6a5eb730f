"""Questions in their wrappers, pictures, attachments, results, streams."""

import base64
import hashlib
import random

from pyspark.sql import functions as F

from sheetwright.functions import messages as M
from sheetwright.functions import text as X
from sheetwright.operators import registry as R, results
from sheetwright.streaming.chats import stream_current_doc, stream_open_chats


def test_question_is_found_in_every_wrapping(spark):
    q = "Wie hoch ist der Bestand in Bremen?"
    wrapped = [
        q,
        f"<attached_files>\nstock.csv\nmore\n</attached_files>  \n{q}",
        f"Answer from the excerpt. <user_query>\n {q} </user_query> Be brief.",
        f"Use this:\n<context>a;b</context> and <context>\nc;d\n</context>\n{q}",
        '[{"type": "text", "text": "Wie hoch ist der Bestand"}, {"type": "image_url", "image_url": {"url": "x"}}, {"type": "text", "text": "in Bremen?"}]',
        f"  {q}\n",
    ]
    df = spark.createDataFrame([(w,) for w in wrapped], "c string")
    got = [r.q for r in df.select(M.bare_question(M.message_text(F.col("c"))).alias("q")).collect()]
    assert got == [q] * len(wrapped)


def test_code_block(spark):
    cases = [("```python\nresult = 1\n```", "result = 1"), ("no code", None), ("a ```x``` ```y```", "x"), ("``````", ""), ("```python", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "c string")
    assert [r.x for r in df.select(M.code_block(F.col("c")).alias("x")).collect()] == [w for _, w in cases]


def test_task_replies(spark):
    df = spark.createDataFrame([("query_generation",), ("title_generation",), ("emoji_generation",)], "t string")
    assert [r.x for r in df.select(M.task_reply(F.col("t"), "en").alias("x")).collect()] == [
        '{"queries": []}', '{"title": "Working with a table"}', ""]


def lenient_base64(text):
    """Python's own decoder, None where it refuses."""
    try:
        return base64.b64decode(text)
    except ValueError:
        return None


def test_base64_like_python(spark):
    rnd = random.Random(6)
    texts = ["", "aGVsbG8=", "aGVsbG8", "aGVs\nbG8=", "aGVsbG8=xyz", "a*b", "====", "QQ==", "Q", "QUI="]
    texts += [base64.b64encode(bytes(rnd.choice(range(256)) for _ in range(rnd.randint(1, 9)))).decode() for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", M.decode_base64(F.col("t")).alias("b")).collect():
        if r.t == "====":
            continue
        assert (None if r.b is None else bytes(r.b)) == lenient_base64(r.t), r.t


def test_pictures_are_attached_once(spark):
    png = bytes([137, 80, 78, 71]) + b"data"
    url = "data:image/png;base64," + base64.b64encode(png).decode()
    raw = spark.createDataFrame([("c1", 1, f'[{{"type":"text","text":"Was?"}},{{"type":"image_url","image_url":{{"url":"{url}"}}}}]',
                                  f'[{{"type":"image","url":"{url}"}},{{"type":"file","id":"f1","name":"a.csv"}},{{"type":"image","url":"data:image/SVG+XML;base64,PHN2Zz4="}}]')],
                                "chat_id string, ts int, parts string, files string")
    messages = raw.select("chat_id", "ts", F.from_json("parts", M.PARTS_SCHEMA).alias("parts"), F.from_json("files", M.FILES_SCHEMA).alias("files"))
    pictures = R.inline_images(messages)
    assert [(r.name, bytes(r.content)) for r in pictures.collect()] == [("bild_1.png", png), ("bild_2.png", png), ("bild_3.svg", b"<svg>")]
    none = messages.select("chat_id", "ts", F.lit("x").alias("name"), F.lit(b"").alias("content")).where("false")
    got = sorted((r.name, r.source_id) for r in R.attachments(none, pictures).collect())
    assert got == [("bild_1.png", hashlib.sha256(png).hexdigest()), ("bild_3.svg", hashlib.sha256(b"<svg>").hexdigest())]


def test_file_refs(spark):
    entries = [
        '{"type":"file","file":{"id":"abc","filename":"bestand.csv","path":"/p"}}', '{"id":"x","name":"n"}',
        '{"type":"image","id":"x","name":"n"}', '{"type":"collection","id":"x","name":"n"}', '{"type":"file","id":"x"}',
        '{"type":"image","file":{"id":"i","meta":{"name":"m.png"}}}',
        '{"type":"file","id":"outer","name":"outer","path":"/o","file":{"id":"","filename":""}}',
    ]
    df = spark.createDataFrame(list(enumerate(entries)), "i int, e string").select("i", F.from_json("e", M.FILE_SCHEMA).alias("entry"))
    got = {r.i: (r.id, r.name, r.path) for r in R.file_refs(df).collect()}
    assert got == {0: ("abc", "bestand.csv", "/p"), 1: ("x", "n", None), 5: ("i", "m.png", None), 6: ("outer", "outer", "/o")}


def test_names_and_cuts(spark):
    df = spark.createDataFrame([("Größe (kg).x", "abcdef"), ("", "abc"), (None, None)], "n string, t string")
    got = df.select(X.safe_table_name(F.col("n")).alias("t"), X.safe_file_name(F.col("n")).alias("f"),
                    X.cut_text(F.col("t"), 4, "+").alias("c"), X.error_tail(F.col("t"), 4).alias("e")).collect()
    assert [tuple(r) for r in got] == [("Größe__kg__x", "Größe__kg_.x", "abcd+", "cdef"), ("data", "upload", "abc", "abc"), ("data", "upload", None, None)]


def test_capped_results(spark):
    df = spark.createDataFrame([(f"P{i}", i) for i in range(50)], "part string, qty int")
    got = results.capped(df, ["qty"], 10).collect()
    assert [r.qty for r in got] == list(range(10)) and got[0].total_rows == 50
    assert got[0].note == "only the first 10 of 50 rows are shown"
    assert results.capped(df, ["qty"], 50).first()["note"] is None
    lists = spark.createDataFrame([([1, 2, 3],)], "l array<int>")
    r = results.capped_list(lists, "l", 2).first()
    assert (r.first_items, r.total_items) == ([1, 2], 3)


def test_streamed_current_document(spark, tmp_path):
    rnd = random.Random(9)
    events = [(rnd.choice("abc"), f"2024-01-{rnd.randint(1, 28):02d} 10:00:00", s, f"d{s}") for s in range(60)]
    schema = "chat_id string, ts timestamp, seq bigint, doc_id string"
    for part in range(3):
        chunk = spark.createDataFrame(events[part::3], "chat_id string, t string, seq bigint, doc_id string")
        chunk.select("chat_id", F.to_timestamp("t").alias("ts"), "seq", "doc_id").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = stream_current_doc(stream).writeStream.outputMode("complete").format("memory").queryName("current_docs").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.chat_id: r.doc_id for r in spark.table("current_docs").collect()}
    assert got == {c: max((t, s, d) for c2, t, s, d in events if c2 == c)[2] for c in "abc"}
    q = stream_open_chats(stream, "7 days").writeStream.outputMode("append").format("memory").queryName("open_chats").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.table("open_chats")
    assert closed.count() > 0 and closed.groupBy("chat_id", "period_start").count().where("count > 1").count() == 0


def test_last_message_and_its_pictures(spark):
    rows = [("c", 1, "user", "first"), ("c", 2, "user", "second"), ("c", 3, "assistant", "reply"), ("d", 1, "assistant", "x")]
    messages = spark.createDataFrame(rows, "conv_id string, turn int, role string, content string")
    assert [tuple(r) for r in R.last_messages(messages, "conv_id", "turn").collect()] == [("c", 2, "user", "second")]
    assert [tuple(r) for r in R.last_questions(messages).collect()] == [("c", "second")]


def test_removed_documents_are_not_answered_from(spark):
    questions = spark.createDataFrame([("c", 5, "q1"), ("c", 2, "q2"), ("d", 5, "q3")], "chat_id string, ts int, q string")
    attached = spark.createDataFrame([("c", 1, 1, "old"), ("c", 3, 2, "new")], "chat_id string, ts int, seq int, doc_id string")
    docs = spark.createDataFrame([("old",)], "doc_id string")
    got = {r.q: (r.doc_id, r.found, r.reason) for r in R.resolve_chat_doc(questions, attached, docs=docs).collect()}
    assert got == {"q1": (None, False, "removed"), "q2": ("old", True, None), "q3": (None, False, "none")}
