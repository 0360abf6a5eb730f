"""Bytes, separators, delimited files, stored tables, streaming ingest."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from sheetwright.functions.encoding import decode_bytes
from sheetwright.operators.clean import normalize_rows
from sheetwright.operators.profile import column_names
from sheetwright.plans.ingest import ingest_csv
from sheetwright.sources.csvtables import _options, first_filled_line, guess_separator, read_csv_rows, read_csv_table
from sheetwright.sources.quoted import quoted_records
from sheetwright.sources.store import read_document, read_table, retire, write_batch
from sheetwright.streaming.faults import failing
from sheetwright.streaming.files import ingest_batch, stream_ingest, with_file_path


def is_utf8(raw):
    try:
        return raw.decode("utf-8") is not None
    except UnicodeDecodeError:
        return False


def expected_text(raw):
    if is_utf8(raw):
        return raw.decode("utf-8").removeprefix("\ufeff")
    return raw.decode("latin-1" if set(raw) & {0x81, 0x8D, 0x8F, 0x90, 0x9D} else "cp1252")


def test_decode_bytes(spark):
    rnd = random.Random(1)
    raws = [b"", "Türklinke".encode("cp1252"), "﻿Tür €".encode(), b"\x80\x9f\x93", b"\x80\x81", b"\xff\xfe\x41"]
    raws += [bytes(rnd.choice(range(1, 256)) for _ in range(rnd.randint(1, 6))) for _ in range(500)]
    df = spark.createDataFrame([(bytearray(r),) for r in raws], "raw binary")
    for r in df.select("raw", decode_bytes(F.col("raw")).alias("t")).collect():
        assert r.t == expected_text(bytes(r.raw)), r.raw


def test_guess_separator(spark):
    cases = [("a;b;c", ";"), ("\n \na\tb", "\t"), ("a,b;c", ";"), ("a,b,c;d", ","), ("abc", ","), ("a|b", "|"), ("", ","), ("a\tb,c", "\t")]
    df = spark.createDataFrame(cases, "t string, s string")
    for r in df.select("t", "s", guess_separator(first_filled_line(F.col("t"))).alias("g")).collect():
        assert r.g == r.s, r.t


def tables(rows, headers):
    names = {}
    for r in column_names(headers).orderBy("col_no").collect():
        names.setdefault(r.doc_id.rsplit("/", 1)[1], []).append(r.name)
    out = {k: [] for k in names}
    for r in rows.orderBy("row_no").collect():
        out[r.doc_id.rsplit("/", 1)[1]].append([c for c in r.cells])
    return names, out


def trimmed(rows):
    cut = [list(r) for r in rows]
    for r in cut:
        while r and r[-1] is None:
            r.pop()
    return cut


def test_csv_corpus(spark, tmp_path):
    files = {
        "german.csv": "Ware;Stück\nTürklinke;1.234\nStößel;2.500\n".encode("cp1252"),
        "bom.csv": "﻿part,qty\nA,10\nB,20\n".encode(),
        "quotes.csv": 'a,b\n"x, y","he said ""no"""\n"two\nlines",3\n5" pipe,4\n'.encode(),
        "ragged.csv": b"a|b\n1|2|3\n4\n5|NA\n",
        "crlf.csv": b"\r\n \r\na\tb\r\n1\t2\r\n\r\n",
        "odd.csv": b"n;w\n1;\x81\x80\n",
        "euro.csv": "n;w\n1;5 €\n".encode("cp1252"),
        "wide.csv": b'a,"b\nc",d,e,f\n1,"2\n2",3,"4\n4",5\n',
        "same.csv": b"a,b\na,b\na,b\n",
        "head.csv": b"a,b\n",
    }
    (tmp_path / "in put").mkdir()
    for name, content in files.items():
        (tmp_path / "in put" / name).write_bytes(content)
    rows, headers = read_csv_rows(spark, [str(tmp_path / "in put")])
    names, got = tables(rows, headers)
    got = {k: trimmed(v) for k, v in got.items()}
    assert names["german.csv"] == ["Ware", "Stück"]
    assert got["german.csv"] == [["Türklinke", "1.234"], ["Stößel", "2.500"]]
    assert names["bom.csv"] == ["part", "qty"] and got["bom.csv"] == [["A", "10"], ["B", "20"]]
    assert got["quotes.csv"] == [["x, y", 'he said "no"'], ["two\nlines", "3"], ['5" pipe', "4"]]
    assert names["wide.csv"] == ["a", "b c", "d", "e", "f"] and got["wide.csv"] == [["1", "2\n2", "3", "4\n4", "5"]]
    assert names["ragged.csv"] == ["a", "b", "column_3"]
    assert got["ragged.csv"] == [["1", "2", "3"], ["4"], ["5"]]
    assert names["crlf.csv"] == ["a", "b"] and [r for r in got["crlf.csv"] if r] == [["1", "2"]]
    assert got["odd.csv"] == [["1", "\x81\x80"]] and got["euro.csv"] == [["1", "5 €"]]
    assert got["same.csv"] == [["a", "b"], ["a", "b"]] and got["head.csv"] == []


def test_file_is_split_and_keeps_its_order(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id;n\n" + "".join(f"{i};{i * 7}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, _ = read_csv_rows(spark, [str(tmp_path / "big.csv")])
        assert rows.rdd.getNumPartitions() > 4
        got = [r.cells[0] for r in rows.orderBy("row_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [str(i) for i in range(20_000)]


def test_ingest_csv(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("code,amount\n0099001,3.210\n0099002,1.500\n")
    typed, headers, decisions = ingest_csv(spark, [str(tmp_path / "codes.csv")])
    got = sorted((r.cells[0].text, r.cells[1].num) for r in typed.collect())
    assert got == [("0099001", 3210.0), ("0099002", 1500.0)]


def test_one_table_with_columns(spark, tmp_path):
    (tmp_path / "lager.csv").write_bytes("Artikel;Größe\nTür;5 €\n".encode("cp1252"))
    df = read_csv_table(spark, [str(tmp_path / "lager.csv")], ";", "cp1252")
    assert df.columns == ["Artikel", "Größe"] and tuple(df.first()) == ("Tür", "5 €")


def test_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, n int")
    for _ in range(2):
        write_batch(one, path, 0, ["doc_id"])
    write_batch(one.withColumn("doc_id", F.lit("c")), path, 1)
    assert read_table(spark, path).count() == 4
    kept = read_document(spark, path, "a")
    assert kept.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,a)]" in kept._jdf.queryExecution().toString()


def test_stream_takes_each_content_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    src.mkdir()

    def run():
        q = stream_ingest(spark, str(src), str(out), str(mark), max_files=2)
        q.awaitTermination()

    (src / "a.csv").write_text("part,qty\nA,1.500\nB,2.500\n")
    (src / "copy.csv").write_text("part,qty\nA,1.500\nB,2.500\n")
    (src / "broken.xyz").write_bytes(b"???")
    run()
    (src / "again.csv").write_text("part,qty\nA,1.500\nB,2.500\n")
    (src / "new.csv").write_text("part,qty\nC,7\n")
    run()
    registry = read_table(spark, str(out / "registry"))
    assert registry.count() == 2 and registry.select("source_id").distinct().count() == 2
    rows = read_table(spark, str(out / "rows"))
    assert rows.select(F.sum(F.col("cells")[1]["num"])).first()[0] == 4007.0
    bad = read_table(spark, str(out / "quarantine")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["broken.xyz"]


def test_repeated_batch_leaves_the_same_state(spark, tmp_path):
    (tmp_path / "a.csv").write_text("part,qty\nA,1\n")
    files = with_file_path(spark.read.format("binaryFile").load(str(tmp_path / "a.csv")))
    for _ in range(2):
        ingest_batch(files, 5, str(tmp_path / "out"))
    assert read_table(spark, str(tmp_path / "out/rows")).count() == 1
    assert read_table(spark, str(tmp_path / "out/registry")).count() == 1


def test_names_with_pattern_characters_and_widths(spark, tmp_path):
    (tmp_path / "a[1].csv").write_text("k;v\nx;1\n")
    (tmp_path / "b{2}.csv").write_text("k;v\ny;2\n")
    (tmp_path / "quoted.csv").write_text('k;v\nz;"' + ";" * 400 + '"\n')
    (tmp_path / "wide.csv").write_text(";".join(f"h{i}" for i in range(400)) + "\n" + ";".join(map(str, range(400))) + "\n")
    rows, headers = read_csv_rows(spark, [str(tmp_path)])
    got = {r.doc_id.rsplit("/", 1)[1]: r.cells for r in rows.collect()}
    assert got["a%5B1%5D.csv"] == ["x", "1"] and got["b%7B2%7D.csv"] == ["y", "2"]
    assert got["quoted.csv"] == ["z", ";" * 400]
    assert len(got["wide.csv"]) >= 400 and got["wide.csv"][399] == "399"
    assert sorted(len(r.header) for r in headers.collect()) == [2, 2, 2, 400]


def test_blank_lines_before_a_header_over_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('   \nname;v\n"A\nB";1\nC;2\n')
    rows, headers = read_csv_rows(spark, [str(tmp_path / "a.csv")])
    assert sorted(tuple(r.cells) for r in rows.collect()) == [("A\nB", "1"), ("C", "2")]
    assert headers.first().header == ["name", "v"]


def test_wide_names_are_made_distinct(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Menge;;Menge; Preis  x;a`b.c\n1;2;3;4;5\n")
    df = read_csv_table(spark, [str(tmp_path / "a.csv")], ";")
    assert df.columns == ["Menge", "column_2", "Menge_2", "Preis x", "a`b.c"] and tuple(df.first()) == tuple("12345")


def test_every_streamed_file_is_accounted_for(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for name in ("b.pdf", "c.xlsx", "d.png", "e.xyz"):
        (src / name).write_bytes(name.encode())
    for name in ("a[1].csv", "copy.csv"):
        (src / name).write_text("k,v\nA,1\n")
    stream_ingest(spark, str(src), str(out), str(tmp_path / "mark")).awaitTermination()
    bad = {r.path.rsplit("/", 1)[1]: r.reason for r in read_table(spark, str(out / "quarantine")).collect()}
    assert sorted(bad) == ["b.pdf", "c.xlsx", "d.png", "e.xyz"] and all(bad.values())
    assert read_table(spark, str(out / "registry")).count() == 1


def test_retired_batches(spark, tmp_path):
    out = str(tmp_path / "store")
    docs = spark.createDataFrame([("a", 1), ("b", 9), ("c", 1), ("d", 9)], "doc_id string, ingested_at int")
    for batch, names in (("007", ["a", "b"]), ("8", ["c"]), ("9", ["d"])):
        some = docs.where(F.col("doc_id").isin(names))
        write_batch(some, f"{out}/rows", batch)
        write_batch(some, f"{out}/registry", batch)
    write_batch(docs.where("doc_id = 'a'"), f"{out}/text_blocks", "007")  # the other batches have none
    # A run cut short between taking batch 9 away and putting its successor in place.
    (tmp_path / "store/rows/batch=9").rename(tmp_path / "store/rows/_next-9")
    for expected in (["a", "c"], []):
        gone = retire(spark, out, F.lit(5), ("rows", "text_blocks"))
        assert sorted(r.doc_id for r in gone.collect()) == expected
        assert sorted(r.doc_id for r in read_table(spark, f"{out}/rows").collect()) == ["b", "d"]
        assert sorted(r.doc_id for r in read_table(spark, f"{out}/registry").collect()) == ["b", "d"]
    assert not (tmp_path / "store/rows/batch=8").exists()
    assert retire(spark, out, F.lit(99), ("rows", "text_blocks")).count() == 2
    assert retire(spark, out, F.lit(99), ("rows", "text_blocks")).count() == 0


def _csv_text(rnd, n, end):
    def field():
        kind = rnd.random()
        if kind < 0.5:
            return rnd.choice(["", "a", "12", "x y", "long " * 5])
        inner = "".join(rnd.choice(["a", ";", '""', "\n", "\r\n", " ", "b;"]) for _ in range(rnd.randint(0, 12)))
        return f'"k{inner}"'
    return "h0;h1;h2" + end + "".join(";".join([f"r{i}", field(), field()]) + end for i in range(n))


@pytest.mark.parametrize("seed,split,end", [(1, 7, "\n"), (2, 20, "\n"), (3, 64, "\r\n"), (4, 1000, "\n"), (5, 33, "\r\n")])
def test_quoted_line_ends_over_many_splits(spark, tmp_path, seed, split, end):
    """Records are the same whatever the splits; python's csv reader tells them."""
    text = _csv_text(random.Random(seed), 40, end)
    (tmp_path / "a.csv").write_text(text, newline="")
    want = {tuple(r) for r in list(csv.reader(io.StringIO(text, newline=""), delimiter=";"))[1:]}
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        records = quoted_records(spark, [str(tmp_path / "a.csv")], "utf-8", ";", rows_per_range=5)
        cells = records.select(F.from_csv("text", F.lit("a string, b string, c string"), _options(";")).alias("r"), "text").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {tuple(x or "" for x in r.r) for r in cells if r.text != "h0;h1;h2"}
    assert got == want and len(cells) == 41


def test_a_quote_open_across_three_splits(spark, tmp_path):
    inside = "line of a long note\n" * 60
    text = f'k;v\na;1\nb;"{inside}""end"\nc;3\n'
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "never.csv").write_text('k;v\na;1\nb;"open\nand on\n' + "x;y\n" * 50)
    conf = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() >= 4
        rows, headers = read_csv_rows(spark, [str(tmp_path / "a.csv"), str(tmp_path / "never.csv")])
        got = sorted((r.doc_id.rsplit("/", 1)[1], *r.cells) for r in rows.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[:3] == [("a.csv", "a", "1"), ("a.csv", "b", f'{inside}"end'), ("a.csv", "c", "3")]
    assert got[3] == ("never.csv", "a", "1") and got[4][:2] == ("never.csv", "b") and got[4][2].startswith("open\nand on\nx;y") and len(got) == 5
    assert [r.header for r in headers.collect()] == [["k", "v"], ["k", "v"]]


def test_quoted_line_ends_of_one_carriage_return(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k;v\ra;"1\r2"\rb;3\r', newline="")
    rows, _ = read_csv_rows(spark, [str(tmp_path / "a.csv")])
    assert sorted(tuple(r.cells) for r in rows.collect()) == [("a", "1\r2"), ("b", "3")]


def test_one_bad_file_does_not_stop_the_others(spark, tmp_path):
    """Every file of a batch is stored, a duplicate, or in quarantine with a reason."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for i in range(7):
        (src / f"f{i}.csv").write_text(f"k,v\nA{i},{i}\n")
    (src / "copy.csv").write_text("k,v\nA3,3\n")
    (src / "notes.txt").write_text("no table")
    (src / "huge.csv").write_text("k,v\n" + "B,1\n" * 1000)
    (src / "torn.csv").write_text("k,v\nC,9\n")
    listed = with_file_path(spark.read.format("binaryFile").load(str(src))).select("path", "modificationTime").collect()
    (src / "f5.csv").unlink()  # gone between listing and reading
    (src / ".torn.csv.crc").write_bytes(b"crc\0\0\0\2\0\0\0\0\0")  # does not match the content
    files = spark.createDataFrame(listed, "path string, modificationTime timestamp")
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        for _ in range(2):
            ingest_batch(files, 3, str(out))
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)
    name = lambda r: r.path.rsplit("/", 1)[1]
    outcome = {name(r): r.outcome for r in read_table(spark, str(out / "files")).collect()}
    assert len(outcome) == 11 and [n for n, o in outcome.items() if o == "duplicate"] in (["copy.csv"], ["f3.csv"])
    reasons = {name(r): r.reason for r in read_table(spark, str(out / "quarantine")).collect()}
    assert sorted(reasons) == ["f5.csv", "huge.csv", "notes.txt", "torn.csv"] == sorted(n for n, o in outcome.items() if o == "quarantine")
    assert "exceeds" in reasons["huge.csv"] and "hecksum" in reasons["torn.csv"] and all(reasons.values())
    assert read_table(spark, str(out / "registry")).count() == 6
    assert sorted(r.v for r in read_table(spark, str(out / "rows")).select(F.col("cells")[1]["num"].alias("v")).collect()) == [0, 1, 2, 3, 4, 6]


def test_a_fault_of_no_file_is_raised(spark):
    def full(paths):
        spark.range(1).select(F.raise_error(F.lit("disk full"))).collect()

    with pytest.raises(Exception, match="disk full"):
        failing(["a", "b"], full)


def test_quoted_line_items_are_written_by_all_tasks(spark, tmp_path):
    """Each split of the table becomes a file; the settings for small splits are undone."""
    from pathlib import Path

    from sheetwright.plans.session import written_paths
    from workload import QUERIES

    items = spark.range(400).selectExpr("id AS l_orderkey", "cast(id % 4 AS int) AS l_linenumber", "if(id % 3 = 0, 'A', 'N') AS l_returnflag", "id + 0.25D AS l_extendedprice")
    items.repartition(4).write.parquet(f"{tmp_path}/lineitem.parquet")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum")
    usual = {**{n: spark.conf.get(n, None) for n in names}, "spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "4096"}
    before = {n: spark.conf.get(n, None) for n in names}
    known = set(written_paths())
    try:
        for n in names[:2]:
            spark.conf.set(n, usual[n])
        got = {r.flag: (r.n, r["keys"], r.note_chars) for r in QUERIES["csv_split_quoted"](spark, str(tmp_path)).collect()}
        assert {n: spark.conf.get(n, None) for n in names} == usual
    finally:
        for n in names[:2]:
            spark.conf.unset(n) if before[n] is None else spark.conf.set(n, before[n])
    want = {f: [i for i in range(400) if (i % 3 == 0) == (f == "A")] for f in "AN"}
    assert got == {f: (len(x), sum(x), 18 * sum(i % 2 == 0 for i in map(lambda i: i % 4, x))) for f, x in want.items()}
    (folder,) = [p for p in written_paths() if p not in known and "/quoted-csv-" in p]
    assert len(list(Path(folder).glob("*.csv"))) > 1


@pytest.mark.parametrize("seed,split,lines,end", [(11, 600, 1, "\n"), (12, 300, 2, "\r\n"), (13, 100_000, 3, "\n"), (14, 100_000, 7, "\r"), (15, 200, 1000, "\r\n")])
def test_records_are_the_same_whatever_the_pieces(spark, tmp_path, seed, split, lines, end):
    """Pieces of any number of lines give Python's records, in their order, also with quotes inside fields without."""
    rnd = random.Random(seed)
    text = _csv_text(rnd, 40, end) + f'a;5" disc;"b"{end}"c";"";d"{end}'
    (tmp_path / "a.csv").write_text(text, newline="")
    want = [tuple(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=";")]
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        records = quoted_records(spark, [str(tmp_path / "a.csv")], "utf-8", ";", rows_per_range=5, lines_per_piece=lines)
        got = records.orderBy("row_no").select(F.from_csv("text", F.lit("a string, b string, c string"), _options(";")).alias("r")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(x or "" for x in r.r) for r in got] == want


def test_only_records_over_the_end_of_a_piece_are_gathered(spark, tmp_path):
    """A file of records over two lines each: parts are two for each end of a piece, not one for each line."""
    from sheetwright.plans.session import written_paths

    (tmp_path / "a.csv").write_text("k;v\n" + "".join(f'{i};"x\ny"\n' for i in range(400)))
    known = set(written_paths())
    rows, _ = read_csv_rows(spark, [str(tmp_path / "a.csv")])
    assert sorted(int(r.cells[0]) for r in rows.collect()) == list(range(400)) and rows.where("cells[1] = 'x\ny'").count() == 400
    (parts,) = [p for p in written_paths() if p not in known and "/quoted-parts-" in p]
    assert spark.read.parquet(parts).count() <= 2


def test_sniffing_matches_quotes_for_the_separator_of_a_file_only(spark, tmp_path):
    from sheetwright.sources.csvtables import read_lines, sniff, with_quoted_lines

    (tmp_path / "a.csv").write_text('k;v\n"a;b";"1,2,3"\n')
    (tmp_path / "b.csv").write_text('k\tv\tw\n"x;y"\t1\t"open;\nend"\n')
    (tmp_path / "c.csv").write_text("k|v\n1|2|3\n")
    lines = read_lines(spark, [str(tmp_path)])
    sniffed = sniff(lines)
    got = {r.path.rsplit("/", 1)[1]: (r.separator, r.width, r.multi_line) for r in with_quoted_lines(sniffed, lines).collect()}
    assert got == {"a.csv": (";", 2, False), "b.csv": ("\t", 3, True), "c.csv": ("|", 3, False)}
    plan = sniffed._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE(value" not in plan and "regexp_replace" not in plan


def test_a_header_below_a_split_without_a_filled_record(spark, tmp_path):
    (tmp_path / "a.csv").write_text(";;\n" * 100 + 'name;v\n"A\nB";1\n')
    conf = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows, headers = read_csv_rows(spark, [str(tmp_path / "a.csv")])
        assert [tuple(r.cells[:2]) for r in rows.collect()] == [("A\nB", "1")]
        assert headers.first().header[:2] == ["name", "v"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_mark_of_byte_order_before_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffk;v\n"a\n1";x\n\ufeffb;y\ufeff\n')
    rows, headers = read_csv_rows(spark, [str(tmp_path / "a.csv")])
    assert headers.first().header == ["k", "v"] and sorted(tuple(r.cells) for r in rows.collect()) == [("a\n1", "x"), ("b", "y\ufeff")]
