"""Column states that are put together decide as one look at all rows does."""

import random

import pytest
from pyspark.sql import functions as F

from sheetwright.operators import profile


@pytest.mark.parametrize("mode", ["all_values", "digits_only"])
def test_states_of_batches_decide_as_all_rows_together(spark, mode, monkeypatch):
    rng = random.Random(4)
    n = 400
    # Shares of distinct values on both sides of the limit, far from it and at it.
    pools = [int(n * s) for s in (0.2, 0.9, 0.94, 0.95, 0.96, 1.0)]
    columns = [[str(50_000_000 + (i if i < p else rng.randrange(p))) for i in range(n)] for p in pools]
    columns += [[f"0{i:04d}" for i in range(n)], [f"{i},5" for i in range(n)], [rng.choice(["a", "b", None, " "]) for _ in range(n)], [f"1.234.{i:03d}" if i < 380 else "x" for i in range(n)]]
    rows = [(f"d{i % 2}", "t", i, [c[i] for c in columns]) for i in range(n)] + [("e", "t", 0, [None, ""]), ("f", "t", 0, ["7"])]
    df = spark.createDataFrame(rows, "doc_id string, table_name string, row_no int, cells array<string>")
    read = []
    count = profile._distinct_counts
    monkeypatch.setattr(profile, "_distinct_counts", lambda r, wanted: read.append(wanted.count()) or count(r, wanted))
    for every in (False, True):
        want = {tuple(r) for r in profile.column_decisions(df, mode, all_identifiers=every).select(*profile.COLUMN_KEY, "type", "fmt", "identifier").collect()}
        read.clear()
        states = [profile.column_state(df.where(F.col("row_no") % 5 == i), mode) for i in range(5)]
        merged = profile.merged_states([profile.merged_states(states[:2]), *states[2:]])
        got = profile.state_decisions(merged, df, all_identifiers=every)
        assert {tuple(r) for r in got.select(*profile.COLUMN_KEY, "type", "fmt", "identifier").collect()} == want
        # Of the fourteen columns of long values, six of whose shares are far from the limit, only the others are read again.
        assert sum(read) <= 10


def test_states_of_typed_cells(spark):
    cell = "struct<text:string,num:double,ts:timestamp,flag:boolean>"
    rows = [("d", "t", i, [(None, float(i), None, None), (None, None, None, i % 2 == 0), ("x" if i % 2 else None, None, None, None)]) for i in range(20)]
    df = spark.createDataFrame(rows, f"doc_id string, table_name string, row_no int, cells array<{cell}>")
    merged = profile.merged_states([profile.column_state(df.where("row_no < 7")), profile.column_state(df.where("row_no >= 7"))])
    assert {r.col_no: r.type for r in profile.state_decisions(merged, df).collect()} == {0: "number", 1: "boolean", 2: "text"}
