"""Every query's plan on the smallest tables: what must and must not be in it."""

import os
import re

import pytest
from pyspark.sql import functions as F

from workload import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
# Nothing may run Python per row, pair all rows, or sort everything in one task.
BANNED = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct",
          "BroadcastNestedLoopJoin", "rangepartitioning")
PLAIN = [n for n in QUERIES if not n.startswith("stream_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_plan(spark, name):
    df = QUERIES[name](spark, SF)
    plan = plan_of(df)
    for word in BANNED:
        assert word not in plan, word
    for spec in re.findall(r"windowspecdefinition\(([^,]*),", plan):
        assert " ASC" not in spec and " DESC" not in spec and "frame" not in spec, spec


def test_every_query_is_checked():
    assert set(QUERIES) == set(CHECKS)


def test_sample_is_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["table_sample"](spark, SF))
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_cap_is_a_top_n(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["capped_result"](spark, SF))


def test_one_pass_profile_is_a_hash_aggregate(spark):
    from sheetwright.operators.profile import column_stats
    from workload.cleaning import _part_rows

    plan = plan_of(column_stats(_part_rows(spark, SF)))
    assert "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_sniffing_does_not_sort_lines(spark, tmp_path):
    from sheetwright.sources.csvtables import read_lines, sniff

    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    plan = plan_of(sniff(read_lines(spark, [str(tmp_path)])))
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["q_total"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["q_filtered_total"](spark, SF))
    assert "EqualTo(l_returnflag,A)" in plan


def test_few_decisions_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan_of(QUERIES["normalize_cells"](spark, SF))


def test_a_capped_result_is_computed_once(spark, tmp_path):
    from sheetwright.operators.results import capped_now

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(0, 5000, 1, 7).withColumn("v", F.col("id") % 13).mapInArrow(count, "id long, v long")
    out = capped_now(rows, [F.col("v").desc(), "id"], 20)
    got = out.collect()
    assert seen.value == 5000
    assert [r.id for r in got] == [i for v in (12,) for i in range(12, 5000, 13)][:20] and out.columns == ["id", "v", "total_rows", "note"]
    assert {(r.total_rows, r.note) for r in got} == {(5000, "only the first 20 of 5000 rows are shown")}
    few = capped_now(spark.range(3).withColumn("x", F.lit(None).cast("string")), ["id"], 20).collect()
    assert [(r.id, r.x, r.total_rows, r.note) for r in few] == [(i, None, 3, None) for i in range(3)]
    assert capped_now(spark.range(3).where("id > 9"), ["id"]).isEmpty() and capped_now(spark.range(0), ["id"]).columns == ["id", "total_rows", "note"]
