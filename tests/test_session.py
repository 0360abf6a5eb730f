"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from sheetwright.plans.session import new_path, shared_dir, written


def fake(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))


def test_shared_folder_comes_from_the_session():
    assert shared_dir(fake("hdfs://shared/x/", "yarn")) == "hdfs://shared/x"


def test_a_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError):
        shared_dir(fake(None, "spark://host:7077"))


def test_local_master_may_use_a_local_folder():
    assert shared_dir(fake(None, "local[4]")).endswith("sheetwright-checkpoints")


def test_written_tables_keep_their_schema(spark):
    df = spark.sql("select 1 as a, array(named_struct('x', 'y')) as b, map('k', 2) as c")
    again = written(df, "test")
    assert again.dtypes == df.dtypes and again.first() == df.first()
    assert new_path(spark, "n") != new_path(spark, "n")
