from types import SimpleNamespace

import pytest

from wattloom.storage import fresh_path, materialise, run_of, shared_folder


class Context:
    """Stands in for a context that no checkpoint folder was configured for."""

    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, configured=None):
    conf = SimpleNamespace(get=lambda key, default: configured or default)
    return SimpleNamespace(conf=conf, sparkContext=Context(master))


def test_configured_folder_is_used():
    assert shared_folder(session("yarn", "hdfs://shared/folder/")) == "hdfs://shared/folder"


def test_local_session_gets_one_folder_of_its_own():
    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.sparkContext.folder


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))


def test_materialised_table_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, [1.0, None]), (2, None)], "id int, v array<double>")
    table = materialise(df, "t")
    assert table.schema == df.schema
    assert sorted(table.collect()) == sorted(df.collect())
    assert fresh_path(spark, "t") != fresh_path(spark, "t")


def test_a_run_deletes_its_own_tables_only(spark):
    before = materialise(spark.range(3), "before")
    with run_of(spark):
        outer = materialise(spark.range(4), "outer")
        with run_of(spark):
            inner = materialise(spark.range(5), "inner")
            assert inner.count() == 5
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|No such file"):
            inner.collect()
        assert outer.count() == 4
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|No such file"):
        outer.collect()
    assert before.count() == 3 and materialise(spark.range(2), "after").count() == 2


def test_a_run_that_fails_is_cleaned_too(spark):
    with pytest.raises(RuntimeError), run_of(spark):
        left = materialise(spark.range(4), "left")
        raise RuntimeError
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|No such file"):
        left.collect()
