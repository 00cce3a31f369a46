"""Staged tables: written where the session says, dropped when asked, and never on the disks of single executors."""

from types import SimpleNamespace

import pytest

from quillstream.staging import SHUFFLES, Staging, checkpoint_root


def test_cut_and_drop(spark):
    st = Staging(spark, "test")
    frame = st.cut(spark.range(5), "numbers")
    assert sorted(r.id for r in frame.collect()) == [0, 1, 2, 3, 4]
    st.drop(frame, None)
    with pytest.raises(Exception):
        spark.read.parquet(frame._staged_path).collect()


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        checkpoint_root(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "s3://bucket/shared/"), sparkContext=cluster.sparkContext)
    assert checkpoint_root(named) == "s3://bucket/shared"


def test_shuffle_files_go_with_the_table_they_made(spark):
    def left():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = left()
    Staging(spark, "kept").cut(spark.range(1000).repartition(3, "id"), "a")
    assert left() - before
    before = left()
    rows = Staging(spark, "dropped", drop_shuffles=True).cut(spark.range(1000).repartition(3, "id"), "a")
    assert not {x for x in left() - before if x.endswith(".data")}
    assert rows.count() == 1000
    assert spark.conf.get(SHUFFLES, None) is None
