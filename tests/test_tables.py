from types import SimpleNamespace

import pytest

from strandlake.tables import drop_staged, shared_dir, stage


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder, set=lambda key, value: None)
    context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None))
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(session("local-cluster[3,2,1024]"))
    assert shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[4]"))


def test_staged_tables_can_be_dropped(spark):
    kept = stage(spark.range(5), "numbers")
    path = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert kept.count() == 5
    drop_staged(spark)
    from pathlib import Path

    assert not Path(path).exists()
