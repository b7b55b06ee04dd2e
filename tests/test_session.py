"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from advisoryspark.session import work_dir


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default)),
                           sparkContext=SimpleNamespace(master=master))


def test_machine_local_folders_are_refused_off_local_masters():
    folder = {"spark_sql_warehouse_dir": "file:/home/me/warehouse"}
    assert work_dir(session("local[4]", **folder)) == "file:/home/me/warehouse/advisoryspark-work"
    for master in ("spark://host:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_dir(session(master, **folder))
        with pytest.raises(ValueError):
            work_dir(session(master, spark_sql_warehouse_dir="/home/me/warehouse"))
        assert work_dir(session(master, spark_checkpoint_dir="/shared", **folder)) == "/shared"
        assert work_dir(session(master, spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w/advisoryspark-work"
