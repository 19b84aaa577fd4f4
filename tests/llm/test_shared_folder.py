"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from tallgrass.llm.common import shared_dir


def session(master, **conf):
    found = {k.replace("_", "."): v for k, v in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: found.get(k, *d)), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    assert shared_dir(session("spark://a:7077", spark_checkpoint_dir="file:/shared/")) == "file:/shared"
    assert shared_dir(session("local[2]")).startswith("file://")
    assert shared_dir(session("yarn", spark_sql_warehouse_dir="hdfs://a/w/")) == "hdfs://a/w/_tallgrass_work"
    for path in ("file:/home/w", "/home/w"):
        with pytest.raises(ValueError):
            shared_dir(session("local-cluster[2,1,1024]", spark_sql_warehouse_dir=path))
