"""The shared folder: required on a cluster, one folder per session, removable."""

import os
from types import SimpleNamespace

import pytest

from featforge import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_the_setting(master):
    fake = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master, applicationId="app"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake)
    fake.conf["spark.checkpoint.dir"] = "hdfs://name/shared/"
    assert session.shared_folder(fake) == "hdfs://name/shared"
    assert session.scratch_path(fake, "x").startswith("hdfs://name/shared/featforge/app/x-")


def test_stored_tables_and_their_removal(spark):
    table = session.stored(spark.range(10), "numbers")
    assert table.count() == 10
    folder = os.path.dirname(table.inputFiles()[0].removeprefix("file://").removeprefix("file:"))
    assert os.path.isdir(folder)
    session.clear_scratch(spark)
    assert not os.path.exists(folder)
