"""Where intermediate tables go, and when they are deleted."""

import threading
from pathlib import Path

import pytest

from sparktape import lineage
from sparktape.schema import TapeError


class Session:
    """What ``shared_folder`` asks of a session, with settings of its own."""

    def __init__(self, spark, master, **conf):
        self._jvm, self._jsc, self.settings = spark._jvm, spark._jsc, conf
        self.conf, self.sparkContext, self.master = self, self, master

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_a_machines_own_disk_is_refused_on_a_cluster(spark):
    own = {"spark_sql_warehouse_dir": "file:/tmp/warehouse"}
    assert lineage.shared_folder(Session(spark, "local[4]", **own)) == "file:/tmp/warehouse/sparktape-saved"
    for master in ("yarn", "k8s://x", "local-cluster[2,1,1024]", "spark://a:7077"):
        with pytest.raises(TapeError, match="spark.checkpoint.dir"):
            lineage.shared_folder(Session(spark, master, **own))
        assert lineage.shared_folder(Session(spark, master, spark_checkpoint_dir="file:/shared", **own)) == "file:/shared"


def test_scopes_belong_to_their_thread(spark):
    kept = []
    with lineage.scratch(spark):
        own = lineage.saved(spark.range(3))

        def other():
            kept.append(lineage.saved(spark.range(5)).inputFiles()[0])

        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        path = own.inputFiles()[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).exists() and Path(kept[0].removeprefix("file://")).exists()
