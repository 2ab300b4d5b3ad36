import threading

import pytest

from seismopair import shared


class Session:
    """What shared_dir looks at."""

    def __init__(self, master, folder=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.held = master, {"spark.checkpoint.dir": folder} if folder else {}

    def get(self, key, default=None):
        return self.held.get(key, default)

    def set(self, key, value):
        self.held[key] = value


def test_a_cluster_needs_a_shared_folder():
    assert shared.shared_dir(Session("local[4]")).startswith("file:///")
    assert shared.shared_dir(Session("spark://x:7077", "s3a://b/c/")) == "s3a://b/c"
    for master in ("spark://x:7077", "yarn", "k8s://y", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(Session(master))


def test_staged_tables_go_when_released(spark):
    before = spark.conf.get(shared._CLEANUP, None)
    made = []
    threads = [threading.Thread(target=lambda: made.append(shared.stage(spark.range(10), "t"))) for _ in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(shared._CLEANUP, None) == before and [t.count() for t in made] == [10] * 3
    path = made[0]._staged
    shared.release(made[0], spark.range(3), None)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)) and made[1].count() == 10
    shared.release(*made)


def test_broadcast_sides_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows = spark.range(5).selectExpr("id", "array_repeat(1.0D, 1000) as data")
    assert shared.small(rows, 5, "data") is not rows and shared.small(rows, 4, "data") is rows
    monkeypatch.setattr(shared, "SMALL_BYTES", 5 * 1000 * 8 - 1)
    assert shared.small(rows, 5, "data") is rows and shared.small(rows, 5) is not rows
