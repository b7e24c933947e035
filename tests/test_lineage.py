"""Where checkpoints go."""

from types import SimpleNamespace

import pytest
from refweave.functions import lineage


class Context:
    def __init__(self, master, named=None, held=None):
        self.master, self.named, self.held = master, named, held

    def getConf(self):
        return {"spark.checkpoint.dir": self.named} if self.named else {}

    def getCheckpointDir(self):
        return self.held

    def setCheckpointDir(self, path):
        self.held = path


def _dir(*context):
    made = Context(*context)
    return lineage.shared_dir(SimpleNamespace(sparkContext=made)), made


def test_the_named_folder_holds():
    assert _dir("spark://x", "file:///shared")[0] == "file:///shared"
    assert _dir("yarn", "file:///shared", "file:/shared/a-b")[0] == "file:///shared"
    folder, context = _dir("yarn", "hdfs://n/shared")
    assert context.held == folder == "hdfs://n/shared"


def test_a_folder_set_since_then_is_followed():
    assert _dir("yarn", "file:///shared", "file:/other/a-b")[0] == "file:///other/a-b"
    assert _dir("yarn", None, "hdfs://n/set")[0] == "hdfs://n/set"


def test_none_is_an_error_on_a_cluster_only():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _dir("local-cluster[2,1,1024]")
    folder, context = _dir("local[4]")
    assert folder.startswith("file:///") and context.held == folder


def test_fresh_names(spark):
    assert lineage.fresh(spark.range(1).toDF("Gone"), "gone") == "_gone" and lineage.fresh(spark.range(1), "gone") == "gone"
