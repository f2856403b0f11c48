"""Where checkpoints go."""

import types

import pytest

from cardmill.session import shared_folder


class Context:
    def __init__(self, master, named=None, current=None):
        self.master, self.current = master, current
        self._conf = {"spark.checkpoint.dir": named} if named else {}

    def getConf(self):
        return types.SimpleNamespace(get=self._conf.get)

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, folder):
        self.current = folder


def session(context):
    conf = types.SimpleNamespace(get=lambda name, default=None: default)
    return types.SimpleNamespace(sparkContext=context, conf=conf)


def test_the_named_folder_is_used():
    context = Context("spark://host:7077", named="hdfs:///shared")
    assert shared_folder(session(context)) == "hdfs:///shared"
    assert context.current == "hdfs:///shared"


def test_a_folder_that_is_set_is_kept():
    assert shared_folder(session(Context("yarn", current="hdfs:///set"))) == "hdfs:///set"


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        shared_folder(session(Context(master)))


def test_local_sessions_get_a_temporary_folder():
    context = Context("local[2]")
    assert shared_folder(session(context)) == context.current
