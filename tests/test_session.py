"""The shared folder comes from the session; no local fallback on a cluster."""

import pytest

from storepulse.session import shared_dir


class _Conf:
    def get(self, key, default=None):
        return default


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt = master, ckpt

    def getCheckpointDir(self):
        return self._ckpt

    def getConf(self):
        return _Conf()

    def setCheckpointDir(self, d):
        self._ckpt = d


class _Session:
    def __init__(self, master, ckpt=None):
        self.sparkContext, self.conf = _Context(master, ckpt), _Conf()


def test_cluster_without_checkpoint_dir_is_an_error():
    with pytest.raises(RuntimeError):
        shared_dir(_Session("spark://master:7077"))


def test_configured_checkpoint_dir_is_used():
    assert shared_dir(_Session("yarn", ckpt="hdfs:///shared/ckpt/abc")) == "hdfs:///shared/ckpt/abc"


def test_local_mode_gets_a_private_folder():
    assert shared_dir(_Session("local[2]"))
