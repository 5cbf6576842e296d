"""The shared folder where the session names none, and where it names one."""

from types import SimpleNamespace

import pytest

from framelake.llm import scratch


def session(master, folder=None, application="app-1"):
    conf = SimpleNamespace(get=lambda key, default: folder or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=application))


def test_a_named_folder_is_taken():
    assert scratch.shared_folder(session("local-cluster[3,2,900]", "file:///shared/")) == "file:///shared"


def test_a_local_master_gets_one_folder_for_an_application():
    first = scratch.shared_folder(session("local[2]"))
    assert first.startswith("file://") and scratch.shared_folder(session("local[2]")) == first
    assert scratch.shared_folder(session("local", application="app-2")) != first


@pytest.mark.parametrize("master", ["local-cluster[3,2,900]", "yarn", "spark://host:1"])
def test_a_cluster_needs_a_named_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session(master))
