"""The shared folder where the session names none."""

from types import SimpleNamespace

import pytest

from lectern.llm.common import shared_dir


def session(master, found=None):
    unset = SimpleNamespace(get=lambda key, default=None: found)
    return SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master=master, applicationId=f"app of {master}"))


def test_one_process_has_a_folder_of_its_own_and_a_cluster_must_name_one():
    own = shared_dir(session("local[4]"))
    assert own.startswith("file:///") and own == shared_dir(session("local[4]")) != shared_dir(session("local"))
    assert shared_dir(session("spark://host:7077", "s3a://shared/x/")) == "s3a://shared/x"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master))
