from types import SimpleNamespace

import pytest

from threadspark.session import fresh_path, shared_dir


def session(master, configured=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}-{configured}")
    conf = SimpleNamespace(get=lambda key, default: configured if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_named_folder_is_used():
    assert shared_dir(session("yarn", "hdfs://x/ck/")) == "hdfs://x/ck"
    assert fresh_path(session("yarn", "hdfs://x/ck"), "a").startswith("hdfs://x/ck/threadspark/")


def test_only_a_local_master_may_go_without():
    assert shared_dir(session("local[2]")) == shared_dir(session("local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(session("yarn"))
