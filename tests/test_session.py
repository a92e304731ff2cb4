"""Where jobs may write."""

import os
from types import SimpleNamespace

import pytest

from runscope.session import file_bytes, fresh_path, job, shared_folder, written


def fake_session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))


def test_the_sessions_folder_is_used(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder and fresh_path(spark, "x").startswith(f"{folder}/x-")
    before = sum(len(files) for _, _, files in os.walk(folder))
    frame = written(spark.range(10))
    assert frame.count() == 10 and "Range" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert sum(len(files) for _, _, files in os.walk(folder)) > before


def test_a_cluster_must_name_a_shared_folder():
    assert shared_folder(fake_session("spark://host:1", "hdfs:///tmp/c/")) == "hdfs:///tmp/c"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake_session("spark://host:1"))


def test_a_local_session_falls_back_to_one_temporary_folder():
    session = fake_session("local[2]")
    assert os.path.isdir(shared_folder(session)) and shared_folder(session) == shared_folder(session)
