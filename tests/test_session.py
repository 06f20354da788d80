from __future__ import annotations

import pytest

from shelflife.session import is_written, mounted_path, shared_dir, write_once


def test_mounted_path():
    assert mounted_path("/a b/c%20d") == "/a b/c%20d"
    assert mounted_path("file:///a%20b") == "/a b"
    assert mounted_path("file:/a") == "/a"
    with pytest.raises(ValueError):
        mounted_path("hdfs://host/a")


def test_shared_dir_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    first, second = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert first != second and "/shelflife/x-" in first
    assert named is None or first.startswith(named.rstrip("/") + "/")


def test_no_local_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda name, default: default)

    class Cluster:
        conf, sparkContext = Conf, type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Cluster, "x")


def test_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not is_written(spark, path)
    assert write_once(spark.range(3), path).count() == 3
    assert is_written(spark, path)
    assert write_once(spark.range(99), path).count() == 3


def test_half_written_is_written_again(spark, tmp_path):
    path = tmp_path / "t"
    write_once(spark.range(3), str(path))
    (path / "_SUCCESS").unlink()
    assert write_once(spark.range(5), str(path)).count() == 5
