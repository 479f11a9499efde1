"""The shared folder: the cluster's setting, a temporary one for local masters only."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tidemark.session import shared_folder

ROOT = Path(__file__).resolve().parents[1]


def fake(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_the_setting_wins_and_a_cluster_needs_it():
    assert shared_folder(fake("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    local = shared_folder(fake(None, "local[2]"))
    assert local.startswith("file://") and local == shared_folder(fake(None, "local[2]"))
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_folder(fake(None, "spark://host:7077"))


def test_a_session_without_the_setting_can_store_tables(tmp_path):
    code = (
        "from tidemark.session import local_session, shared_folder; s = local_session('x', 1, '1g'); assert s.conf.get('spark.checkpoint.dir', None) is None;"
        "p = shared_folder(s) + '/t'; s.range(3).write.parquet(p); assert s.read.parquet(p).count() == 3"
    )
    import os

    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)})
