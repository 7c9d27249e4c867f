import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from weirflow import session

HERE = Path(__file__).resolve().parents[1]


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf, applicationId="a"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch(cluster, "x")
    assert session.is_local("local[8]") and session.is_local("local") and not session.is_local("local-cluster[3,2,1000]") and not session.is_local("yarn")


def test_no_intermediate_data_is_left_behind(tmp_path):
    code = f"""
from weirflow.session import cut, local_session
spark = local_session("left", cores="1", spark__checkpoint__dir="file://{tmp_path}")
assert cut(spark.range(3), "x").count() == 3
import os
assert os.listdir("{tmp_path}/weirflow")
"""
    env = {**os.environ, "PYTHONPATH": str(HERE)}
    for end in ("", "spark.stop()\n"):
        subprocess.run([sys.executable, "-c", code + end], check=True, env=env, timeout=200, capture_output=True)
        assert not os.listdir(tmp_path / "weirflow")
