"""The shared folder: that of the session, or one of our own on a single machine only."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from lumberline import session

CODE = """
from lumberline.session import cut, drop_cut, local_session, run_dir, shared_dir
s = local_session(1, 1)
assert s.sparkContext.getConf().get("spark.checkpoint.dir") is None
d = cut(s, s.range(5), "x")
assert d.count() == 5 and shared_dir(s) == shared_dir(s) and s.sparkContext.getCheckpointDir()
drop_cut(d)
print("AT", run_dir(s))
"""


def test_without_the_setting(tmp_path):
    root = Path(session.__file__).parent.parent
    env = {k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(root)}
    got = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=240)
    assert got.returncode == 0, got.stderr[-2000:]
    at = got.stdout.rpartition("AT ")[2].strip()
    assert at.startswith("/") and not Path(at).exists()


class _Cluster:
    class conf:
        get = staticmethod(lambda k, d=None: None)

    class sparkContext:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(dict)


def test_a_cluster_needs_the_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster)
