"""Where stage tables go, and that they can be removed."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from callgauge.session import materialize, shared_folder, stage_tables

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master, folder=None):
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(
        conf=SimpleNamespace(get=conf.get),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None),
    )


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session(master))
    assert shared_folder(session(master, "file:///shared")) == "file:///shared"


def test_one_machine_may_leave_it_unset(tmp_path):
    # a session of its own without any defaults, since the one of the tests has the setting
    code = """
from callgauge.session import get_spark, materialize, shared_folder
spark = get_spark(master="local[1]", **{"spark.ui.enabled": "false"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert shared_folder(spark) == shared_folder(spark)
assert materialize(spark.range(5)).count() == 5
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120, env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)})


def files(df):
    return [f.removeprefix("file:").replace("///", "/") for f in df.inputFiles()]


def test_stage_tables_are_removed(spark):
    with stage_tables(spark):
        outer = materialize(spark.range(3))
        with stage_tables(spark):
            within = files(materialize(outer))
            assert all(map(os.path.exists, within))
        paths = files(outer)
        assert all(map(os.path.exists, paths)) and not any(map(os.path.exists, within))
    assert not any(map(os.path.exists, paths))
