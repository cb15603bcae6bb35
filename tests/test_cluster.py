"""Queries on a standalone cluster whose executors don't have the package on their path."""

import os
import socket
import subprocess
import sys
import time
from pathlib import Path

import pyspark
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
NAMES = ("aggregate_time", "cascade_levels", "p2_found", "p6_ids")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

DRIVER = """
import sys
from pyspark.sql import SparkSession
root, master, data, out, *names = sys.argv[1:]
sys.path.insert(0, root)
import __spark_entry__ as entry
conf = {"spark.master": master, "spark.driver.host": "127.0.0.1", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"{out}/shared"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in names:
    entry.queries()[name](spark, data).write.parquet(f"{out}/{name}")
"""


@pytest.fixture(scope="module")
def cluster(tmp_path_factory):
    home, scratch = Path(pyspark.__file__).parent, tmp_path_factory.mktemp("cluster")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(scratch), "PYSPARK_PYTHON": sys.executable, "SPARK_DAEMON_MEMORY": "512m"}
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    at = f"spark://127.0.0.1:{port}"
    deploy = "org.apache.spark.deploy"
    daemons = (
        [f"{deploy}.master.Master", "--host", "127.0.0.1", "--port", str(port), "--webui-port", "0"],
        [f"{deploy}.worker.Worker", "--host", "127.0.0.1", "--webui-port", "0", "-c", "2", "-m", "1g", "-d", f"{scratch}/work", at],
    )
    started = [subprocess.Popen([f"{home}/bin/spark-class", *d], env=env, cwd=scratch, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL) for d in daemons]
    for _ in range(60):
        with socket.socket() as s:
            if not s.connect_ex(("127.0.0.1", port)):
                break
        time.sleep(0.5)
    yield at, env, scratch
    for p in started:
        p.terminate()
        p.wait(20)


def test_queries_equal_those_of_a_local_session(spark, cluster):
    master, env, scratch = cluster
    done = subprocess.run([sys.executable, "-c", DRIVER, str(ROOT), master, DATA, str(scratch), *NAMES], env=env, cwd=scratch, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    for name in NAMES:
        got, want = spark.read.parquet(f"{scratch}/{name}"), entry.queries()[name](spark, DATA)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


# queries of an application that loads the entry anew for each of them
AGAIN = (
    "p3_found",
    "p6_ids",
    "p7_found",
    "p4_percentiles",
    "p5_found",
    "advect_cells",
    "aggregate_fields_sum",
    "aggregate_time",
    "ar_ols_differenced",
    "ar_ols_ridge",
    "ar_yule_walker_localized",
    "asof_join",
    "band_depth_normalised",
    "binary_mse_merged",
    "blended_moments",
    "blending_steps",
    "boxcox_inverse",
    "cascade_levels",
    "categorical_merged",
    "cell_table",
    "cells_with_partner",
    "check_norain",
    "close_rain_gap",
    "continuous_merged",
    "crps",
    "decluster",
    "elliptic_opening",
    "enkf_forecast",
    "ensemble_skill",
)

RELOADING = DRIVER.replace("for name in names:\n", "import importlib\nfor name in names:\n    importlib.reload(entry)\n")


@pytest.fixture(scope="module")
def reloaded(cluster):
    master, env, scratch = cluster
    out = scratch / "again"
    done = subprocess.run([sys.executable, "-c", RELOADING, str(ROOT), master, DATA, str(out), "p2_found", *AGAIN], env=env, cwd=scratch, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    return out


@pytest.mark.parametrize("name", AGAIN)
def test_entry_loaded_for_each_query(spark, reloaded, name):
    got, want = spark.read.parquet(f"{reloaded}/{name}"), entry.queries()[name](spark, DATA)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


# queries of a local session that began elsewhere, before the entry was loaded
LATE = (
    "p4_percentiles",
    "p5_found",
    "p6_ids",
    "p7_found",
    "blending_steps",
    "cascade_levels",
    "enkf_forecast",
)

BEFORE = """
import sys
from pyspark.sql import SparkSession
root, data, out, *names = sys.argv[1:]
conf = {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
sys.path.insert(0, root)
import __spark_entry__ as entry
for name in names:
    entry.queries()[name](spark, data).write.parquet(f"{out}/{name}")
"""


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    out = tmp_path_factory.mktemp("late")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", BEFORE, str(ROOT), DATA, str(out), *LATE], env=env, cwd=out, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return out


@pytest.mark.parametrize("name", LATE)
def test_session_begun_before_the_entry(spark, late, name):
    got, want = spark.read.parquet(f"{late}/{name}"), entry.queries()[name](spark, DATA)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
