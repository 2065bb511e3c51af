"""The package reaches Python workers wherever the driver starts."""

import os
import subprocess
import sys
import tempfile

from tests.conftest import ROOT, SF001

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
print("ROWS", e.queries()["forest_nodes"](spark, {SF001!r}).count(), e.entry(spark).count())
"""


def test_udfs_run_from_another_directory():
    with tempfile.TemporaryDirectory() as cwd:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    rows = [line for line in out.stdout.splitlines() if line.startswith("ROWS")]
    assert rows, out.stderr[-2000:]
    _, nodes, responses = rows[0].split()
    assert int(nodes) > 0 and int(responses) == 1000
