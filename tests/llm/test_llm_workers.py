"""Tasks need no copy of this package on the workers: queries in a process whose Python workers cannot import it."""

import os
import subprocess
import sys

import pytest

from conftest import ROOT, SF0001

SCRIPT = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
s = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
     .config("spark.checkpoint.dir", tempfile.mkdtemp()).getOrCreate())
s.sparkContext.setLogLevel("OFF")
def absent(_):
    try:
        import postmine
    except ModuleNotFoundError:
        return [1]
    return [0]
assert s.sparkContext.parallelize([0], 1).mapPartitions(absent).collect() == [1]
from postmine.llm.queries import QUERIES
for name in {names!r}:
    assert QUERIES[name](s, {sf!r}).count() > 0, name
print("all done")
"""


@pytest.mark.parametrize("names", [["op6_hmm_score", "op9_quality_classifier"], ["op4_best_fit_packing", "op11_secret_scan", "op12_vector_codes", "op13_hard_negatives"]])
def test_workers_without_the_package(names, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    if "PYTHONPATH" in os.environ:  # all but this repository
        env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ["PYTHONPATH"].split(os.pathsep) if p and os.path.abspath(p) != ROOT)
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, names=names, sf=SF0001)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in run.stdout, run.stderr[-3000:]
