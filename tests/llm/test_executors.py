"""Executors have no copy of the package: whatever tasks need goes along with them."""

import os
import pathlib
import subprocess
import sys

ROOT = str(pathlib.Path(__file__).resolve().parents[2])
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def absent(batches):
    import importlib.util
    for batch in batches:
        assert importlib.util.find_spec("stratalens") is None
        yield batch

spark.range(1).mapInArrow(absent, "id long").collect()
sys.path.insert(0, sys.argv[1])
from stratalens.llm.queries import QUERIES
for name in ("op5_benchmark_decontamination", "op6_sentencepiece_viterbi", "op7_crf_language", "op8_cotrain_quality"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_tasks_need_no_package(tmp_path):
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    env = dict(os.environ, PYTHONPATH=os.pathsep.join(path))
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("op")] == ["200"] * 4
