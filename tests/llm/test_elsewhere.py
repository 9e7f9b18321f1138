"""Executors have numpy and pyarrow, but not this package: every operator runs from another folder."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import corpus_pipeline
from trackmill.llm import queries

conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
def missing(_):
    try:
        import trackmill
    except ModuleNotFoundError:
        yield 1
assert spark.sparkContext.parallelize([0], 1).mapPartitions(missing).collect() == [1]
for name, run in (queries.queries() | {"pipeline": corpus_pipeline.run}).items():
    print(name, len(run(spark, sys.argv[2]).collect()), flush=True)
"""


def test_executors_do_not_need_this_package(tmp_path, small):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(Path(__file__).resolve().parents[2]), small], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.strip().splitlines()) == 14
