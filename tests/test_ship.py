"""Executors import the package though neither their folder nor PYTHONPATH has it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert set(o) <= set(q) and e.entry(spark).count() > 0
for name in {names!r}:
    if name in q:
        assert q[name](spark, "/root/testdata/sf0.001").count() > 0
print("shipped")
"""


def test_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=ROOT, names=["model_hook", "op2_trie_tokens", "op4_quality_mil", "op8_mixing"])
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "shipped" in done.stdout, done.stderr[-2000:]
