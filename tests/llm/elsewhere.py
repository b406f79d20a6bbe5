"""Runs a query in a process of its own, from another folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.queries()[sys.argv[1]](spark, "/root/testdata/sf0.001").count())
"""


def run(name, folder):
    said = subprocess.run([sys.executable, "-c", CODE, name], cwd=folder, capture_output=True, text=True, timeout=300)
    assert "ROWS" in said.stdout, said.stderr[-800:]


