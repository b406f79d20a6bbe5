import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from marlpath.llm.frames import gapless_rank, pinned, released, shared_folder
from pyspark.sql import SparkSession
build = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
spark = (build.config("spark.checkpoint.dir", sys.argv[1]) if len(sys.argv) > 1 else build).getOrCreate()
try:
    table = pinned(spark.range(3), "three")
    print("ROWS", table.count())
    released(spark, table)
except RuntimeError as e:
    print("ERROR", e)
"""


def said(tmp_path, *args):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    return subprocess.run([sys.executable, "-c", CODE, *args], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200).stdout


def test_a_session_without_a_shared_folder_is_told_so(tmp_path):
    assert "ERROR set spark.checkpoint.dir" in said(tmp_path)


def test_pinned_tables_stand_in_the_shared_folder_until_released(tmp_path):
    assert "ROWS 3" in said(tmp_path, (tmp_path / "shared").as_uri())
    assert not list((tmp_path / "shared").glob("three-*"))
