"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest
from marlpath.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    found = duck.execute(ORACLES[name])
    have = [d[0] for d in found.description]
    assert sorted(have) == cols
    want = sorted(tuple(plain(r[have.index(c)]) for c in cols) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_json_arrays_of_a_user_are_bounded(spark):
    from marlpath.plans.relational_queries import packed_events
    from pyspark.sql import functions as F

    events = spark.range(1000, numPartitions=3).select(F.lit(7).alias("user_id"), F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props"))
    sizes = [r["n"] for r in packed_events(events, 100).select(F.json_array_length("data").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 40, set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True)
    assert said.stdout.split() == ["True", "True"], said.stderr[-500:]


def test_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
