"""The driver's contract: all queries run, and those with SQL agree with it."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from edictum import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(one, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    if name in queries.ORACLES:
        want = db.execute(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} from ({queries.ORACLES[name]})").fetchall()
        assert got == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    import shutil

    shutil.copytree(f"{root}/edictum", tmp_path / "edictum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op1_') for n in e.queries()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(queries.QUERIES)), "False"]


def test_workers_import_the_package_wherever_the_driver_starts(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
from edictum import queries
print(queries.generated_programs(spark, {SF!r}).first()[:])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip().endswith("(24, True, True)"), out.stderr[-2000:]
