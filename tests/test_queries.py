"""Every registered timeline query against its SQL, on the smallest test data."""

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from spanloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
ALL, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def table(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    assert table(ALL[name](spark, SF).toPandas()) == table(con.sql(SQL[name]).df())


def small_events(tmp_path, rows):
    """A folder with ``events`` of (user_id, seconds on the timeline, event_type, value), and its views in DuckDB."""
    c = duckdb.connect()
    each = ", ".join(f"({i}::bigint, timestamp '2024-01-01' + to_microseconds({round(t * 6e8)}::bigint), {v}::bigint, '{kind}', {value}::double, '')" for i, (v, t, kind, value) in enumerate(rows))
    c.sql(f"copy (select * from (values {each}) x(event_id, ts, user_id, event_type, value, props)) to '{tmp_path}/events.parquet' (format parquet)")
    c.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    return c


@pytest.mark.parametrize("name", ["boundary_f1", "score_gate"])
def test_regions_without_length_are_boundaries(spark, tmp_path, name):
    c = small_events(tmp_path, [(1, 10, "view", 4), (1, 100, "error", 0), (1, 103.5, "view", 0), (1, 200.005, "click", 0), (1, 200.01, "view", 2)])
    assert table(ALL[name](spark, str(tmp_path)).toPandas()) == table(c.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    df = ALL[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("gone", [("spanloom/llm", "tests/llm"), ("spanloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_lives_without_llm(tmp_path, gone):
    """A copy without the training-data subpackage, with or without the pipeline's file, imports and offers the other queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    for path in gone:
        target = copy / path
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert 'covered_seconds' in q and not [n for n in q if n == 'pipeline' or n.startswith('op1_')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
