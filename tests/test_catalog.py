"""Every registered query against its SQL twin on the small tables."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

from conftest import SMALL

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402

spec = importlib.util.spec_from_file_location("check_twins", ROOT / "tools" / "check_twins.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, tables, name):
    df = entry.queries()[name](spark, SMALL)
    mine = df.collect()
    twin = entry.oracle_sql().get(name)
    if twin is None:
        assert mine
        return
    result = tables.execute(twin)
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert check.rows_of(df.columns, mine) == check.rows_of(columns, result.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 500 and {0, 1} < {r.total_results for r in rows}


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
