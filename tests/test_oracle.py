"""Every registered query that has SQL gives the same rows in DuckDB on the same tables."""

import datetime as dt
import glob
import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
ORACLES = __spark_entry__.registered.ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return str(v.date()) if v.time() == dt.time(0) else str(v)
    return str(v) if isinstance(v, dt.date) else v


def order_of(row):
    """Texts and whole numbers decide first, then rounded figures."""
    return [str(v) for v in row if not isinstance(v, float)], [round(v, 3) for v in row if isinstance(v, float)]


def same(a, b):
    """Equal, but for a last digit that a tie in rounding may turn either way."""
    return len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-7, abs_tol=0.0101 if abs(x) > 50 else 1.1e-6) if isinstance(x, float) and isinstance(y, (int, float)) else x == y for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    names = sorted(df.columns)
    found = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    want = duck.execute(ORACLES[name])
    order = [[x[0] for x in want.description].index(c) for c in names]
    assert sorted(x[0] for x in want.description) == names
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=order_of)
    assert len(found) == len(expected) and all(same(a, b) for a, b in zip(sorted(found, key=order_of), expected))


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 3
