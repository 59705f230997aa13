"""Figures of series without losses, as large tables have them: the queries give what their SQL divides out."""

import glob

import duckdb
import pytest

import __spark_entry__
from tests.test_oracle import order_of, plain, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def calm(tmp_path_factory):
    """Returns of A are never negative, those of N fall on one day, those of R as they are; the low tail of A and N is no loss."""
    folder = tmp_path_factory.mktemp("calm")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = path.split("/")[-1][:-8]
        day = "(SELECT min(l_shipdate) + INTERVAL 500 DAY FROM t)"
        row = f"""SELECT * REPLACE (CASE WHEN l_returnflag = 'R' THEN l_discount WHEN l_returnflag = 'N' AND l_shipdate BETWEEN {day} AND {day} + INTERVAL 40 DAY THEN 0.01
            ELSE 0.052 + 0.001 * (day(l_shipdate) % 7) END AS l_discount) FROM t""" if name == "lineitem" else "SELECT * FROM t"
        con.execute(f"CREATE OR REPLACE VIEW t AS SELECT * FROM '{path}'")
        con.execute(f"COPY ({row}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["perf_summary", "rg_perf_stats", "sp_perf_stats", "stats_row", "summary_frame", "tearsheet", "sharpe", "sortino"])
def test_series_without_losses(spark, calm, name):
    con = duckdb.connect()
    for path in glob.glob(f"{calm}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    df = __spark_entry__.queries()[name](spark, calm)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order_of)
    want = con.execute(__spark_entry__.registered.ORACLES[name])
    order = [[x[0] for x in want.description].index(c) for c in names]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=order_of)
    assert len(found) == len(expected) and all(same(a, b) for a, b in zip(found, expected, strict=True))
