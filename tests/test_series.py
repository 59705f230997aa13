"""Readers and writers of series, and the demonstration book."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.plans.book import Book
from ledgerlake.sources import journal, series

D = lambda day: dt.date(2024, 1, day)


def test_clean_close_and_its_report(spark):
    rows = [("A", D(2), 10.0, 1), ("A", D(2), 11.0, 2), ("A", D(3), -1.0, 3), ("A", D(4), None, 4), ("A", D(5), 13.2, 5), ("A", D(15), 13.2, 6), ("A", D(16), float("inf"), 7)]
    good, report = series.clean_close(spark.createDataFrame(rows, "symbol string, date date, close double, seq int"))
    assert [(r.date, r.close) for r in good.orderBy("date").collect()] == [(D(2), 11.0), (D(5), 13.2), (D(15), 13.2)]
    r = report.first()
    assert (r.raw, r.clean, r.duplicates, r.invalid, r.missing, r.gaps, r.extreme) == (7, 3, 1, 1, 2, 1, 1) and r.rise == pytest.approx(0.2)
    zero, report = series.clean_close(spark.createDataFrame([("Y", D(2), 0.0, 1), ("Y", D(3), -0.1, 2), ("Y", D(4), 0.25, 3)], "symbol string, date date, close double, seq int"), positive=False)
    assert zero.count() == 2 and report.first().rise == 0.25


def test_macro_files_and_membership(spark, tmp_path):
    (tmp_path / "u.csv").write_text("DATE,UNRATE\n2024-01-01,3.7\n2024-02-01,.\n2024-03-01,3.8\n")
    (tmp_path / "f.csv").write_text("observation_date,FEDFUNDS\n2024-01-01,5.33\n2024-03-01,5.3\n")
    got = {r.month: (r.UNRATE, r.FEDFUNDS) for r in series.load_macro(series.read_fred(spark, str(tmp_path / "*.csv")), ["UNRATE", "FEDFUNDS"]).collect()}
    assert got == {D(1): (3.7, 5.33), dt.date(2024, 3, 1): (3.8, 5.3)}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "sp.csv").write_text('date,tickers\n2024-01-02,"brk.b, AAA,AAA"\n2024-01-05,BBB\n')
    assert {r.date: r.members for r in series.read_universe(spark, str(tmp_path / "m")).collect()} == {D(2): ["AAA", "BRK-B"], D(5): ["BBB"]}


def test_adjusted_closes_change_by_total_return(spark):
    rows = [("A", D(2), 100.0, 0.0), ("A", D(3), 99.0, 2.0), ("A", D(4), 110.0, 0.0)]
    x = [r.adjusted for r in series.adjusted_closes(spark.createDataFrame(rows, "symbol string, date date, close double, dividends double")).orderBy("date").collect()]
    assert x == pytest.approx([98.0, 99.0, 110.0])


def test_facts_and_share_lines(spark):
    doc = {"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2023-12-31", "val": 5, "filed": "2024-02-01", "accn": "x", "form": "10-K"}, {"end": "2023-12-31", "val": 6, "filed": "2024-03-01", "accn": "y", "form": "8-K"}]}}}}}
    (f,) = series.read_facts(spark.createDataFrame([(7, json.dumps(doc)), (8, "{}"), (9, None)], "cik int, json string"), ["10-K", "10-Q"]).collect()
    assert (f.cik, f.tag, f.value, f.filed, f.start) == (7, "Assets", 5.0, dt.date(2024, 2, 1), None)
    lines = series.one_line_per_company(spark.createDataFrame([(1, "AA"), (1, "AB"), (2, "C")], "cik int, symbol string"), spark.createDataFrame([("AA", 5.0), ("AB", 9.0)], "symbol string, volume double"))
    assert {tuple(r) for r in lines.collect()} == {(1, "AB"), (2, "C")}


def test_returns_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a", D(2), 0.01), ("a", D(3), -0.02), ("b", D(2), 0.5)], "series_id string, date date, ret double")
    series.export_returns(df, str(tmp_path / "out"))
    assert sorted(map(tuple, series.read_backtests(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, df.collect()))


def test_journals_keep_the_version_before(spark, tmp_path):
    path = f"file://{tmp_path}/cashflows"
    one = journal.transfer_rows(spark, "2024-01-02", "a", "b", 50.0)
    journal.save_journal(one, path, journal.CASHFLOWS)
    journal.save_journal(one.where("strategy = 'a'"), path, journal.CASHFLOWS)
    now, before = (journal.read_table(spark, p, journal.CASHFLOWS) for p in (path, path + ".bak"))
    assert now.count() == 1 and before.count() == 2
    good, bad = journal.validate_cashflows(before, ["a", "b"])
    assert good.agg(F.sum("value")).first()[0] == 0 and bad.count() == 0
    with pytest.raises(ValueError):
        journal.transfer_rows(spark, "2024-01-02", "a", "a", 50.0)


def test_unreadable_fees_are_a_violation(spark):
    raw = spark.createDataFrame([(i, "2024-01-02", "a", "X", "BUY", "1", "2", fee, None) for i, fee in enumerate(["", None, "0.5", "free"])], "seq long, date string, strategy string, symbol string, side string, quantity string, price string, fees string, note string")
    good, bad = journal.validate_trades(raw, ["a"])
    assert sorted(r.fees for r in good.collect()) == [0.0, 0.0, 0.5] and [(r.seq, r.problem) for r in bad.collect()] == [(3, "fees are not a number")]


def test_the_demonstration_book_adds_up(spark):
    d = series.demo_book(spark, 120, 2)
    book = Book(d["fills"], d["cashflows"], d["prices"])
    k = book.kpis().collect()
    assert len(k) == 2 and all(r.net_invested == 100_000 and abs(r.nav - r.net_invested - r.pnl) < 1e-6 for r in k)
