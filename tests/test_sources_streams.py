"""Readers, validation, streams and engines on small inputs."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import engines, fundamentals, significance
from ledgerlake.plans.book import Book
from ledgerlake.sources import journal, testdata
from ledgerlake.streaming import positions

SF = "/root/testdata/sf0.001"


def test_journal_files(spark, tmp_path):
    (tmp_path / "trades.csv").write_text("# a comment\n Date, Strategy ,symbol,Side,quantity,price\n2026-01-05,a,spy,buy,10,100\n2026-01-05,a,spy,sell,-4,101\nno date,a,spy,buy,1,1\n2026-01-06,zz,SPY,HOLD,x,-1\n2026-01-06,a,SPY,BUY,0,5\n")
    raw = journal.read_table(spark, str(tmp_path / "trades.csv"), journal.TRADES)
    good, bad = journal.validate_trades(raw, ["a"])
    assert [(r.symbol, r.side, r.qty, r.fees) for r in good.orderBy("seq").collect()] == [("SPY", "BUY", 10.0, 0.0), ("SPY", "SELL", -4.0, 0.0)]
    assert sorted(r.problem for r in bad.collect()) == sorted(["date is not a date", "unknown strategy", "unknown side", "quantity is not a number", "price must be positive"])
    assert journal.append_valid(good, bad, str(tmp_path / "out")) == 5 and not (tmp_path / "out").exists()
    assert journal.append_valid(good, bad.where("false"), str(tmp_path / "out")) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_price_files(spark, tmp_path):
    (tmp_path / "xyz.csv").write_text("Date,Close,Dividends,Stock_Splits\n2026-01-05,50,0,0\n2026-01-06,,0,0\n2026-01-05,51,0.5,2\n")
    assert [tuple(r) for r in journal.read_prices(spark, str(tmp_path / "*.csv")).collect()] == [("XYZ", dt.date(2026, 1, 5), 51.0, 0.5, 2.0)]


def test_percent_files_and_bad_signals_are_named(spark):
    x = spark.createDataFrame([("a", dt.date(2026, 1, 5), 0.01), ("b", dt.date(2026, 1, 5), 2.5)], "series_id string, date date, ret double")
    good, bad = journal.split_percent_files(x)
    assert [r.series_id for r in good.collect()] == ["a"] and [r.series_id for r in bad.collect()] == ["b"]
    _, bad = journal.read_signals(spark.createDataFrame([("x", "{"), ("y", '{"kind":"weights","weights":{"A":0.9,"B":0.6}}'), ("z", '{"kind":"weights","weights":{"A":1.0}}')], "strategy string, json string"))
    assert {r.strategy: r.message for r in bad.collect()} == {"x": "unreadable", "y": "weights sum to more than 1"}


def test_selection_records(spark):
    meta = spark.createDataFrame([("s", '{"t1": true, "t2": false, "t3": null}')], "series_id string, final_tests string")
    assert tuple(journal.tests_summary(meta).first()) == ("s", 1, 2, ["t2"])


def run_stream(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_positions_end_where_the_batch_does(spark, tmp_path):
    fills = testdata.fills(spark, SF).where("sleeve = 1")
    fills.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fills.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_stream(positions.running_positions(stream), "positions", "update", tmp_path)
    last = out.groupBy("sleeve", "symbol").agg(F.max_by("qty", "n").alias("qty"), F.max("n").alias("n"))
    want = fills.groupBy("sleeve", "symbol").agg(F.sum("qty").alias("qty"), F.count("*").alias("n"))
    assert {tuple(r) for r in last.collect()} == {tuple(r) for r in want.collect()}


def test_streamed_windows_match_batch_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    out = run_stream(positions.windowed_sums(stream, late="60 days"), "windows", "complete", tmp_path)
    want = events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).count()
    assert {(r.event_type, r.start, r.n) for r in out.collect()} == {(r.event_type, r.w.start, r["count"]) for r in want.collect()}


def test_signed_logit_and_purged_splits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=400) > 0).astype(float)
    w = engines.signed_logit(x, y, np.array([1, 1]), 1e-3)
    assert w[1] > 0.5 and w[2] == 0.0
    splits = engines.purged_splits(100, 10, 2, 5)
    assert len(splits) == 45 and all(len(test) == 20 for _, test in splits)
    train, test = splits[0]
    assert min(abs(a - b) for a in train for b in test) > 5


def test_point_in_time(spark):
    facts = spark.createDataFrame([("k", dt.date(2026, 1, 1), dt.date(2025, 12, 31), 1.0), ("k", dt.date(2026, 4, 1), dt.date(2026, 3, 31), 2.0)], "k string, filed date, end date, v double")
    cal = spark.createDataFrame([("k", d) for d in (dt.date(2026, 1, 1), dt.date(2026, 1, 2), dt.date(2026, 4, 2), dt.date(2027, 4, 2))], "k string, date date")
    assert {r.date: r.v for r in fundamentals.known_values(cal, facts, ["k"], "v", 200).collect()} == {dt.date(2026, 1, 1): None, dt.date(2026, 1, 2): 1.0, dt.date(2026, 4, 2): 2.0, dt.date(2027, 4, 2): None}


def test_audit_finds_look_ahead(spark):
    x = spark.createDataFrame([("s", dt.date(2026, 1, 1) + dt.timedelta(i), float(i)) for i in range(20)], "series_id string, date date, ret double")
    assert significance.truncation_audit(lambda d: d.crossJoin(d.agg(F.max("ret").alias("m"))), x, "2026-01-10").count() == 10
    assert significance.truncation_audit(lambda d: d.where("ret > 1"), x, "2026-01-10").count() == 0


def test_book_facade(spark):
    book = Book(testdata.fills(spark, SF), testdata.cashflows(spark, SF), testdata.prices(spark, SF), testdata.returns(spark, SF))
    total = book.attribution()
    whole = total.where("sleeve is null").first().pnl
    assert total.where("sleeve is not null and symbol is null").agg(F.sum("pnl")).first()[0] == pytest.approx(whole)
    assert book.live_summary().count() == 5 and book.backtest_then_live().count() > 0 and book.total.count() == book.calendar.count()
