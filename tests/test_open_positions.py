"""What is held at the end: fills are read and dealt once, a key's history is read as a stream, and each bit is that of the ordered fold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import ledger
from ledgerlake.plans import ledger_queries
from ledgerlake.sources import testdata as v

SF = "/root/testdata/sf0.001"
D0 = dt.date(2020, 1, 1)
QTY = [2.0, -3.0, 1.0, 1.0, -1.0, 0.1, 0.2, -0.3, 5.0, -2.0, -4.0, -1.0, 3.0, -3.0, 7.0, 1.0, 1.0, -20.0, 11.0, 4.0, -0.7, 2.5]


def brute(rows):
    """(quantity, avg_cost, realized) of each key's last episode: its fills one by one, cut where the position changes its side."""
    out = {}
    for s, a, _, p, fee, x, _ in sorted(rows, key=lambda r: (str(r[0]), r[2])):
        q, avg, gain, fees = out.get((s, a), (0.0, 0.0, 0.0, 0.0))
        if abs(q) <= 1e-9:
            q, avg, gain, fees = 0.0, 0.0, 0.0, 0.0
        if q * (q + x) < 0:
            fee, x, q, avg, gain, fees = fee * abs((q + x) / x), q + x, 0.0, 0.0, 0.0, 0.0
        if q * x >= 0:
            avg = (avg * abs(q) + p * abs(x)) / abs(q + x)
        else:
            gain += (p - avg) * abs(x) * (1 if q > 0 else -1)
        out[s, a] = q + x, avg, gain, fees + fee
    return {k: (q, avg, gain - fees) for k, (q, avg, gain, fees) in out.items() if abs(q) > 1e-9}


@pytest.mark.parametrize("pack", (1, 3, 256))
def test_days_give_what_the_history_gives(spark, monkeypatch, pack):
    """Flips, days that begin flat, parts of shares, a null key, one that ends flat and one that never turns."""
    monkeypatch.setattr(ledger, "PACK", pack)
    rows = [(s, "a", i, 5.0 + i % 3 + i / 7, 0.5, q * (k + 1), D0 + dt.timedelta(i // (k + 1))) for k, s in enumerate(("s", None, "t")) for i, q in enumerate(QTY)]
    rows += [("f", "b", i, 3.0 + i, 0.1, q, D0 + dt.timedelta(i)) for i, q in enumerate((1.0, 2.0, -3.0))] + [("u", "b", i, 3.0 + i / 9, 0.1, 1.0 + i % 2 * -0.25, D0 + dt.timedelta(i // 40)) for i in range(300)]
    fills = spark.createDataFrame(rows, "sleeve string, symbol string, seq long, price double, fees double, qty double, date date").repartition(7)
    cal = ledger.build_calendar(fills.select("date"), fills)
    last = spark.createDataFrame([("a", 6.0), ("b", 4.0)], "symbol string, last double")
    sums = fills.groupBy("sleeve", "symbol", "date").agg(F.sum("qty").alias("qty"))
    found = [sorted(map(tuple, x.collect()), key=str) for x in (ledger.open_positions(fills, last, cal), ledger.open_positions(fills, last, cal, unordered=sums, parts=3), ledger.open_positions(fills.withColumn("at", F.col("seq")).drop("seq"), last, cal, unordered=sums, order=("at",)))]
    want = brute(rows)
    assert {(r[0], r[1]) for r in found[0]} == set(want) and len(found[0]) == 4
    for got in found:
        for a, b in zip(got, found[0], strict=True):
            assert a[:2] == b[:2] and a[3] == want[a[:2]][1] and a[2:] == pytest.approx(b[2:])
            assert (a[2], a[8]) == pytest.approx((want[a[:2]][0], want[a[:2]][2]))


def test_nulls_are_those_of_sql():
    row = lambda qs, prices: next(ledger.costs_of([("s", "a", D0, 1, qs, prices, 1.0, None, D0)]))[3:6]
    assert row([1.0, 1.0], [4.0, None]) == (None, 0.0, None)
    assert row([2.0, -1.0], [4.0, None]) == (4.0, None, None)
    assert row([2.0, None, 1.0], [4.0, 5.0, 6.0]) == (4.0, None, None)
    assert list(ledger.costs_of([])) == []


def test_days_before_the_last_episode_are_left(spark):
    rows = [("s", "a", i, 5.0, 0.0, q, D0 + dt.timedelta(i)) for i, q in enumerate((4.0, 1.0, -7.0, -1.0, 5.0, 2.0, 1.0))]
    fills = spark.createDataFrame(rows, "sleeve string, symbol string, seq long, price double, fees double, qty double, date date")
    assert sorted((r.seq, r.leg, r.q) for r in ledger.last_legs(fills, fills).collect()) == [(4, 0, 3.0), (4, 1, 2.0), (5, 0, 2.0), (6, 0, 1.0)]


def test_fills_are_read_and_dealt_once(spark):
    plan = ledger_queries.open_positions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x and "l_partkey" in x]
    assert len(scans) == 1
    dealt = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
    assert sorted("day#" in x.split("hashpartitioning(")[1].split("), REPARTITION")[0] for x in dealt) == [False, True]
    assert not any("l_orderkey" in x and "day#" not in x.split("l_orderkey")[0] for x in plan.splitlines() if " Sort [" in x and "_fill" in x)
    assert "collect_list" in plan and "pack#" in plan


def test_days_of_fills_have_their_sums_and_closes(spark):
    days = v.fill_days(spark, SF)
    want = v.fills(spark, SF, numbered=False).groupBy("sleeve", "symbol", "date").agg(F.sum("qty"), F.sum(F.col("qty") * F.col("price")), F.sum("fees"))
    key = lambda r: tuple(map(str, r[:3]))
    got, wanted = ({key(r): tuple(r[3:6]) for r in x.collect()} for x in (days, want))
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in got)
    closes = {(r.symbol, r.date): r.close for r in days.groupBy("symbol", "date").agg((F.sum("paid") / F.sum("shares")).alias("close")).collect()}
    prices = {(r.symbol, r.date): r.close for r in v.prices(spark, SF).collect()}
    assert closes.keys() == prices.keys() and all(closes[k] == pytest.approx(prices[k], rel=1e-12) for k in closes)


def test_fills_mark_what_has_no_close(spark, monkeypatch):
    make, brand = v.fill_days, "Brand#11"
    monkeypatch.setattr(v, "fill_days", lambda *a: make(*a).withColumn("paid", F.when(F.col("symbol") != brand, F.col("paid"))))
    found = {r.last for r in ledger_queries.open_positions(spark, SF).where(F.col("symbol") == brand).collect()}
    want = v.fills(spark, SF).where(F.col("symbol") == brand).agg(F.max_by("price", F.struct("date", "seq", "sleeve"))).first()[0]
    assert found == {round(want * 1024) / 1024}
