"""The book as a whole, by hand and against NumPy."""

import datetime as dt

import numpy as np
import pytest

from ledgerlake.operators import orders
from ledgerlake.operators import portfolio as po
from ledgerlake.operators import signals as sg

D0 = dt.date(2021, 1, 1)


def series(spark, **values):
    return spark.createDataFrame([(k, D0 + dt.timedelta(i), float(x)) for k, r in values.items() for i, x in enumerate(r)], "series_id string, date date, ret double")


def test_targets_and_budgets(spark):
    rows = [("a", 2.0, None, True), ("b", 1.0, 3.0, None), ("c", 5.0, 1.0, False), ("d", None, 1.0, True), ("e", 1.0, -2.0, True)]
    df = spark.createDataFrame(rows, "sleeve string, target_weight double, risk_budget double, active boolean")
    assert {r.sleeve: (r.target, r.budget) for r in po.target_weights(df).collect()} == {"a": (0.5, None), "b": (0.25, 0.75), "d": (0.0, 0.25), "e": (0.25, None)}
    assert [r.target for r in po.target_weights(df.where("sleeve = 'd'")).collect()] == [0.0]
    assert po.target_weights(df.where("false")).collect() == []


def test_expected_portfolio(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 0.01, 100), rng.normal(0, 0.01, 90)
    targets = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0), ("z", 0.0)], "series_id string, target double")
    got = [r.ret for r in po.expected_portfolio(series(spark, a=a, b=b, z=a), targets).orderBy("date").collect()]
    want, held, month = [], None, None
    for i in range(90):
        day = D0 + dt.timedelta(i)
        if day.month != month:
            held, month = np.array([0.75, 0.25]), day.month
        new = held * (1 + np.array([a[i], b[i]]))
        want.append(new.sum() / held.sum() - 1)
        held = new
    assert np.allclose(got, want)
    assert po.expected_portfolio(series(spark, a=a[:50], b=b), targets).count() == 0


def test_volatility_targeting(spark):
    r = np.array([0.02, -0.01, 0.005, 0.03])
    w = 0.5 ** (np.arange(4)[::-1] / 2)
    vol = np.sqrt((w * r * r).sum() / w.sum() * 252)
    row = po.invest_fraction(series(spark, s=r), 0.1, 0.9, 2.0).first()
    assert row.volatility == pytest.approx(vol) and row.fraction == pytest.approx(min(0.9, 0.1 / vol))
    assert po.invest_fraction(series(spark, s=r), None).first().fraction == 1.0 and po.invest_fraction(series(spark, s=r), 9.0, 0.9).first().fraction == 0.9
    assert po.invest_fraction(series(spark, s=[0.0, 0.0]), 0.1).first().fraction == 1.0


def test_verdicts(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0.001, 0.01, 400)
    good, same, bad = rng.normal(0.002, 0.01, 400), base * 1.0 + rng.normal(0, 0.0005, 400) + 0.0001, base * 0.5 - 0.002
    df = series(spark, base=base, good=good, same=same, bad=bad)
    weights = spark.createDataFrame([("base", 0.4), ("good", 0.4), ("bad", 0.2), ("same", 0.0)], "series_id string, weight double")
    got = {r.series_id: r for r in po.add_or_remove(df, weights, draws=200).collect()}
    assert got["good"].verdict == "keep" and got["good"].clear and got["good"].d_sharpe > 0 and got["good"].p < 0.1
    assert got["bad"].verdict == "drop" and got["bad"].clear and got["bad"].p > 0.9
    assert got["same"].verdict in ("add", "leave out") and got["same"].p is None and got["same"].d_sharpe is None and got["same"].clear is None
    assert got["same"].verdict == ("add" if got["same"].sharpe > got["same"].hurdle else "leave out")
    sharpe = lambda x: x.mean() / x.std(ddof=1) * 252**0.5
    assert got["base"].sharpe == pytest.approx(sharpe(base)) and got["base"].with_sharpe == got["good"].with_sharpe
    heavy = spark.createDataFrame([("base", 0.02), ("good", 0.98)], "series_id string, weight double")
    trimmed = {r.series_id: r for r in po.add_or_remove(series(spark, base=good * 0.2 + 0.0005, good=good + rng.normal(0, 0.02, 400)), heavy, draws=50).collect()}
    assert trimmed["good"].verdict in ("trim", "drop") and (trimmed["good"].verdict == "trim") == trimmed["good"].passes


def test_scoreboard_keeps_every_strategy(spark):
    nav = spark.createDataFrame([("a", 30.0), ("b", 10.0)], "series_id string, nav double")
    none = lambda schema: spark.createDataFrame([], schema)
    live = series(spark, a=[0.01] * 10 + [0.02] * 15)
    held = spark.createDataFrame([("a", "x"), ("a", "y")], "series_id string, symbol string")
    got = {r.series_id: r for r in po.scoreboard(nav, none("series_id string, target double"), live, none("series_id string, metric string, percentile double, status string"), none("series_id string, shortfall double"), held, none("series_id string, passed int, evaluated int")).collect()}
    assert got["a"].weight == 0.75 and got["a"].open_positions == 2 and got["b"].open_positions == 0 and got["b"].live_return is None
    assert got["a"].live_return == pytest.approx(1.01**10 * 1.02**15 - 1)


def test_current_signals(spark):
    prices = spark.createDataFrame([("x", D0, 10.0), ("x", D0 + dt.timedelta(5), 12.0), ("x", D0 + dt.timedelta(9), 11.0), ("y", D0 + dt.timedelta(9), 5.0)], "symbol string, date date, close double")
    got = {(r.symbol, r.lookback): r for r in sg.current_signals(prices, {"short": 3, "long": 8}).collect()}
    assert (got["x", "short"].reference_date, got["x", "short"].signal) == (D0 + dt.timedelta(5), 0) and got["x", "short"].momentum == pytest.approx(11 / 12 - 1)
    assert (got["x", "long"].reference_date, got["x", "long"].signal) == (D0, 1)
    assert got["y", "long"].signal is None and got["y", "long"].reference_close is None


def test_orders_of_all_sleeves(spark):
    """A sleeve of weights and one of picks share an account; a sleeve without a weight plans nothing."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    targets = frame([("w", "A", 0.5), ("idle", "A", 1.0)], "sleeve string, symbol string, weight double")
    held = frame([("p", "C", 1.0), ("p", "D", 2.0)], "sleeve string, symbol string, qty double")
    prices = frame([("A", 10.0), ("B", 20.0), ("C", 30.0), ("D", 5.0)], "symbol string, price double")
    nav, weights = frame([("w", 150.0), ("p", 50.0)], "sleeve string, nav double"), frame([("w", 0.5), ("p", 0.5)], "sleeve string, weight double")
    model = frame([("p", "D", "", 7.0, None)], "sleeve string, symbol string, exit string, take_profit double, stop double")
    entries = frame([("p", 1, "B", 0.5)], "sleeve string, rank int, symbol string, weight double")
    got = {(r.sleeve, r.symbol, r.side, r.quantity, r.kind, r.limit) for r in orders.order_plans(targets, held, prices, nav, weights, 0.9, model=model, entries=entries).collect()}
    assert got == {("w", "A", "BUY", 4.0, "market", None), ("p", "C", "SELL", 1.0, "market on open", None), ("p", "D", "SELL", 2.0, "limit", 7.0), ("p", "B", "BUY", 2.0, "market on open", None)}
    alone = orders.order_plans(targets, held, prices, nav, weights, 0.9)
    assert {(r.sleeve, r.symbol, r.side) for r in alone.collect()} == {("w", "A", "BUY"), ("p", "C", "SELL"), ("p", "D", "SELL")}
