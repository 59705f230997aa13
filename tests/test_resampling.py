"""Solvers from sums over days, resampled weights, cross-validation summaries, regressions with lagged errors, metric sets."""

import datetime as dt

import numpy as np
import pytest

from ledgerlake.operators import allocation as al
from ledgerlake.operators import engines as en
from ledgerlake.operators import metrics as m
from ledgerlake.operators import significance as si
from ledgerlake.operators import simulation as sim


def table(spark, r, names="abc", first=dt.date(2015, 1, 1)):
    return spark.createDataFrame([(names[j], first + dt.timedelta(i), float(x)) for i, row in enumerate(r) for j, x in enumerate(row)], "series_id string, date date, ret double")


@pytest.fixture(scope="module")
def days():
    rng = np.random.default_rng(8)
    common = rng.normal(0, 0.006, 300)
    return np.column_stack([0.0006 + common + rng.normal(0, s, 300) for s in (0.004, 0.008, 0.012)])


def test_covariances_from_sums_are_those_of_the_days(days):
    for part in (days, days[:25] * 50 + 3):
        z = (part * part).sum(1)
        sums = (np.array([float(len(part))]), part.sum(0)[None], (part.T @ part)[None], (part * z[:, None]).sum(0)[None], np.array([(z * z).sum()]))
        mean, cov = al.shrunk_sums(*sums)
        assert np.allclose(mean[0], part.mean(0) * 252) and np.allclose(cov[0], al.shrunk(part), rtol=1e-6)


def test_methods_from_sums_equal_methods_on_days(spark, days):
    df = table(spark, days)
    both = df.selectExpr("*", "'all' as grp").union(df.where("series_id < 'c'").selectExpr("*", "'two' as grp"))
    gap = both.where("not (series_id = 'b' and date = '2015-01-05')")  # that day is not common
    methods = [k for k in al.METHODS if k != "resampled"]
    got = {(r.grp, r.method, r.series_id): r.weight for r in al.optimise(gap, methods, cap=0.7, extra={"target": {"a": 2.0, "b": 1.0, "c": 1.0}, "budget": {"a": 0.5, "b": 0.3, "c": 0.2}}).collect()}
    keep = np.delete(days, 4, axis=0)
    for grp, n in (("all", 3), ("two", 2)):
        own = {"target": np.array([2.0, 1.0, 1.0][:n]), "budget": np.array([0.5, 0.3, 0.2][:n])}
        for k in methods:
            want = al.weights_of(k, keep[:, :n], 0.0, 0.7, 0.0, own)
            assert np.allclose([got[grp, k, s] for s in "abc"[:n]], want, atol=1e-6), (grp, k)


def test_two_assets_have_closed_forms(spark, days):
    df = table(spark, days[:, :2], "ab").selectExpr("*", "1 as grp")
    got = {(r.method, r.series_id): r.weight for r in al.optimise(df, ["min_variance", "risk_parity", "max_diversification"]).collect()}
    c = al.shrunk(days[:, :2])
    lowest = min(1.0, max(0.0, (c[1, 1] - c[0, 1]) / (c[0, 0] + c[1, 1] - 2 * c[0, 1])))
    parity = c[1, 1] ** 0.5 / (c[0, 0] ** 0.5 + c[1, 1] ** 0.5)
    assert got["min_variance", "a"] == pytest.approx(lowest, abs=1e-7) and got["risk_parity", "a"] == pytest.approx(parity, abs=1e-7) and got["max_diversification", "a"] == pytest.approx(parity, abs=1e-5)


def test_weights_over_resamples_equal_a_loop(spark, days):
    df = table(spark, days)
    got = {(r.method, r.series_id): r for r in al.weight_uncertainty(df, ["min_variance", "max_sharpe"], draws=40, cap=0.8).collect()}
    drawn = {}
    for r in sim.day_indices(spark, 300, 300, 40, 63, 11).collect():
        drawn.setdefault(r.path, []).append(r.i)
    assert len(drawn) == 40 and all(len(x) == 300 for x in drawn.values())
    for k in ("min_variance", "max_sharpe"):
        w = np.array([al.weights_of(k, days[x], 0.0, 0.8) for x in drawn.values()])
        for j, s in enumerate("abc"):
            assert got[k, s].weight == pytest.approx(w[:, j].mean(), abs=1e-5) and got[k, s].p05 == pytest.approx(np.quantile(w[:, j], 0.05), abs=1e-4)
    one = al.weights_of("resampled", days, 0.0, 0.8, 0.0, {"resamples": 20})
    assert one.sum() == pytest.approx(1) and (one <= 0.8 + 1e-9).all() and not np.allclose(one, al.weights_of("max_sharpe", days, 0.0, 0.8))


def test_the_resampled_method_can_be_recommended(spark):
    rows = spark.createDataFrame([("equal", 0.8), ("max_sharpe", 1.0), ("resampled", 0.97), ("hrp", None)], "method string, wf_sharpe double")
    assert al.recommend(rows).first().method == "resampled" and al.recommend(rows, 0.01).first().method == "max_sharpe"


def test_histories_of_cross_validation(spark, days):
    got = en.cpcv(table(spark, days), ["equal", "min_variance", "target"], folds=6, tests=2, extra={"target": {"a": 1.0}})
    rows = got.collect()
    assert len(rows) == 15 and {r.history for r in rows} == set(range(5))
    equal = days.mean(1)
    edges = np.linspace(0, 300, 7).astype(int)
    whole = np.concatenate([equal[a:b] for a, b in zip(edges[:-1], edges[1:])])
    assert all(r.sharpe == pytest.approx(whole.mean() / whole.std(ddof=1) * 252**0.5) for r in rows if r.method == "equal")
    one = {r.method: r for r in en.cpcv_summary(got).collect()}
    assert one["target"].beats == 0 and one["equal"].histories == 5
    alone = days[:, 0]
    assert one["equal"].beats == float(whole.mean() / whole.std() > alone.mean() / alone.std())


def test_regression_errors_equal_matrices(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 2))
    e = np.convolve(rng.normal(0, 1, 203), [1, 0.5, 0.3, 0.2], "valid")
    y = 0.3 + x @ [1.5, -0.4] + e
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(i), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(200)] + [("s", dt.date(2021, 1, 1), 1.0, None, 2.0)]
    rows += [("flat", dt.date(2020, 1, 1) + dt.timedelta(i), 1.0, 2.0, 3.0) for i in range(50)]
    got = {r.term: r for r in si.ols_hac(spark.createDataFrame(rows, "series_id string, date date, y double, p double, q double"), "y", ["p", "q"], 5).collect()}
    z = np.column_stack([np.ones(200), x])
    w = np.linalg.solve(z.T @ z, z.T @ y)
    s = z * (y - z @ w)[:, None]
    mid = s.T @ s
    for k in range(1, 6):
        g = s[k:].T @ s[:-k]
        mid += (1 - k / 6) * (g + g.T)
    inv = np.linalg.inv(z.T @ z)
    error = np.sqrt(np.diag(inv @ mid @ inv))
    assert set(got) == {"alpha", "p", "q"}  # regressors that do not vary give no row
    for i, term in enumerate(("alpha", "p", "q")):
        assert got[term].coefficient == pytest.approx(w[i]) and got[term].error == pytest.approx(error[i]) and got[term].t == pytest.approx(w[i] / error[i])


def test_metric_sets_by_hand(spark):
    r = [0.10, -0.10, -0.05, 0.20, 0.01, -0.02]
    df = spark.createDataFrame([("s", dt.date(2020, 1, 29) + dt.timedelta(i), x) for i, x in enumerate(r)], "series_id string, date date, ret double")
    bench = spark.createDataFrame([(dt.date(2020, 1, 29) + dt.timedelta(i), 0.01 * (i % 3)) for i in range(5)], "date date, ret double")
    s = m.stock_stats(df, bench).first()
    w = np.cumprod(1 + np.array(r))
    assert s.total_return == pytest.approx(w[-1] - 1) and s.max_drawdown == pytest.approx(0.9 * 0.95 - 1) and s.longest_days == 2
    assert s.best_month == pytest.approx(0.9 * 1.1 * 0.95 - 1 if 0.9 * 1.1 * 0.95 > 1.2 * 1.01 * 0.98 else 1.2 * 1.01 * 0.98 - 1) and s.positive_months == 0.5
    g = m.regime_stats(df.selectExpr("*", "0.0 as rf", "0.5 as exposure", "0.1 as turnover"), bench).first()
    assert g.max_drawdown == pytest.approx(s.max_drawdown) and g.longest_years == pytest.approx(2 / 252) and g.exposure == 0.5 and g.turnover == pytest.approx(0.1 * 252)
    assert g.beta is not None and g.worst_month == s.worst_month
    assert m.drawdown_episodes(df, -0.01).first().episodes == 2 and m.drawdown_episodes(df, -0.12).first().days == 1
