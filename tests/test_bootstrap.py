"""Block bootstraps: independent starts over a series' own days, figures of paths against NumPy, cones and rates."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import allocation as al
from ledgerlake.operators import expectations as ex
from ledgerlake.operators import simulation as sim


def series(spark, values, name="s", first="2001-01-01"):
    day = dt.date.fromisoformat(first)
    return spark.createDataFrame([(name, day + dt.timedelta(i), float(v)) for i, v in enumerate(values)], "series_id string, date date, ret double")


def offsets(spark, n=500, horizon=252, paths=400, block=63, seed=7):
    x = sim.draw_paths(sim.histories(series(spark, range(n))), horizon, paths, block, seed)
    return np.array([r.x for r in x.orderBy("path").collect()]).astype(int)


def test_paths_are_circular_blocks_of_the_whole_history(spark):
    x = offsets(spark)
    assert x.shape == (400, 252)
    inside = np.diff(x, axis=1) % 500
    assert (inside[:, [i for i in range(251) if (i + 1) % 63]] == 1).all()
    starts = x[:, ::63]
    assert len({tuple((s - s[0]) % 500) for s in starts}) > 390  # the blocks of a path lie apart in its own way
    assert set(range(500)) - set(x.ravel().tolist()) == set()
    counts = np.histogram(starts, bins=10, range=(0, 500))[0]
    assert abs(counts / counts.mean() - 1).max() < 0.25
    assert not np.array_equal(x, offsets(spark, seed=8))


def test_short_histories_and_horizons(spark):
    both = series(spark, range(30), "long").union(series(spark, range(10), "short"))
    got = sim.draw_paths(sim.histories(both), 5, 3, 63).collect()
    assert {r.series_id for r in got} == {"long"} and all(len(r.x) == 5 for r in got)
    assert sim.draw_paths(sim.histories(both), 0, 3, 63).count() == 0


def test_figures_of_paths_equal_numpy(spark):
    rng = np.random.default_rng(2)
    r, rates = rng.normal(0.0004, 0.01, 700), rng.uniform(0, 0.0002, 120)
    hist = sim.histories(series(spark, r)).withColumn("rates", F.array(*map(F.lit, rates.tolist())))
    paths = sim.draw_paths(hist, 120, 200, 63)
    drawn = {p.path: np.array(p.x) for p in paths.collect()}
    for row in sim.path_stats(paths, F.col("rates"), 0.002).collect():
        e = drawn[row.path]
        y = e + rates
        w = np.cumprod(1 + y)
        dd = w / np.maximum(np.maximum.accumulate(w), 1) - 1
        want = (w[-1] - 1, y.std(ddof=1) * 252**0.5, e.mean() / max(e.std(ddof=1), 0.002) * 252**0.5, min(dd.min(), 0), dd[-1], (y > 0).mean())
        assert np.allclose([row.total, row.volatility, row.sharpe, row.max_drawdown, row.last_drawdown, row.positive], want, atol=1e-9)


def test_quantiles_are_those_of_a_numpy_bootstrap(spark):
    """The 5 % quantile of the total is within the Monte Carlo error of independent starts, which a lattice of starts is not."""
    rng = np.random.default_rng(4)
    r = np.repeat(rng.normal(0, 0.004, 60), 10) + rng.normal(0.0003, 0.003, 600)
    stats = sim.path_stats(sim.draw_paths(sim.histories(series(spark, r)), 252, 2000, 63)).agg(F.percentile("total", F.lit(0.05)), F.stddev("total")).first()
    low, spread = [], []
    for _ in range(20):
        start = rng.integers(0, 600, (2000, 4))
        x = r[((start[:, :, None] + np.arange(63)) % 600).reshape(2000, -1)]
        total = np.prod(1 + x, axis=1) - 1
        low.append(np.quantile(total, 0.05))
        spread.append(total.std(ddof=1))
    assert abs(stats[0] - np.mean(low)) < 5 * np.std(low) and abs(stats[1] - np.mean(spread)) < 5 * np.std(spread)


def test_cones_add_the_rates_of_their_dates(spark):
    flat = series(spark, [0.001] * 40)
    rf = series(spark, [0.0004] * 39 + [0.0006], "x").select("date", F.col("ret").alias("rf"))
    last = spark.createDataFrame([("s", dt.date(2001, 2, 9), 2.0)], "series_id string, last date, start double")  # a Friday, the last day
    got = ex.forward_cone(flat, last, 7, 5, 63, rf).orderBy("date").collect()
    assert [r.date.isoformat() for r in got] == ["2001-02-12", "2001-02-13", "2001-02-14", "2001-02-15", "2001-02-16", "2001-02-19", "2001-02-20"]
    # excess of 0.0006 on all days but the last, 0.0004 there, and the last rate of 0.0006 added
    assert all(2 * 1.001 ** (i + 1) - 1e-9 <= r.p95 <= 2 * 1.0012 ** (i + 1) + 1e-9 and r.p05 <= r.p50 <= r.p95 for i, r in enumerate(got))
    risk = ex.outlook(flat, 20, 50, 63, rf).first()
    assert risk.p_loss == 0 and risk.dd01 == 0 and risk.p05 <= risk.median


def test_paired_sharpe_test_guards(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, 100)
    pairs = lambda a, b: spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))], "i long, x double, y double")
    ix = sim.day_indices(spark, 100, 100, 200, 20)
    same = al.sharpe_difference(pairs(x, x), ix).first()
    assert (same.days, same.difference, same.low, same.high, same.p) == (100, 0.0, 0.0, 0.0, None)
    assert al.sharpe_difference(pairs(x[:50], x[:50]), sim.day_indices(spark, 50, 50, 20, 20)).count() == 0
    better = al.sharpe_difference(pairs(x + 0.005, x), ix).first()
    assert better.low > 0 and better.p < 0.02 and better.difference == pytest.approx(0.005 / x.std(ddof=1) * 252**0.5)
