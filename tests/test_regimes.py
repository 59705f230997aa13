"""Regime forecasts: constrained fits, training sets as of their month, schemes, bands and breaks against plain loops."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.stats import chi_square_tail
from ledgerlake.operators import macro as mc
from ledgerlake.operators import regimes as rg
from ledgerlake.operators.engines import signed_logit

VARIANT = "variant string, lookback int, horizon int, window int, half_life int"


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(150):
        ur = 5 + 1.5 * math.sin(i / 9) + rng.normal(0, 0.15)
        ff = max(0.0, 4 - 2 * math.sin(i / 9 + 0.5) + rng.normal(0, 0.2))
        rows.append((dt.date(1990 + i // 12, i % 12 + 1, 1), float(ur), float(ff), int(math.sin(i / 9) > 0.3 and math.cos(i / 9) > 0)))
    return spark.createDataFrame(rows, "month date, ur double, ff double, usrec int")


@pytest.fixture(scope="module")
def sets(spark, panel):
    variants = spark.createDataFrame([("all", 12, 3, None, None), ("window", 12, 3, 40, None), ("decay", 12, 3, None, 24)], VARIANT)
    return rg.training_sets(panel, variants, "1998-01-01", 12, 6).toPandas()


def kkt(x, y, signs, l2, s, w):
    """How far the slopes at ``w`` are from those of a minimum under the signs."""
    z = np.column_stack([np.ones(len(y)), x])
    p = 1 / (1 + np.exp(-z @ w))
    g = z.T @ (s / s.sum() * (p - y)) + np.concatenate([[0], l2 * w[1:]])
    free = np.concatenate([[0], signs])
    bad = np.where(free == 0, np.abs(g), np.where(np.abs(w) > 1e-12, np.abs(g), np.maximum(0, -g * free)))
    return bad.max(), (w * free >= 0).all()


def test_constrained_fits_are_minima():
    rng = np.random.default_rng(1)
    for k in range(20):
        x = rng.normal(size=(80, 4))
        y = (x @ rng.normal(size=4) + rng.normal(size=80) > 0).astype(float)
        s, signs = rng.uniform(0.2, 2, 80), rng.integers(-1, 2, 4)
        w = signed_logit(x, y, signs, 0.02, s)
        far, held = kkt(x, y, signs, 0.02, s, w)
        assert held and far < 1e-8


def test_training_sets_are_what_was_known(spark, panel, sets):
    asof = sorted(sets["asof"].unique())
    assert [str(a) for a in asof] == ["1998-01-01", "1999-01-01", "2000-01-01", "2001-01-01", "2002-01-01"]
    known = {r.month: r.y for r in mc.asof_labels(panel, "1999-01-01", 3, 6).collect()}
    designs = {r.month for r in rg.design(panel, 12).collect()}
    one = sets[sets["asof"] == dt.date(1999, 1, 1)]
    learnt = one[(one["variant"] == "all") & one["y"].notna()]
    assert dict(zip(learnt["month"], learnt["y"])) == {m: y for m, y in known.items() if m in designs} and (learnt["weight"] == 1).all()
    months = lambda d: d.year * 12 + d.month
    window = one[(one["variant"] == "window") & one["y"].notna()]
    assert set(window["month"]) == {m for m in learnt["month"] if months(dt.date(1999, 1, 1)) - months(m) < 40}
    decay = one[(one["variant"] == "decay") & one["y"].notna()]
    assert np.allclose(decay["weight"], [0.5 ** ((months(dt.date(1999, 1, 1)) - months(m)) / 24) for m in decay["month"]])
    assert len(one[one["y"].isna() & (one["variant"] == "all")]) == 12


def test_forecasts_and_scores_equal_a_loop(spark, panel, sets):
    df = spark.createDataFrame(sets)
    got = {(r.variant, r.month): r.p for r in rg.walk_forward(df, 40).collect()}
    want = {}
    for (variant, _), rows in sets.groupby(["variant", "asof"]):
        past, now = rows[rows["y"].notna()], rows[rows["y"].isna()]
        w = past["weight"].to_numpy() / past["weight"].mean()
        mu = np.average(past[rg.INPUTS], axis=0, weights=w)
        sd = np.sqrt(np.average((past[rg.INPUTS] - mu) ** 2, axis=0, weights=w))
        z = lambda x: np.clip((x[rg.INPUTS].to_numpy() - mu) / np.where(sd > 0, sd, 1), -3, 3)  # noqa: E731, B023
        if len(past) < 40 or past["y"].nunique() < 2:
            continue
        c = signed_logit(z(past), past["y"].to_numpy(), np.array(list(rg.SIGNS.values())), 1 / (0.5 * len(past)), w)
        want |= {(variant, m): p for m, p in zip(now["month"], 1 / (1 + np.exp(-(c[0] + z(now) @ c[1:]))))}
    assert got.keys() == want.keys() and len(got) > 100 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    truth = {r.month: r.y for r in rg.outcomes(panel, 3).collect() if r.y is not None}
    p = spark.createDataFrame([(v, m, float(x)) for (v, m), x in got.items()], "variant string, month date, p double")
    for r in rg.judged(p, rg.outcomes(panel, 3), ["variant"]).collect():
        pairs = [(x, truth[m]) for (v, m), x in got.items() if v == r.variant and m in truth]
        assert r.months == len(pairs) and r.brier == pytest.approx(np.mean([(x - y) ** 2 for x, y in pairs]))
        ups, downs = [x for x, y in pairs if y], [x for x, y in pairs if not y]
        assert r.auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in ups for b in downs]))


def test_bands_equal_a_loop(spark, panel, sets):
    past = sets[(sets["variant"] == "all") & (sets["asof"] == dt.date(2002, 1, 1)) & sets["y"].notna()].sort_values("month")
    months = rg.design(panel, 12)
    got = {r.month: r for r in rg.live_band(spark.createDataFrame(past), months, draws=30, block=24, path=6).collect()}
    now = months.orderBy(F.desc("month")).limit(6).toPandas().sort_values("month")
    w = past["weight"].to_numpy(float)
    draws = []
    for k in range(30):
        ix = rg.block_rows(past["y"].to_numpy(), 24, 42, k)
        assert len(set(past["y"].to_numpy()[ix])) == 2 and (np.diff(ix.reshape(-1)[:24]) == 1).all()
        draws.append(1 - rg.forecast(now, past.iloc[ix], w[ix], rg.fit(past.iloc[ix], w[ix])))
    point = 1 - rg.forecast(now, past, w, rg.fit(past, w))
    assert len({tuple(d) for d in draws}) > 25
    for i, m in enumerate(now["month"]):
        column = np.array(draws)[:, i]
        assert got[m].confidence == pytest.approx(point[i]) and got[m].low == pytest.approx(np.quantile(column, 0.05)) and got[m].high == pytest.approx(np.quantile(column, 0.95)) and got[m].draws == 30


def test_break_statistic_equals_a_loop(spark, sets):
    past = sets[(sets["variant"] == "all") & (sets["asof"] == dt.date(2002, 1, 1)) & sets["y"].notna()].sort_values("month")
    got = rg.structural_break(spark.createDataFrame(past), "1996-06-01", 3).first()

    def likelihood(rows):
        p = np.clip(rg.forecast(rows, past, np.ones(len(past)), rg.fit(rows, np.ones(len(rows)), past, 1e3)), 1e-9, 1 - 1e-9)
        y = rows["y"].to_numpy()
        return (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    late = past["month"] >= dt.date(1996, 6, 1)
    want = 2 * (likelihood(past[late]) + likelihood(past[~late]) - likelihood(past))
    assert got.statistic == pytest.approx(want) and got.statistic > 0 and got.freedom == 11 and got.adjusted == pytest.approx(want / 3) and 0 <= got.p <= got.adjusted_p <= 1
    one_sided = spark.createDataFrame(past.assign(y=np.where(late, past["y"], 0.0)))
    assert rg.structural_break(one_sided, "1996-06-01", 3).collect() == []


def test_chi_square_tail_at_known_quantiles(spark):
    known = {1: (3.841458821, 0.05), 2: (5.991464547, 0.05), 4: (9.487729037, 0.05), 11: (24.72497031, 0.01)}
    for k, (x, p) in known.items():
        assert spark.range(1).select(chi_square_tail(F.lit(x), k)).first()[0] == pytest.approx(p, abs=1e-6)
        assert spark.range(1).select(chi_square_tail(F.lit(0.0), k)).first()[0] == pytest.approx(1, abs=1e-6)


def test_rules_are_traded_from_the_day_after_the_month(spark):
    days = [dt.date(2020, 1, 30) + dt.timedelta(i) for i in range(40)]
    returns = spark.createDataFrame([(d, 0.01, 0.0) for d in days], "date date, ret double, cash double")
    p = spark.createDataFrame([("v", dt.date(2020, 1, 1), 0.0), ("v", dt.date(2020, 2, 1), 1.0)], "variant string, month date, p double")
    got = rg.traded(p, returns, {"all": lambda c: c}, bps=0.0).collect()
    # filled on the first of February, invested from the second on, out after the first of March
    assert len(got) == 1 and got[0].days == len([d for d in days if d > dt.date(2020, 2, 1)])
    assert (1 + got[0].cagr) ** (got[0].days / 252) == pytest.approx(1.01 ** len([d for d in days if dt.date(2020, 2, 1) < d <= dt.date(2020, 3, 1)]))
