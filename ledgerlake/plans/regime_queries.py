"""Registered queries: regime forecasts under training schemes and settings, bands, breaks, allocation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import chi_square_tail
from ..operators import macro as mc
from ..operators import regimes as rg
from ..operators import signals as sg
from ..sources import testdata as v
from .metric_queries import phi_sql
from .registry import query, r, rounded
from .study_queries import FEATURES

#: The tables hold seven years, so histories, embargo and look-backs are shorter than those of half a century.
START, EVERY, EMBARGO, LEAST, HORIZON, LOOKBACK = "1998-06-01", 6, 6, 18, 3, 12
VARIANT = "variant string, lookback int, horizon int, window int, half_life int"
SCHEMES = [("expanding", None, None), ("rolling 30", 30, None), ("rolling 20", 20, None), ("decay 24", None, 24), ("decay 12", None, 12)]
TIERS = {"tiered": lambda c: sg.alloc_tiered(c, [(0.7, 1.0), (0.4, 0.5)]), "proportional": lambda c: sg.alloc_proportional(c), "constant": lambda c: sg.alloc_constant(0.5) + 0 * c}


def forecasts(spark, d, variants):
    sets = rg.training_sets(v.macro(spark, d), spark.createDataFrame(variants, VARIANT), START, EVERY, EMBARGO)
    return rg.walk_forward(sets, LEAST)


def market(spark, d):
    return v.bench(spark, d).withColumn("cash", F.lit(0.0001))


@query()
def macro_walk_forward(spark, d):
    """The forecasts of all inputs, refitted every six months on the labels known by then."""
    return rounded(forecasts(spark, d, [("expanding", LOOKBACK, HORIZON, None, None)]).drop("variant"), 5)


@query()
def train_scheme_comparison(spark, d):
    """Brier score and AUC before and after a day, and accounts, of forecasts trained on all months, a window of them, or with decay."""
    p = forecasts(spark, d, [(n, LOOKBACK, HORIZON, w, h) for n, w, h in SCHEMES])
    p = p.withColumn("span", F.when(F.col("month") < "2000-01-01", "design").otherwise("later"))
    scores = rg.judged(p, rg.outcomes(v.macro(spark, d), HORIZON), ["variant", "span"]).groupBy("variant").pivot("span", ["design", "later"]).agg(F.first("brier").alias("brier"), F.first("auc").alias("auc"))
    return rounded(scores.join(rg.traded(p, market(spark, d), TIERS), "variant"), 5)


@query()
def macro_sensitivity(spark, d):
    """The same rules under other look-backs and horizons, nothing fitted anew but the forecasts."""
    grid = [(f"{n}/{HORIZON}", n, HORIZON, None, None) for n in (6, 9, 12, 15, 18)] + [(f"{LOOKBACK}/{h}", LOOKBACK, h, None, None) for h in (2, 4)]
    p = forecasts(spark, d, grid)
    truth = None
    for h in (2, 3, 4):
        one = rg.judged(p.where(F.substring_index("variant", "/", -1) == str(h)), rg.outcomes(v.macro(spark, d), h), ["variant"])
        truth = one if truth is None else truth.union(one)
    return rounded(truth.join(rg.traded(p, market(spark, d), TIERS), "variant"), 5)


def last_set(spark, d):
    m = v.macro(spark, d)
    sets = rg.training_sets(m, spark.createDataFrame([("live", LOOKBACK, HORIZON, None, None)], VARIANT), START, EVERY, EMBARGO)
    last = sets.agg(F.max("asof").alias("asof"))
    return sets.join(F.broadcast(last), "asof"), rg.design(m, LOOKBACK)


@query()
def live_bootstrap_band(spark, d):
    sets, months = last_set(spark, d)
    return rounded(rg.live_band(sets, months, draws=300, block=12, path=LOOKBACK), 5)


@query()
def structural_break_lr(spark, d):
    return rounded(rg.structural_break(last_set(spark, d)[0], "1998-06-01", HORIZON), 4)


def _tail(x: str, k: int) -> str:
    from math import gamma

    first = f"2 * ({phi_sql(f'(-sqrt({x}))')})" if k % 2 else "0.0"
    return " + ".join([first, *(f"exp(-({x}) / 2) * pow(({x}) / 2, {i + k % 2 / 2}) / {gamma(i + k % 2 / 2 + 1)}" for i in range(k // 2))])


@query(f"SELECT DISTINCT l_linenumber AS k, {r(_tail('l_linenumber * 3.0', 11), 7)} AS odd, {r(_tail('l_linenumber * 3.0', 4), 7)} AS even FROM lineitem")
def chi_square_survival(spark, d):
    x = v.read(spark, d, "lineitem").select(F.col("l_linenumber").alias("k")).distinct()
    return rounded(x.select("k", chi_square_tail(F.col("k") * 3.0, 11).alias("odd"), chi_square_tail(F.col("k") * 3.0, 4).alias("even")), 7)


@query(f"""{FEATURES}, c AS (SELECT month, least(1, greatest(0, round(round_even(ur_pos / 0.1, 0) * 0.1, 4))) AS c FROM ft) SELECT month, {r('c')} AS confidence, {r('c / 2')} AS proportional, {r('CASE WHEN c >= 0.7 - 1e-9 THEN 1.0 WHEN c >= 0.4 - 1e-9 THEN 0.5 ELSE 0.0 END')} AS tiered, 0.6e0 AS constant FROM c""")
def allocation_rules(spark, d):
    """Weights of the three rules under a stepped figure between 0 and 1."""
    c = F.col("confidence")
    x = mc.macro_features(v.macro(spark, d)).select("month", sg.stepped(F.col("ur_pos")).alias("confidence"))
    return rounded(x.select("month", "confidence", sg.alloc_proportional(c, 2).alias("proportional"), sg.alloc_tiered(c, [(0.7, 1.0), (0.4, 0.5)]).alias("tiered"), sg.alloc_constant(0.6).alias("constant")))


@query(f"{FEATURES} SELECT CAST(month + INTERVAL 1 MONTH AS DATE) AS month, phase FROM ph")
def publication_lag(spark, d):
    """Phases in the month in which they are known."""
    return sg.shift_known(mc.classify_phase(mc.macro_features(v.macro(spark, d))).select("month", "phase"))
