"""Registered queries: the stock-picking accounts, what they would do next, and how they depend on their rules."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import significance as sf
from ..operators import stockloop as sl
from ..operators import studies as st
from ..operators.timeseries import by, last_rows
from ..sources import testdata as v
from .registry import query, rounded

FAST, SLOW, VOL, START = (10, 20, 30), 60, 20, "1996-01-01"
#: 180 configurations: fast average, holdings of a sector, least score, slots and sizing.
CONFIGS = [
    {"config": f"f{FAST[f]} s{cap} q{q} n{n} {'inv' if inv else 'eq'}", "fast": f, "per_sector": cap, "least_score": q, "slots": n, "inverse": inv}
    for f, cap, q, n, inv in product(range(3), (0, 1, 2), (6, 7), (4, 6, 8, 10, 12), (False, True))
]
ONE = [c for c in CONFIGS if c["config"] == "f20 s2 q6 n6 eq"]
RULES = sl.Rules(exit_score=6.0, stop=0.15, max_days=250, market="hold")


def known(df):
    """``df`` made once, as a local table, for figures of days that many plans read."""
    return df.sparkSession.createDataFrame(df.toArrow()).select(*(F.col(c).cast(t).alias(c) for c, t in df.dtypes))


def panel(spark, d):
    """Closes and the benchmark are made once: brands by days, and days, whatever the journals hold. A brand is a stock, its maker the sector; opens are the closes before; scores change each quarter."""
    w = by("symbol")
    mean = lambda n: F.when(F.count("close").over(last_rows(w, n)) >= int(0.95 * n), F.avg("close").over(last_rows(w, n)))
    x = known(v.prices(spark, d)).withColumn("open", F.lag("close").over(w))
    x = x.withColumn("slow", mean(SLOW)).withColumn("_move", F.col("close") / F.col("open") - 1)
    x = x.withColumn("fast", F.array(*(F.coalesce((F.col("close") > mean(n)).cast("int"), F.lit(0)) for n in FAST)))
    x = x.withColumn("vol", F.when(F.count("_move").over(last_rows(w, VOL)) >= int(0.8 * VOL), F.stddev_samp("_move").over(last_rows(w, VOL))))
    brand, quarter = F.substring("symbol", 7, 2).cast("int"), F.year("date") * 4 + F.quarter("date")
    score = lambda q: (4 + (brand * 7 + q * 5 + brand * q) % 6).cast("double")
    x = x.withColumns({"score": score(quarter), "before": score(quarter - 1), "size": F.col("close") * (1000 + brand), "sector": F.substring("symbol", 7, 1), "adjust": F.lit(1.0)})
    ok = F.coalesce((F.col("close") < F.col("slow")) & (F.col("size") > 0), F.lit(False))
    bench = known(v.bench(spark, d)).withColumn("level", F.product(1 + F.col("ret")).over(Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    bench = bench.select("date", (F.col("level") >= F.avg("level").over(last_rows(Window.partitionBy(F.lit(0)).orderBy("date"), SLOW))).alias("market"))
    ref = x.groupBy("date").agg(F.median("vol").alias("reference"))
    y = x.withColumn("ok", ok).join(ref, "date").join(bench, "date", "left").withColumn("market", F.coalesce("market", F.lit(True)))
    high, low = F.greatest("close", "open") * 1.01, F.least("close", "open") * 0.99
    return y.where("open is not null").select("symbol", "date", "sector", "open", high.alias("high"), low.alias("low"), "close", "adjust", *sl.KNOWN, "ok", "fast", "reference", "market")


@query()
def stock_event_loop(spark, d):
    """The daily accounts of 180 configurations."""
    return rounded(sl.days_of(sl.run_accounts(panel(spark, d), CONFIGS, RULES, START)), 2)


@query()
def stock_trades(spark, d):
    return rounded(sl.trades_of(sl.run_accounts(panel(spark, d), ONE, RULES, START)), 4)


@query()
def next_open_plan(spark, d):
    """What each of 180 accounts would sell and buy at the next open."""
    return rounded(sl.plan_of(sl.run_accounts(panel(spark, d), CONFIGS, RULES, START)), 2)


@query()
def exit_reason_stats(spark, d):
    t = sl.trades_of(sl.run_accounts(panel(spark, d), CONFIGS, RULES, START))
    return rounded(st.exit_reason_stats(t.select("reason", "ret", "days")), 5)


@query()
def risk_summary(spark, d):
    return rounded(sl.risk_summary(sl.run_accounts(panel(spark, d), CONFIGS, RULES, START), -0.05), 5)


VARIANTS = {
    "current": {}, "no market filter": {"market": None}, "market filter sells": {"market": "sell"}, "no time limit": {"max_days": None}, "no stop": {"stop": None},
}


@query()
def ablation(spark, d):
    """The whole walk-forward with one rule changed at a time."""
    rules = {k: sl.Rules(**{**RULES.__dict__, **change}) for k, change in VARIANTS.items()}
    few = [c for c in CONFIGS if c["slots"] in (4, 8) and not c["inverse"]]
    return rounded(sl.risk_summary(sl.walk_forward_variants(panel(spark, d), few, rules, START), -0.05), 5)


@query()
def stop_sensitivity(spark, d):
    rules = {"no stop" if x is None else f"{x:.0%}": sl.Rules(**{**RULES.__dict__, "stop": x}) for x in (None, 0.05, 0.10, 0.15, 0.20, 0.25)}
    return rounded(sl.risk_summary(sl.run_accounts(panel(spark, d), ONE, rules, START), -0.05), 5)


CUTS = ["1998-06-30", "2000-03-31"]


@query(f"""{v.with_views('prices')}, dy AS (SELECT DISTINCT date FROM (SELECT date, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS o FROM prices) WHERE o IS NOT NULL AND date >= DATE '{START}'), e AS (SELECT unnest(['account', 'leaking']) AS engine), c AS (SELECT unnest({CUTS}) AS cut), t AS (SELECT unnest(['short', 'shaken']) AS test)
 SELECT engine, cut, test, count(*) AS days, engine = 'leaking' AS leaks FROM e, c, t, dy WHERE date <= CAST(cut AS DATE) GROUP BY 1, 2, 3""")
def engine_causality(spark, d):
    """An account up to two cuts, without what comes after and with garbage in its place; and one that is marked to closes of five days later."""
    honest = lambda x: sl.days_of(sl.run_accounts(x, ONE, sl.Rules(exit_score=6.0, stop=None, target=False), START))
    later = lambda x: x.withColumn("_l", F.lead("close", 5).over(by("symbol"))).groupBy("date").agg(F.coalesce(F.avg(F.col("_l") / F.col("close")), F.lit(1.0)).alias("_r"))
    ahead = lambda x: honest(x).join(later(x), "date").withColumn("equity", F.col("equity") * F.col("_r"))
    out, data = None, panel(spark, d)
    for name, engine in (("account", honest), ("leaking", ahead)):
        found = sf.engine_causality(engine, data, CUTS, ["config"], ["equity", "invested", "positions"], ["open", "high", "low", "close", "slow"])
        found = found.select(F.lit(name).alias("engine"), "cut", "test", F.col("rows").alias("days"), (F.col("differing") > 0).alias("leaks"))
        out = found if out is None else out.union(found)
    return out


SCREEN = f"""{v.with_views('prices')}, a AS (SELECT *, lag(close) OVER w AS o, CASE WHEN count(close) OVER w60 >= 57 THEN avg(close) OVER w60 END AS slow, CASE WHEN count(close) OVER w20 >= 19 THEN avg(close) OVER w20 END AS quick, CAST(substr(symbol, 7, 2) AS INTEGER) AS b, year(date) * 4 + quarter(date) AS q FROM prices
 WINDOW w AS (PARTITION BY symbol ORDER BY date), w60 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 n AS (SELECT *, close * (1000 + b) AS size, CAST(4 + (b * 7 + q * 5 + b * q) % 6 AS DOUBLE) AS score FROM a WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""


@query(f"""{SCREEN} SELECT symbol, substr(symbol, 7, 1) AS sector, date, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in ('size', 'score', 'close', 'slow'))}, round(slow / close - 1, 5) + 0.0 AS upside FROM n, (SELECT max(date) AS fin FROM n) WHERE close < slow AND close > quick AND score >= 6 AND date >= fin - 30""")
def live_screen(spark, d):
    """What one configuration could buy now: each stock's last row, if under a month old, with the way to its target."""
    x = panel(spark, d)
    last = x.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("_k = 1")
    end = last.agg(F.max("date").alias("_end"))
    c = ONE[0]
    now = last.join(F.broadcast(end)).where(F.col("ok") & (F.col("fast")[c["fast"]] == 1) & (F.col("score") >= c["least_score"]) & (F.col("date") >= F.date_sub("_end", 30)))  # one row
    return rounded(now.select("symbol", "sector", "date", "size", "score", "close", "slow", (F.col("slow") / F.col("close") - 1).alias("upside")), 5)
