"""The book as a whole: target weights, the expected portfolio, adding or removing a strategy, volatility targeting, a scoreboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import YEAR, safe_corr
from .metrics import stats_row
from .simulation import day_indices
from .timeseries import by, inner_align, running


def target_weights(settings: DataFrame) -> DataFrame:
    """(sleeve, target, budget) of active sleeves: target weights and risk budgets as shares of their sums. Targets that sum to nothing stay as
    they are; a sleeve without a budget has none. ``settings``: (sleeve, target_weight, risk_budget, active), a row a sleeve."""
    every = Window.partitionBy(F.lit(0))  # one row a sleeve
    live = settings.where(F.coalesce("active", F.lit(True)))
    weight, budget = F.coalesce("target_weight", F.lit(0.0)), F.when(F.col("risk_budget") > 0, F.col("risk_budget"))
    total = F.sum(weight).over(every)
    return live.select("sleeve", F.when(total > 0, weight / total).otherwise(weight).alias("target"), (budget / F.sum(budget).over(every)).alias("budget"))


def drift_portfolios(returns: DataFrame, weights: DataFrame, period: str = "month") -> DataFrame:
    """(config, date, ret) of portfolios (config, series_id, weight) whose weights are set at each period's start and drift inside."""
    x = returns.join(weights, "series_id").withColumn("_p", F.date_trunc(period, "date"))
    w = by("config", "series_id", "_p")
    held = x.withColumn("_h", F.col("weight") * F.product(1 + F.col("ret")).over(running(w)))
    held = held.withColumn("_b", F.coalesce(F.lag("_h").over(w), F.col("weight")))
    return held.groupBy("config", "date").agg((F.sum("_h") / F.sum("_b") - 1).alias("ret"))


def expected_portfolio(expected: DataFrame, targets: DataFrame, period: str = "month", least: int = 60) -> DataFrame:
    """(date, ret): the mix of the strategies' expectations at their target weights, on the days that all of them have. Strategies without a
    target or an expectation do not count; under ``least`` common days there is none. ``targets``: (series_id, target)."""
    mine = targets.where("target > 0").join(expected.select("series_id").distinct(), "series_id")
    share = mine.select("series_id", (F.col("target") / F.sum("target").over(Window.partitionBy(F.lit(0)))).alias("weight"), F.lit("all").alias("config"))  # one row a strategy
    n = mine.agg(F.count("*").alias("n"))
    x = expected.join(mine.select("series_id"), "series_id")
    full = x.groupBy("date").agg(F.count_distinct("series_id").alias("_k")).join(F.broadcast(n)).where("_k = n").select("date")  # one row
    mix = drift_portfolios(x.join(full, "date"), share, period).select("date", "ret")
    enough = mix.agg(F.count("*").alias("_n"))
    return mix.join(F.broadcast(enough)).where(F.col("_n") >= least).drop("_n")  # one row


def invest_fraction(returns: DataFrame, target: float | None, cap: float = 1.0, half_life: float = 63.0) -> DataFrame:
    """(series_id, volatility, fraction): the share of each book to invest for a yearly volatility of ``target``, at most ``cap``: by the
    exponentially weighted size of its returns so far. Without a target all of it."""
    w = Window.partitionBy("series_id").orderBy(F.desc("date"))
    x = returns.where("ret is not null").withColumn("_w", F.pow(F.lit(0.5), (F.row_number().over(w) - 1) / half_life))
    out = x.groupBy("series_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("ret") * F.col("ret")) / F.sum("_w") * YEAR).alias("volatility"))
    share = F.lit(1.0) if not target else F.when(F.col("volatility") > 0, F.least(F.lit(float(cap)), target / F.col("volatility"))).otherwise(1.0)
    return out.withColumn("fraction", share)


def add_or_remove(returns: DataFrame, weights: DataFrame, period: str = "month", draws: int = 1000, block: int = 63, seed: int = 3) -> DataFrame:
    """What each strategy (series_id, weight) does to the portfolio of all: figures alone, against the rest and of the portfolio with and without it.

    The rest keep their proportions. ``hurdle`` is the correlation to the rest times the rest's Sharpe ratio; a strategy over it would
    raise the ratio if held a little. ``p``: the share of paired block resamples in which the portfolio is no better with it. Verdicts of
    held strategies: keep (the portfolio is better with it), trim (it is not, but a little of it would help) and drop; of others: add
    or leave out. ``clear``: whether p is under a tenth, or over nine tenths for drop. Returns are in excess of cash.
    """
    x = inner_align(returns, weights.count())
    every = Window.partitionBy(F.lit(0))  # one row a strategy
    names = weights.withColumn("_all", F.sum("weight").over(every))
    whole = names.select(F.lit("").alias("config"), "series_id", (F.col("weight") / F.col("_all")).alias("weight"))
    others = names.alias("k").join(names.alias("o"), F.col("k.series_id") != F.col("o.series_id"))  # pairs of a few strategies
    left = F.sum("o.weight").over(Window.partitionBy("k.series_id"))
    rest = others.select(F.col("k.series_id").alias("config"), F.col("o.series_id").alias("series_id"), F.when(left > 0, F.col("o.weight") / left).otherwise(1 / F.count("*").over(Window.partitionBy("k.series_id"))).alias("weight"))
    books = drift_portfolios(x, whole.union(rest), period)
    total, without = books.where("config = ''").select("date", F.col("ret").alias("x")), books.where("config <> ''").select(F.col("config").alias("series_id"), "date", F.col("ret").alias("y"))
    figures = lambda df, p: stats_row(df).select("series_id", *(F.col(c).alias(f"{p}{c}") for c in ("sharpe", "cagr", "max_drawdown")))
    alone, apart = figures(x, ""), figures(without.withColumnRenamed("y", "ret"), "without_")
    with_ = figures(total.select(F.lit("").alias("series_id"), "date", F.col("x").alias("ret")), "with_").drop("series_id")
    rho = x.join(without, ["series_id", "date"]).groupBy("series_id").agg(safe_corr("ret", "y").alias("correlation"))
    pairs = without.join(total, "date").withColumn("i", F.row_number().over(by("series_id")) - 1)
    n = total.count()
    sr = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0))
    drawn = day_indices(returns.sparkSession, n, n, draws, block, seed).join(pairs, "i").groupBy("series_id", "path").agg((sr("x") - sr("y")).alias("d"))
    p = drawn.groupBy("series_id").agg(F.avg((F.col("d") < 0).cast("double") + 0.5 * (F.col("d") == 0).cast("double")).alias("p"))
    out = names.select("series_id", (F.col("weight") / F.col("_all")).alias("weight")).join(alone, "series_id").join(apart, "series_id").join(rho, "series_id").join(p, "series_id").join(F.broadcast(with_))  # one row
    held = F.col("weight") > 1e-6
    only = lambda c: F.when(held, c)
    out = out.withColumns({
        "hurdle": F.col("correlation") * F.col("without_sharpe"), "d_sharpe": only(F.col("with_sharpe") - F.col("without_sharpe")), "d_cagr": only(F.col("with_cagr") - F.col("without_cagr")), "d_max_drawdown": only(F.col("with_max_drawdown") - F.col("without_max_drawdown")), "p": only(F.col("p")),
    })
    over = F.coalesce(F.col("sharpe") > F.col("hurdle"), F.lit(False))
    verdict = F.when(~held & over, "add").when(~held, "leave out").when(F.col("d_sharpe") > 0, "keep").when(over, "trim").otherwise("drop")
    out = out.withColumn("passes", over).withColumn("verdict", verdict)
    clear = F.when(F.col("verdict") == "keep", F.col("p") < 0.1).when(F.col("verdict") == "drop", F.col("p") > 0.9)
    return out.select("series_id", "weight", "sharpe", "cagr", "max_drawdown", "correlation", "hurdle", "passes", "without_sharpe", "with_sharpe", "d_sharpe", "d_cagr", "d_max_drawdown", "p", "verdict", clear.alias("clear"))


def scoreboard(nav: DataFrame, targets: DataFrame, live: DataFrame, compared: DataFrame, tracked: DataFrame, open_positions: DataFrame, tests: DataFrame) -> DataFrame:
    """One row a strategy: its NAV, weight and target, live return, volatility, Sharpe ratio and drawdown, open positions, where its return lies
    among the expected ones, how it went against its model, and its last tests.

    ``nav``: (series_id, nav); ``targets``: (series_id, target); ``live``: (series_id, date, ret); ``compared``: rows of ``expectations.compare``;
    ``tracked``: (series_id, shortfall); ``open_positions``: (series_id, symbol); ``tests``: (series_id, passed, evaluated).
    """
    rank = compared.where("metric = 'total'").select("series_id", "percentile", "status")
    n = open_positions.groupBy("series_id").agg(F.count("*").alias("open_positions"))
    total = live.groupBy("series_id").agg((F.product(1 + F.col("ret")) - 1).alias("live_return"))
    x = nav.withColumn("weight", F.col("nav") / F.sum("nav").over(Window.partitionBy(F.lit(0))))  # one row a strategy
    for part in (targets, total, stats_row(live).select("series_id", "volatility", "sharpe", "max_drawdown"), n, rank, tracked.select("series_id", "shortfall"), tests.select("series_id", "passed", "evaluated")):
        x = x.join(part, "series_id", "left")
    return x.withColumn("open_positions", F.coalesce("open_positions", F.lit(0)))
