"""Studies of strategies: by decade, by exit, by sector, costs and lags, bootstraps of Sharpe differences, parameter grids and audits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import YEAR, safe_corr
from .metrics import cagr_of, drawdown, sharpe_of
from .simulation import uniform
from .timeseries import by


def decade(date: str = "date") -> Column:
    return (F.floor(F.year(date) / 10) * 10).cast("int")


def by_decade(returns: DataFrame, least: int = 200) -> DataFrame:
    """(series_id, decade, days, sharpe, cagr, max_drawdown) of decades with ``least`` days; the drawdown starts anew in each."""
    x = drawdown(returns.withColumn("decade", decade()).withColumn("series_id", F.concat_ws("|", "series_id", "decade")))
    out = x.groupBy("series_id", "decade").agg(F.count("*").alias("days"), sharpe_of(F.col("ret")).alias("sharpe"), cagr_of(F.col("ret")).alias("cagr"), F.min("drawdown").alias("max_drawdown"))
    return out.where(F.col("days") >= least).withColumn("series_id", F.substring_index("series_id", "|", 1))


def autocorr_by_decade(returns: DataFrame, least: int = 20) -> DataFrame:
    """(series_id, decade, daily, weekly): correlation of a return with the one before it, by days and by weeks that end on Friday."""
    def one(x: DataFrame, order: str, name: str) -> DataFrame:
        lagged = x.withColumn("p", F.lag("ret").over(by("series_id", order=order))).withColumn("decade", decade(order))
        return lagged.where("p is not null").groupBy("series_id", "decade").agg(safe_corr("ret", "p").alias(name), F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")

    week = F.date_sub("date", (F.dayofweek("date") + 7 - 7) % 7)
    weekly = returns.groupBy("series_id", week.alias("week")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))
    return one(returns, "date", "daily").join(one(weekly, "week", "weekly"), ["series_id", "decade"], "full_outer")


def exit_reason_stats(trips: DataFrame) -> DataFrame:
    """(reason, trades, win_rate, avg_return, avg_days)."""
    return trips.groupBy("reason").agg(F.count("*").alias("trades"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("avg_return"), F.avg("days").alias("avg_days"))


def sector_mix(holdings: DataFrame, top: int = 7) -> DataFrame:
    """(month, sector, holdings): mean count of holdings a day, the ``top`` sectors over all months and the rest as Other.

    ``holdings``: (date, symbol, sector), one row for each position and day. Days without any holding do not count."""
    day = holdings.groupBy("date", "sector").agg(F.count("*").alias("n"))
    days = holdings.select("date").distinct().groupBy(F.trunc("date", "month").alias("month")).agg(F.count("*").alias("d"))
    month = day.groupBy(F.trunc("date", "month").alias("month"), "sector").agg(F.sum("n").alias("n")).join(F.broadcast(days), "month").withColumn("n", F.col("n") / F.col("d"))
    order = month.groupBy("sector").agg(F.sum("n").alias("all")).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("all"), "sector")))
    name = F.when(F.col("k") <= top, F.col("sector")).otherwise("Other")
    return month.join(F.broadcast(order.select("sector", "k")), "sector").groupBy("month", name.alias("sector")).agg(F.sum("n").alias("holdings"))


def worst_day_while_held(trips: DataFrame, prices: DataFrame) -> DataFrame:
    """``trips`` (symbol, entry_date, exit_date, entry_price, exit_price, ...) with the worst close-to-close move while held: the first day
    from the entry price, the last to the exit price. Prices meet trips by symbol."""
    inside = trips.join(prices.select("symbol", "date", "close"), "symbol").where("date >= entry_date and date < exit_date")
    w = Window.partitionBy(*trips.columns).orderBy("date")
    moves = inside.select(*trips.columns, (F.col("close") / F.coalesce(F.lag("close").over(w), F.col("entry_price")) - 1).alias("m"), "close", "date")
    worst = moves.groupBy(*trips.columns).agg(F.min("m").alias("m"), F.max_by("close", "date").alias("last"))
    end = F.col("exit_price") / F.coalesce("last", F.col("entry_price")) - 1
    return worst.select(*trips.columns, F.least("m", end).alias("worst_day"))


def topk_trades(trips: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The ``k`` best and worst trips by return of each group of ``keys``, with their rank from either end."""
    w = Window.partitionBy(*keys)
    tie = ["symbol", "episode"]
    x = trips.withColumn("best", F.row_number().over(w.orderBy(F.desc("ret"), *tie))).withColumn("worst", F.row_number().over(w.orderBy("ret", *tie)))
    return x.where((F.col("best") <= k) | (F.col("worst") <= k))


def most_traded(trips: DataFrame, k: int = 15) -> DataFrame:
    return trips.groupBy("symbol").agg(F.count("*").alias("trades")).orderBy(F.desc("trades"), "symbol").limit(k)


def param_product(spark: SparkSession, grid: dict[str, list | DataFrame], keep: str | None = None) -> DataFrame:
    """Every combination of a parameter grid, lists or one-column tables of values, without the redundant ones that ``keep`` rejects."""
    out = None
    for name, values in grid.items():
        one = values.toDF(name) if isinstance(values, DataFrame) else spark.createDataFrame([(x,) for x in values], [name])
        out = one if out is None else out.crossJoin(one)  # configurations, not data
    return out.where(keep) if keep else out


def make_folds(first: str, last: str, train_years: int = 3, test_years: int = 1, anchored: bool = False, stub_days: int = 60) -> list[tuple[dt.date, dt.date, dt.date, dt.date]]:
    """(train from, train to, test from, test to) of rolling folds. A last test span under ``stub_days`` joins the one before."""
    a, z = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    plus = lambda d, y: d.replace(year=d.year + y, day=28 if (d.month, d.day) == (2, 29) else d.day)
    day, out, start = dt.timedelta(1), [], plus(a, train_years)
    while start + dt.timedelta(stub_days) <= z:
        out.append((a if anchored else plus(start, -train_years), start - day, start, min(plus(start, test_years) - day, z)))
        start = plus(start, test_years)
    return out[:-1] + [(*out[-1][:3], z)] if out else []


def cost_moments(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Means, variances and covariance of the excess return before costs and of the turnover: any cost's Sharpe ratio follows from them.

    ``frame``: (keys, date, position, asset, cash, turnover)."""
    x = F.col("position") * (F.col("asset") - F.col("cash"))
    t = F.col("turnover")
    return frame.groupBy(*keys).agg(F.avg(x).alias("m"), F.avg(t).alias("t"), F.var_samp(x).alias("v"), F.covar_samp(x, t).alias("k"), F.var_samp(t).alias("u"), F.sum(t).alias("switches"))


def cost_sensitivity(frame: DataFrame, keys: list[str], bps: list[float]) -> DataFrame:
    """(keys, bps, sharpe): the Sharpe ratio at each cost a switch, from one aggregate of the days."""
    m = cost_moments(frame, keys).select("*", F.explode(F.array(*map(F.lit, bps))).alias("bps"))
    c = F.col("bps") / 1e4
    sd = F.sqrt(F.col("v") - 2 * c * F.col("k") + c * c * F.col("u"))
    return m.select(*keys, "bps", ((F.col("m") - c * F.col("t")) / F.nullif(sd, F.lit(0.0)) * YEAR**0.5).alias("sharpe"))


def breakeven_cost(frame: DataFrame, keys: list[str], target: float = 0.0, high: float = 500.0) -> DataFrame:
    """(keys, bps): the cost a switch at which the yearly Sharpe ratio falls to ``target``. Null without switches, or if it is under the
    target without costs; infinite if it is still over it at ``high``. The moments make it a quadratic equation, solved as such."""
    x = cost_moments(frame, keys)
    goal = target / YEAR**0.5
    at = lambda c: (F.col("m") - c * F.col("t")) / F.sqrt(F.col("v") - 2 * c * F.col("k") + c * c * F.col("u"))
    a, b, d = F.col("t") ** 2 - goal**2 * F.col("u"), -2 * F.col("m") * F.col("t") + 2 * goal**2 * F.col("k"), F.col("m") ** 2 - goal**2 * F.col("v")
    root = F.sqrt(F.greatest(b * b - 4 * a * d, F.lit(0.0)))
    one, two = (-b - root) / (2 * a), (-b + root) / (2 * a)
    good = lambda c: (c >= 0) & (F.abs(at(c) - goal) < 1e-9)
    first = F.least(F.when(good(one), one), F.when(good(two), two))
    cost = F.when((F.col("switches") == 0) | (at(F.lit(0.0)) < goal), F.lit(None).cast("double")).when(at(F.lit(high / 1e4)) > goal, F.lit(float("inf"))).otherwise(first * 1e4)
    return x.select(*keys, cost.alias("bps"))


def lag_sensitivity(signals: DataFrame, keys: list[str], lags: list[int], bps: float) -> DataFrame:
    """(keys, lag, sharpe): positions are the signals of ``lag`` days before. ``signals``: (keys, date, close, signal)."""
    w = by(*keys)
    x = signals.withColumn("asset", F.col("close") / F.lag("close").over(w) - 1)
    for n in lags:
        x = x.withColumn(f"_p{n}", F.lag("signal", n).over(w).cast("double"))
    long = x.where(F.col("asset").isNotNull() & F.col(f"_p{max(lags)}").isNotNull()).unpivot([*keys, "date", "asset"], [f"_p{n}" for n in lags], "lag", "position")
    long = long.withColumn("lag", F.substring("lag", 3, 9).cast("int"))
    ret = F.col("position") * F.col("asset") - F.abs(F.col("position") - F.coalesce(F.lag("position").over(by(*keys, "lag")), F.col("position"))) * bps / 1e4
    return long.withColumn("ret", ret).groupBy(*keys, "lag").agg(sharpe_of(F.col("ret")).alias("sharpe"))


def stationary_indices(spark: SparkSession, n: int, paths: int, mean_block: float) -> DataFrame:
    """(path, step, i): blocks of random length, ``mean_block`` on average, from random starts of a circle of n observations."""
    x = spark.range(paths * n).select((F.col("id") / n).cast("long").alias("path"), (F.col("id") % n).alias("step"))
    begins = (F.col("step") == 0) | (uniform("path", "step", 1) < 1 / mean_block)
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_t", F.last(F.when(begins, F.col("step")), True).over(w))
    return x.select("path", "step", ((F.floor(uniform("path", "_t", 2) * n).cast("long") + F.col("step") - F.col("_t")) % n).alias("i"))


def block_month_indices(spark: SparkSession, n: int, paths: int, block: int = 12) -> DataFrame:
    """(path, step, i): blocks of ``block`` months that do not run past the end."""
    x = spark.range(paths * n).select((F.col("id") / n).cast("long").alias("path"), (F.col("id") % n).alias("step"))
    b = F.floor(F.col("step") / block)
    return x.select("path", "step", (F.floor(uniform("path", b, 3) * (n - block + 1)) + F.col("step") % block).cast("long").alias("i"))


def sharpe_difference_test(pairs: DataFrame, indices: DataFrame, periods: int = YEAR) -> DataFrame:
    """(difference, low, high, p, not_better) of paired excess returns (i, a, b) under resampled ``indices`` (path, step, i).

    low and high: the middle 95 %. p: the share of draws whose difference is as far over the observed one as that is over zero, each
    count plus one. not_better: the share of draws in which a is no better than b, ties included."""
    sr = lambda c: F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * periods**0.5
    seen = pairs.agg((sr("a") - sr("b")).alias("o"))
    d = indices.join(F.broadcast(pairs), "i").groupBy("path").agg(F.round(sr("a") - sr("b"), 10).alias("d"))
    q = lambda x: F.percentile("d", F.lit(x))
    over = F.sum((F.col("d") - F.col("o") >= F.col("o")).cast("double"))
    return d.join(F.broadcast(seen)).agg(F.first("o").alias("difference"), q(0.025).alias("low"), q(0.975).alias("high"), ((over + 1) / (F.count("*") + 1)).alias("p"), F.avg((F.col("d") <= 0).cast("double")).alias("not_better"))


def shift_test(shifted: DataFrame) -> DataFrame:
    """(series_id, actual, p): of (series_id, shift, mean), how often a shift does as well as none, each count plus one."""
    real = shifted.where("shift = 0").select("series_id", F.col("mean").alias("actual"))
    x = shifted.where("shift <> 0").join(F.broadcast(real), "series_id")
    return x.groupBy("series_id").agg(F.first("actual").alias("actual"), ((F.sum((F.col("mean") >= F.col("actual")).cast("double")) + 1) / (F.count("*") + 1)).alias("p"))


def perf_stats(frame: DataFrame) -> DataFrame:
    """The momentum report's figures of (series_id, date, ret, rf, position, turnover): value at risk as a loss, the longest drawdown in
    years of 365.25 days, time in market and switches a year."""
    r, x = F.col("ret"), F.col("ret") - F.col("rf")
    dd = drawdown(frame)
    daily = dd.groupBy("series_id").agg(
        F.count("*").alias("days"), cagr_of(r).alias("cagr"), (F.stddev_samp(r) * YEAR**0.5).alias("volatility"), sharpe_of(x).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        (-F.percentile(r, F.lit(0.05))).alias("var95"), F.avg((r > 0).cast("double")).alias("positive"), F.avg("position").alias("time_in_market"), (F.sum("turnover") / F.count("*") * YEAR).alias("switches"),
    )
    peak = dd.withColumn("_p", F.max(F.when(F.col("drawdown") >= -1e-12, F.col("date"))).over(by("series_id").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_s", F.min("date").over(Window.partitionBy("series_id")))
    longest = peak.groupBy("series_id").agg((F.max(F.datediff("date", F.coalesce("_p", "_s"))) / 365.25).alias("longest_years"))
    return daily.join(longest, "series_id")


def perturbation_audit(operator: Callable[[DataFrame], DataFrame], data: DataFrame, cut: str, value: str = "close") -> DataFrame:
    """Rows up to the cut that change if all values after it are shaken: empty for an operator without look-ahead."""
    late = F.col("date") > F.lit(cut).cast("date")
    shaken = data.withColumn(value, F.when(late, F.col(value) * (1.5 + F.dayofmonth("date") % 7 / 10)).otherwise(F.col(value)))
    until = F.col("date") <= F.lit(cut).cast("date")
    return operator(data).where(until).exceptAll(operator(shaken).where(until))


def same_bar_audit(operator: Callable[[DataFrame], DataFrame], data: DataFrame, day: str, value: str = "close") -> DataFrame:
    """Rows of the day whose position changes if the day's own value is shaken: empty if positions are decided before it."""
    on = F.col("date") == F.lit(day).cast("date")
    shaken = data.withColumn(value, F.when(on, F.col(value) * 1.5).otherwise(F.col(value)))
    return operator(data).where(on).exceptAll(operator(shaken).where(on))
