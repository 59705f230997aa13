"""Benchmark and cash series: total returns, the daily risk-free rate, and market frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import YEAR
from .timeseries import asof_backward, by


def benchmark_total_return(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    """(symbol, date, ret): close and the dividend of its ex-date over the close before, less 1."""
    d = dividends.groupBy("symbol", "date").agg(F.sum("dividend").alias("dividend"))
    x = prices.join(d, ["symbol", "date"], "left")
    ret = (F.col("close") + F.coalesce("dividend", F.lit(0.0))) / F.lag("close").over(by("symbol")) - 1
    return x.select("symbol", "date", ret.alias("ret")).where("ret is not null")


def risk_free_daily(calendar: DataFrame, yields: DataFrame | float) -> DataFrame:
    """(date, rf) on each calendar day: the yield known the day before, in percent between 0 and 25, over the calendar days since; the
    first known yield counts for the days before it. A number is a constant yearly rate. A calendar is days: one task orders it."""
    days = calendar.select("date").distinct()
    if not isinstance(yields, DataFrame):
        return days.withColumn("rf", F.lit((1 + yields) ** (1 / YEAR) - 1))
    y = yields.select(F.lit(1).alias("k"), "date", (F.least(F.lit(25.0), F.greatest(F.lit(0.0), F.col("yield"))) / 100).alias("y"))
    at = asof_backward(days.withColumn("k", F.lit(1)), y, ["k"], ["y"])
    w = Window.partitionBy("k").orderBy("date")
    before = F.coalesce(F.lag("y").over(w), F.first("y", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    gap = F.coalesce(F.datediff("date", F.lag("date").over(w)), F.lit(1))
    return at.select("date", F.coalesce(F.pow(1 + before, gap / 365.0) - 1, F.lit(0.0)).alias("rf"))


def with_rf(returns: DataFrame, rf: DataFrame | float = 0.0) -> DataFrame:
    """``returns`` with a column ``rf``: the day's rate of (date, rf), 0 where it has none, or a constant yearly rate by day."""
    if isinstance(rf, DataFrame):
        return returns.join(rf.select("date", "rf"), "date", "left").withColumn("rf", F.coalesce("rf", F.lit(0.0)))
    return returns.withColumn("rf", F.lit((1 + rf) ** (1 / YEAR) - 1))


def build_market(closes: DataFrame, total: DataFrame, rf: DataFrame | float) -> DataFrame:
    """(market, date, close, ret, cash): the total-return index's change where it has both closes, else the price change.

    ``closes`` and ``total``: (market, date, close).
    """
    w = by("market")
    x = closes.join(total.select("market", "date", F.col("close").alias("tr")), ["market", "date"], "left")
    change = lambda c: F.col(c) / F.lag(c).over(w) - 1
    return with_rf(x.withColumn("ret", F.coalesce(change("tr"), change("close"))), rf).select("market", "date", "close", "ret", F.col("rf").alias("cash")).where("ret is not null")
