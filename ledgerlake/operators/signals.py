"""Signals and rule backtests as windows; parameter grids are a join with a small configuration table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import asof_backward, by, lookback


def momentum_signal(prices: DataFrame, days: int, threshold: float = 0.0) -> DataFrame:
    """1 if the return over the calendar look-back is over the threshold, 0 if not, null while there is no reference price."""
    m = F.col("close") / lookback(prices, ["symbol"], "close", days) - 1
    out = prices.withColumn("momentum", m)
    return out.withColumn("signal", F.when(F.col("momentum").isNotNull(), (F.col("momentum") > threshold).cast("int")))


def current_signals(prices: DataFrame, lookbacks: dict[str, int], threshold: float = 0.0) -> DataFrame:
    """(symbol, lookback, date, start, reference_date, reference_close, close, momentum, signal): what each symbol's last close says for the
    next session under each look-back of calendar days; null where there is no close that far back."""
    last = prices.groupBy("symbol").agg(F.max_by(F.struct("date", "close"), "date").alias("p")).select("symbol", F.col("p.date").alias("_at"), F.col("p.close").alias("_close"))
    each = last.select("*", F.explode(F.create_map(*(F.lit(x) for pair in lookbacks.items() for x in pair))).alias("lookback", "_days"))
    asked = each.withColumn("date", F.date_sub("_at", F.col("_days")))
    found = asof_backward(asked, prices.select("symbol", "date", F.col("date").alias("_from"), F.col("close").alias("_ref")), ["symbol"], ["_from", "_ref"])
    momentum = F.col("_close") / F.col("_ref") - 1
    return found.select(
        "symbol", "lookback", F.col("_at").alias("date"), F.col("date").alias("start"), F.col("_from").alias("reference_date"), F.col("_ref").alias("reference_close"), F.col("_close").alias("close"),
        momentum.alias("momentum"), F.when(momentum.isNotNull(), (momentum > threshold).cast("int")).alias("signal"),
    )


def longflat(signals: DataFrame, keys: list[str], bps: float, cash: float = 0.0, first_cost: bool = True) -> DataFrame:
    """Positions are yesterday's signals; returns are position x asset + (1 - position) x cash less the cost of each change."""
    w = by(*keys)
    x = signals.withColumn("asset", F.col("close") / F.lag("close").over(w) - 1).withColumn("position", F.lag("signal").over(w))
    x = x.where("position is not null and asset is not null")
    before = F.lag("position").over(w)
    change = F.abs(F.col("position") - F.coalesce(before, F.lit(0) if first_cost else F.col("position")))
    return x.withColumn("cost", change * bps / 1e4).withColumn("ret", F.col("position") * F.col("asset") + (1 - F.col("position")) * cash - F.col("cost"))


def run_lookbacks(prices: DataFrame, days: list[int], bps: float) -> DataFrame:
    """``longflat`` for each look-back in one pass over the prices: each signal is a column, unpivoted to configurations."""
    wide = prices
    for n in days:
        wide = wide.withColumn(f"s{n}", (F.col("close") / lookback(prices, ["symbol"], "close", n) - 1 > 0).cast("int"))
    long = wide.unpivot(["symbol", "date", "close"], [f"s{n}" for n in days], "config", "signal")
    return longflat(long, ["config", "symbol"], bps)


def stepped(confidence: Column, step: float = 0.1) -> Column:
    """A confidence in steps (half-even rounding), between 0 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.bround(confidence / step, 0) * step, 4)))


def alloc_proportional(confidence: Column, assets: int = 1) -> Column:
    """The weight of each of ``assets`` risky assets that share the confidence equally."""
    return confidence / assets


def alloc_tiered(confidence: Column, tiers: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    """An asset's weight in the highest tier (bound, weight) that the confidence reaches."""
    out = F
    for bound, weight in sorted(tiers, reverse=True):
        out = out.when(confidence >= bound - 1e-9, F.lit(weight))
    return out.otherwise(F.lit(otherwise))


def alloc_constant(weight: float) -> Column:
    return F.lit(weight)


def shift_known(df: DataFrame, months: int = 1) -> DataFrame:
    """Monthly figures as of the month in which they are known."""
    return df.withColumn("month", F.add_months("month", months))


def momentum_walk_forward(results: DataFrame, least: int = 200) -> DataFrame:
    """(year, config): each year the configuration with the best Sharpe ratio of all earlier days; ties go to the first name."""
    daily = results.groupBy("config", "date").agg(F.avg("ret").alias("ret"))
    year = daily.groupBy("config", F.year("date").alias("y")).agg(F.count("*").alias("n"), F.sum("ret").alias("s1"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))
    w = by("config", order="y").rowsBetween(Window.unboundedPreceding, -1)
    past = year.select("config", F.col("y").alias("year"), F.sum("n").over(w).alias("n"), F.sum("s1").over(w).alias("s1"), F.sum("s2").over(w).alias("s2")).where(F.col("n") >= least)
    sd = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1))
    sr = past.withColumn("sr", F.round(F.col("s1") / F.col("n") / F.nullif(sd, F.lit(0.0)), 9))
    return sr.groupBy("year").agg(F.min(F.struct((-F.col("sr")).alias("k"), "config"))["config"].alias("config"))


def grid_neighbourhood(grid: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Mean of the 3 x 3 neighbours of each cell of a parameter grid: each cell is sent to its nine neighbours' keys, no self-join."""
    near = F.explode(F.array(*(F.struct((F.col(x) + i).alias(x), (F.col(y) + j).alias(y)) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sent = grid.select(near.alias("c"), F.col(value).alias("_v")).groupBy(f"c.{x}", f"c.{y}").agg(F.avg("_v").alias("neighbourhood"))
    return grid.join(sent, [x, y])


def scorecard(results: DataFrame, higher: list[str], lower: list[str]) -> DataFrame:
    """Points of each configuration: one for each metric in which it is best; ties all score."""
    points = F.lit(0)
    everyone = results.agg(*(F.max(c).alias(f"_{c}") for c in higher), *(F.min(c).alias(f"_{c}") for c in lower))
    for c in (*higher, *lower):
        points = points + (F.col(c) == F.col(f"_{c}")).cast("int")
    return results.join(F.broadcast(everyone)).withColumn("points", points).select(*results.columns, "points")
