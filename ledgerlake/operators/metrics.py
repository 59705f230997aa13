"""Return metrics of keyed daily series ``(series_id, date, ret)``: undefined figures are null, never NaN.

With ``unbounded``, ratios over a risk of zero are infinite instead, as a plain division of doubles gives them, however few the days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import YEAR, over, phi, phi_inverse, safe_beta, safe_corr, sharpe_error
from .rates import with_rf
from .timeseries import by, full, islands, running, running_product


def W() -> WindowSpec:
    """By series, in date order."""
    return by("series_id")


ROOT = math.sqrt(YEAR)


def clean_returns(returns: DataFrame) -> DataFrame:
    """Without nulls, NaN and infinities."""
    return returns.where(F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") < F.lit(float("inf"))))


def wealth(returns: DataFrame, start: float = 1.0) -> DataFrame:
    return returns.withColumn("wealth", F.lit(start) * running_product(1 + F.col("ret"), W()))


def drawdown(returns: DataFrame) -> DataFrame:
    """Wealth over its running peak (never below the start), minus 1."""
    w = wealth(returns)
    return w.withColumn("drawdown", F.col("wealth") / F.greatest(F.max("wealth").over(running(W())), F.lit(1.0)) - 1)


def excess(rf: float = 0.0) -> Column:
    """Return over a constant yearly risk-free rate."""
    return F.col("ret") - ((1 + rf) ** (1 / YEAR) - 1)


def sharpe_of(x: Column, unbounded: bool = False) -> Column:
    sd = F.stddev_samp(x)
    if unbounded:
        return over(F.avg(x), sd, True) * ROOT
    return F.when((F.count(x) > 2) & (sd > 0), F.avg(x) / F.nullif(sd, F.lit(0.0)) * ROOT)


def sortino_of(x: Column, unbounded: bool = False) -> Column:
    low = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2))))
    if unbounded:
        return over(F.avg(x), low, True) * ROOT
    return F.when((F.count(x) > 2) & (low > 0), F.avg(x) / F.nullif(low, F.lit(0.0)) * ROOT)


def cagr_of(ret: Column) -> Column:
    total = F.product(1 + ret)
    return F.when(total <= 0, F.lit(-1.0)).otherwise(F.pow(total, F.lit(float(YEAR)) / F.count(ret)) - 1)


def underwater(returns: DataFrame, level: float = -1e-12) -> DataFrame:
    """Episodes below the peak: peak, trough and recovery dates, depth, and lengths in rows; recovery is null while it lasts."""
    dd = drawdown(returns).withColumn("prev", F.lag("date").over(W())).withColumn("next", F.lead("date").over(W()))
    runs = islands(dd, ["series_id"], F.col("drawdown") < level)
    return runs.groupBy("series_id", "island").agg(
        F.coalesce(F.min_by("prev", "date"), F.min("date")).alias("peak"),
        F.min(F.struct("drawdown", "date"))["date"].alias("trough"),
        F.max_by("next", "date").alias("recovery"),
        F.min("drawdown").alias("depth"),
        F.count("*").alias("length"),
    ).withColumn("recovered", F.col("recovery").isNotNull())


def drawdown_episodes(returns: DataFrame, level: float) -> DataFrame:
    """(series_id, episodes, days): separate times, and days, that wealth was over ``level`` (negative) below its peak."""
    under = drawdown(returns).withColumn("_u", F.col("drawdown") < level)
    new = under.withColumn("_new", F.col("_u") & ~F.coalesce(F.lag("_u").over(W()), F.lit(False)))
    return new.groupBy("series_id").agg(F.sum(F.col("_new").cast("long")).alias("episodes"), F.sum(F.col("_u").cast("long")).alias("days"))


def drawdown_table(returns: DataFrame, top: int = 5) -> DataFrame:
    """The deepest episodes of each series."""
    w = by("series_id", order="depth").orderBy("depth", "peak")
    return underwater(returns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def period_returns(returns: DataFrame, *periods: Column) -> DataFrame:
    return returns.groupBy("series_id", *periods).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


def monthly_returns(returns: DataFrame) -> DataFrame:
    return period_returns(returns, F.year("date").alias("year"), F.month("date").alias("month"))


def monthly_table(returns: DataFrame) -> DataFrame:
    """Years by months, and the year's return."""
    year = period_returns(returns, F.year("date").alias("year")).withColumnRenamed("ret", "full_year")
    grid = monthly_returns(returns).groupBy("series_id", "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    named = grid.select("series_id", "year", *(F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)))
    return named.join(year, ["series_id", "year"])


def moments(x: Column) -> dict[str, Column]:
    return {"n": F.count(x), "mean": F.avg(x), "sd": F.stddev_samp(x), "skew": F.skewness(x), "kurtosis": F.kurtosis(x) + 3}


def sharpe_inference(returns: DataFrame, rf: DataFrame | float = 0.0, benchmark: float = 0.0, prob: float = 0.95) -> DataFrame:
    """Per-period Sharpe ratio, its standard error, the probability that the true one is over ``benchmark`` (yearly), and the years of
    record needed to say so with ``prob`` (infinite if it is not over it)."""
    m = with_rf(returns, rf).groupBy("series_id").agg(*(c.alias(k) for k, c in moments(F.col("ret") - F.col("rf")).items()))
    sr, sr0 = F.col("mean") / F.nullif("sd", F.lit(0.0)), benchmark / ROOT
    out = m.where("n >= 10").withColumn("sr", sr).withColumn("se", sharpe_error(F.col("sr"), F.col("n"), F.col("skew"), F.col("kurtosis")))
    need = 1 + (1 - F.col("skew") * F.col("sr") + (F.col("kurtosis") - 1) / 4 * F.pow("sr", F.lit(2))) * F.pow(F.lit(phi_inverse(prob)) / F.nullif(F.col("sr") - sr0, F.lit(0.0)), F.lit(2))
    return out.withColumn("psr", phi((F.col("sr") - sr0) / F.col("se"))).withColumn("min_years", F.when(F.col("sr") <= sr0, F.lit(float("inf"))).otherwise(need / YEAR))


def with_bench(returns: DataFrame, bench: DataFrame, how: str = "inner") -> DataFrame:
    return returns.join(bench.select("date", F.col("ret").alias("bench")), "date", how)


def beta_alpha(returns: DataFrame, bench: DataFrame, rf: DataFrame | float = 0.0) -> DataFrame:
    x, b = F.col("ret") - F.col("rf"), F.col("bench") - F.col("rf")
    m = with_rf(with_bench(returns, bench), rf).groupBy("series_id").agg(F.count("*").alias("n"), safe_beta(x, b).alias("beta"), F.avg(x).alias("mx"), F.avg(b).alias("mb"), safe_corr("ret", "bench").alias("corr"))
    return m.where("n >= 10").select("series_id", "beta", ((F.col("mx") - F.col("beta") * F.col("mb")) * YEAR).alias("alpha"), "corr")


def capture(returns: DataFrame, bench: DataFrame) -> DataFrame:
    """Mean monthly return over the benchmark's in its up and in its down months."""
    month = F.date_trunc("month", "date").cast("date")
    both = with_bench(returns, bench).groupBy("series_id", month.alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("r"), (F.product(1 + F.col("bench")) - 1).alias("b"))
    side = lambda c: F.avg(F.when(c, F.col("r"))) / F.avg(F.when(c, F.col("b")))
    return both.groupBy("series_id").agg(side(F.col("b") > 0).alias("up_capture"), side(F.col("b") < 0).alias("down_capture"))


def days_since_peak(returns: DataFrame) -> DataFrame:
    dd = drawdown(returns).withColumn("i", F.row_number().over(W()))
    return dd.groupBy("series_id").agg((F.count("*") - F.coalesce(F.max(F.when(F.col("drawdown") >= -1e-12, F.col("i"))), F.lit(0))).alias("days"))


def perf_summary(returns: DataFrame, rf: DataFrame | float = 0.0, bench: DataFrame | None = None, unbounded: bool = False) -> DataFrame:
    """The tear sheet of each series, 30 figures, and 8 more against a benchmark (date, ret). ``rf``: (date, rf) or a yearly rate.

    Only clean returns count. One grouped aggregate of days, one of months, one of episodes, one of the tail. With ``unbounded`` the tail
    ratio is also given where the low tail is no loss, and gain to pain is null without a gain.
    """
    clean = with_rf(clean_returns(returns), rf)
    dd = drawdown(clean).withColumn("i", F.row_number().over(W()))
    r, x = F.col("ret"), F.col("ret") - F.col("rf")
    daily = dd.groupBy("series_id").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"), (F.product(1 + r) - 1).alias("total_return"), cagr_of(r).alias("cagr"), (F.stddev_samp(r) * ROOT).alias("volatility"),
        sharpe_of(x, unbounded).alias("sharpe"), sortino_of(x, unbounded).alias("sortino"), F.min("drawdown").alias("max_drawdown"), F.max_by("drawdown", "date").alias("current_drawdown"),
        (F.count("*") - F.coalesce(F.max(F.when(F.col("drawdown") >= -1e-12, F.col("i"))), F.lit(0))).alias("days_since_peak"),
        F.sqrt(F.avg(F.pow("drawdown", F.lit(2)))).alias("ulcer"), F.percentile(r, F.lit(0.05)).alias("var95"), F.percentile(r, F.lit(0.01)).alias("var99"),
        F.percentile(r, F.lit(0.95)).alias("p95"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess_kurtosis"), F.max(r).alias("best_day"), F.min(r).alias("worst_day"),
        F.avg((r > 0).cast("double")).alias("hit_rate"), F.sum(F.when(r > 0, r)).alias("gain"), F.sum(F.when(r < 0, -r)).alias("pain"), (F.avg(x) * YEAR).alias("excess_return"),
    ).where("days >= 2")
    tail = clean.join(daily.select("series_id", "var95"), "series_id").where("ret <= var95").groupBy("series_id").agg(F.avg("ret").alias("cvar95"))
    months = monthly_returns(clean).groupBy("series_id").agg(F.max("ret").alias("best_month"), F.min("ret").alias("worst_month"), F.avg((F.col("ret") > 0).cast("double")).alias("month_hit_rate"))
    longest = underwater(clean).groupBy("series_id").agg(F.max("length").alias("longest_drawdown"))
    out = daily.join(tail, "series_id", "left").join(months, "series_id", "left").join(longest, "series_id", "left").join(sharpe_inference(clean.drop("rf"), rf).select("series_id", "psr"), "series_id", "left")
    if bench is not None:
        act = F.col("ret") - F.coalesce("bench", F.lit(0.0))
        both = with_bench(clean, bench, "left").groupBy("series_id").agg((F.stddev_samp(act) * ROOT).alias("tracking_error"), (F.avg(act) * YEAR).alias("_act"), (F.product(1 + F.coalesce("bench", F.lit(0.0))) - 1).alias("benchmark_return"))
        both = both.withColumn("information_ratio", over(F.col("_act"), F.col("tracking_error"), unbounded)).drop("_act")
        out = out.join(beta_alpha(clean.drop("rf"), bench, rf), "series_id", "left").join(both, "series_id", "left").join(capture(clean, bench), "series_id", "left")
    gain = F.col("gain") if unbounded else F.coalesce("gain", F.lit(0.0))
    tail_ratio = over(F.col("p95"), F.abs("var95"), True) if unbounded else F.when(F.col("var95") < 0, F.abs(F.col("p95") / F.col("var95")))
    return out.na.fill(0, ["longest_drawdown"]).select(
        "*", (F.col("days") / YEAR).alias("years"), over(F.col("cagr"), F.abs("max_drawdown"), unbounded).alias("calmar"), F.when(F.col("pain") > 0, gain / F.col("pain")).alias("gain_to_pain"),
        tail_ratio.alias("tail_ratio"),
    ).drop("gain", "pain", "p95")


def summary_frame(returns: DataFrame, rf: DataFrame | float = 0.0, bench: DataFrame | None = None, unbounded: bool = False) -> DataFrame:
    """(series_id, metric, value): every number of ``perf_summary``, one row each."""
    return figures_of(perf_summary(returns, rf, bench, unbounded))


def figures_of(x: DataFrame) -> DataFrame:
    """(series_id, metric, value): every number of a table of figures, one row each."""
    numbers = [c for c, t in x.dtypes if t in ("double", "bigint", "int")]
    return x.select("series_id", *(F.col(c).cast("double").alias(c) for c in numbers)).unpivot("series_id", numbers, "metric", "value")


def stats_row(returns: DataFrame, rf: float = 0.0, least: int = 20, unbounded: bool = False) -> DataFrame:
    dd = drawdown(returns)
    r = F.col("ret")
    return dd.groupBy("series_id").agg(F.count("*").alias("n"), cagr_of(r).alias("cagr"), (F.stddev_samp(r) * ROOT).alias("volatility"), sharpe_of(excess(rf), unbounded).alias("sharpe"), sortino_of(excess(rf), unbounded).alias("sortino"), F.min("drawdown").alias("max_drawdown")).where(F.col("n") >= least)


def trade_summary(trips: DataFrame, *keys: str) -> DataFrame:
    """Of closed round trips (keys, trip order ``exit_seq``, ret, pnl, days): rates, averages, and the longest run of losses."""
    win, r, pnl = F.col("ret") > 0, F.col("ret"), F.col("pnl")
    losses = islands(trips, list(keys), r <= 0, "exit_seq").groupBy(*keys, "island").count().groupBy(*keys).agg(F.max("count").alias("max_losing_run"))
    agg = trips.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.avg(win.cast("double")).alias("win_rate"), F.avg(r).alias("avg_ret"), F.percentile(r, F.lit(0.5)).alias("median_ret"),
        (F.avg(F.when(win, r)) / F.nullif(F.abs(F.avg(F.when(~win, r))), F.lit(0.0))).alias("payoff"),
        (F.sum(F.when(pnl > 0, pnl)) / F.nullif(F.abs(F.sum(F.when(pnl < 0, pnl))), F.lit(0.0))).alias("profit_factor"),
        F.max(r).alias("best"), F.min(r).alias("worst"), F.avg("days").alias("avg_days"),
    )
    return agg.join(losses, list(keys), "left").na.fill(0, ["max_losing_run"])


def rolling(returns: DataFrame, n: int, rf: float = 0.0) -> DataFrame:
    """Rolling Sharpe ratio, volatility, return and bias-corrected kurtosis over full windows."""
    x, r = excess(rf), F.col("ret")
    sd = full(F.stddev_samp(x), W(), n)
    g2 = full(F.kurtosis(r), W(), n)
    out = returns.withColumn("rolling_sharpe", full(F.avg(x), W(), n) / F.nullif(sd, F.lit(0.0)) * ROOT).withColumn("rolling_vol", full(F.stddev_samp(r), W(), n) * ROOT)
    out = out.withColumn("rolling_return", full(F.product(1 + r), W(), n) - 1)
    return out.withColumn("rolling_kurtosis", F.lit((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * g2 + 6))


def rolling_beta(returns: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    both = with_bench(returns, bench)
    return both.withColumn("rolling_beta", full(F.covar_samp("ret", "bench"), W(), n) / F.nullif(full(F.var_samp("bench"), W(), n), F.lit(0.0)))


def rolling_correlations(returns: DataFrame, n: int) -> DataFrame:
    """Of every pair of series a < b on common dates."""
    a = returns.select("date", F.col("series_id").alias("a"), F.col("ret").alias("x"))
    b = returns.select("date", F.col("series_id").alias("b"), F.col("ret").alias("y"))
    w = by("a", "b")
    return a.join(b, "date").where("a < b").select("a", "b", "date", (full(F.covar_pop("x", "y"), w, n) / F.nullif(full(F.stddev_pop("x"), w, n) * full(F.stddev_pop("y"), w, n), F.lit(0.0))).alias("corr"))


def ewma_vol_target(returns: DataFrame, target: float, half_life: float, cap: float, least: int = 20) -> DataFrame:
    """Scale min(cap, target / lagged EWMA volatility); the first known value of a month is held for all of it."""
    decay = 0.5 ** (1 / half_life)
    i = F.row_number().over(W())
    numbered = returns.withColumn("i", i)
    # over the last 60 half-lives, beyond which a weight is under 1e-18 of the first: sums scaled within blocks, so no power overflows
    size = max(1, int(100 * half_life))
    block = Window.partitionBy("series_id", "_b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = numbered.withColumn("_b", F.floor(F.col("i") / size)).withColumn("_k", (F.col("i") % size).cast("double"))
    up = F.pow(F.lit(1 / decay), F.col("_k"))
    numbered = numbered.withColumn("_s", F.sum(F.col("ret") * F.col("ret") * up).over(block) / up).withColumn("_n", F.sum(up).over(block) / up)
    ends = numbered.groupBy("series_id", "_b").agg(F.max_by("_s", "i").alias("_ps"), F.max_by("_n", "i").alias("_pn")).withColumn("_b", F.col("_b") + 1)
    numbered = numbered.join(ends, ["series_id", "_b"], "left")  # the block before, faded by the days since its end
    fade = F.pow(F.lit(decay), F.col("_k") + 1)
    numbered = numbered.withColumn("_s", F.col("_s") + F.coalesce(F.col("_ps") * fade, F.lit(0.0))).withColumn("_n", F.col("_n") + F.coalesce(F.col("_pn") * fade, F.lit(0.0)))
    var = F.lag("_s").over(W()) / F.lag("_n").over(W())
    vol = numbered.withColumn("vol", F.when(F.col("i") > least, F.sqrt(var) * ROOT)).select(*returns.columns, "vol")
    month = Window.partitionBy("series_id", F.date_trunc("month", "date")).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vol.withColumn("scale", F.first(F.when(F.col("vol") > 0, F.least(F.lit(cap), F.lit(target) / F.col("vol"))), ignorenulls=True).over(month))


def spell_stats(positions: DataFrame) -> DataFrame:
    """Invested spells of (series_id, date, position, ret, cash): length, return, and return over cash."""
    runs = islands(positions, ["series_id"], F.col("position") > 0)
    grown = lambda c: F.product(1 + F.col(c))
    return runs.groupBy("series_id", "island").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("length"), (grown("ret") - 1).alias("ret"), (grown("ret") - grown("cash")).alias("excess"))


def limit_checks(summary: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(level, scope, message) of each rule that a series (series_id, max_drawdown, volatility, sharpe) breaks."""
    d = F.col
    rules = [
        ("alert", d("max_drawdown") < -limits["drawdown"], "drawdown beyond the limit"),
        ("warning", d("volatility") > limits["volatility"], "volatility over the limit"),
        ("warning", d("sharpe") < limits["sharpe"], "Sharpe ratio under the limit"),
    ]
    found = F.array(*(F.when(broken, F.struct(F.lit(level).alias("level"), F.lit(text).alias("message"))) for level, broken, text in rules))
    return summary.select(d("series_id").alias("scope"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("x.level", "scope", "x.message")


def _falls(frame: DataFrame) -> DataFrame:
    """``frame`` with _dd, wealth below its highest so far (the start does not count), and _run, the days of each unbroken fall so far."""
    w = W()
    x = wealth(frame)
    x = x.withColumn("_dd", F.col("wealth") / F.max("wealth").over(running(w)) - 1)
    x = x.withColumn("_k", F.sum((F.col("_dd") >= 0).cast("int")).over(running(w)))
    return x.withColumn("_run", F.sum((F.col("_dd") < 0).cast("int")).over(Window.partitionBy("series_id", "_k").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def regime_stats(frame: DataFrame, bench: DataFrame, unbounded: bool = False) -> DataFrame:
    """The regime report's figures of (series_id, date, ret, rf, exposure, turnover) against (date, ret) of a benchmark.

    Daily: growth, risk, drawdowns (in years of 252 days, from the highest wealth of the record itself), tails, exposure and turnover a
    year. By calendar month: best and worst, shape, the probability that the Sharpe ratio is over 0, and beta, alpha, correlation,
    tracking error, information ratio and captures against the benchmark, whose missing days count as 0. One pass over days, one over months.
    """
    r, x = F.col("ret"), F.col("ret") - F.col("rf")
    days = _falls(frame.join(bench.select("date", F.col("ret").alias("_b")), "date", "left").withColumn("_b", F.coalesce("_b", F.lit(0.0))))
    years, down = F.count("*") / F.lit(float(YEAR)), F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2)))) * ROOT
    total = F.product(1 + r)
    cut = days.groupBy("series_id").agg(F.percentile("ret", F.lit(0.05)).alias("var95"))
    daily = days.join(cut, "series_id").groupBy("series_id").agg(
        (F.pow(total, 1 / years) - 1).alias("cagr"), (total - 1).alias("total_return"), (F.stddev_samp(r) * ROOT).alias("volatility"), down.alias("downside"), (over(F.avg(x), F.stddev_samp(x), unbounded) * ROOT).alias("sharpe"),
        over(F.avg(x) * YEAR, down, unbounded).alias("sortino"), F.min("_dd").alias("max_drawdown"), (F.max("_run") / YEAR).alias("longest_years"), F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))).alias("ulcer"),
        F.first("var95").alias("var95"), F.avg(F.when(r <= F.col("var95"), r)).alias("cvar95"), F.avg("exposure").alias("exposure"), F.avg((F.col("exposure") > 0.01).cast("double")).alias("invested"), (F.sum("turnover") / years).alias("turnover"),
    ).withColumn("calmar", over(F.col("cagr"), F.abs("max_drawdown"), unbounded))
    month = days.groupBy("series_id", F.trunc("date", "month").alias("_m")).agg((F.product(1 + r) - 1).alias("m"), (F.product(1 + F.col("rf")) - 1).alias("f"), (F.product(1 + F.col("_b")) - 1).alias("b"))
    month = month.withColumns({"e": F.col("m") - F.col("f"), "be": F.col("b") - F.col("f"), "act": F.col("m") - F.col("b")})
    e, m, b, act = (F.col(c) for c in ("e", "m", "b", "act"))
    mean_of = lambda c, when: F.avg(F.when(when, c))
    error = F.stddev_samp(act) * 12**0.5
    beta = F.covar_samp("e", "be") / F.nullif(F.var_samp("be"), F.lit(0.0))
    monthly = month.groupBy("series_id").agg(
        F.max(m).alias("best_month"), F.min(m).alias("worst_month"), F.avg((m > 0).cast("double")).alias("positive_months"), F.skewness(e).alias("skew"), (F.kurtosis(e) + 3).alias("kurtosis"), (F.avg(e) / F.nullif(F.stddev_samp(e), F.lit(0.0))).alias("_sr"), F.count("*").alias("_n"),
        beta.alias("beta"), ((F.avg(e) - beta * F.avg("be")) * 12).alias("alpha"), safe_corr("m", "b").alias("correlation"), error.alias("tracking_error"), (over(F.avg(act) * 12, error, True) if unbounded else F.when(error > 1e-9, F.avg(act) * 12 / error)).alias("information"),
        (mean_of(m, b > 0) / F.nullif(mean_of(b, b > 0), F.lit(0.0))).alias("up_capture"), (mean_of(m, b < 0) / F.nullif(mean_of(b, b < 0), F.lit(0.0))).alias("down_capture"),
    )
    z = F.col("_sr") * F.sqrt(F.col("_n") - 1) / F.sqrt(1 - F.col("skew") * F.col("_sr") + (F.col("kurtosis") - 1) / 4 * F.col("_sr") * F.col("_sr"))
    return daily.join(monthly.withColumn("psr", phi(z)).drop("_sr", "_n"), "series_id")


def stock_stats(returns: DataFrame, bench: DataFrame, rf: float = 0.0, unbounded: bool = False) -> DataFrame:
    """The stock report's figures of (series_id, date, ret) against (date, ret) of a benchmark; ``rf`` is a yearly rate spread evenly.

    Drawdowns are from the highest wealth of the record itself; the longest is in calendar days from the first day under the peak to the
    first day at one again, or to the end. Missing benchmark days count as 0. Records of under two days or without movement are left out.
    """
    r, x = F.col("ret"), F.col("ret") - rf / YEAR
    days = _falls(returns.join(bench.select("date", F.col("ret").alias("_b")), "date", "left").withColumn("_b", F.coalesce("_b", F.lit(0.0))))
    end = days.groupBy("series_id").agg(F.max("date").alias("_end"), F.percentile("ret", F.lit(0.05)).alias("var95"))
    # a fall begins on its first day under the peak and ends where the next count of peaks begins
    runs = days.where("_dd < 0").groupBy("series_id", "_k").agg(F.min("date").alias("a"))
    tops = days.where("_dd >= 0").select("series_id", (F.col("_k") - 1).alias("_k"), F.col("date").alias("z"))
    longest = runs.join(tops, ["series_id", "_k"], "left").join(end.drop("var95"), "series_id").groupBy("series_id").agg(F.max(F.datediff(F.coalesce("z", "_end"), "a")).alias("longest_days"))
    down = F.sqrt(F.avg(F.pow(F.least(x, F.lit(0.0)), F.lit(2)))) * ROOT
    act, beta = F.col("ret") - F.col("_b"), F.covar_samp("ret", "_b") / F.nullif(F.var_samp("_b"), F.lit(0.0))
    daily = days.join(end.drop("_end"), "series_id").groupBy("series_id").agg(
        F.count("*").alias("_n"), (F.product(1 + r) - 1).alias("total_return"), (F.pow(F.product(1 + r), F.lit(float(YEAR)) / F.count("*")) - 1).alias("cagr"), (F.stddev_samp(r) * ROOT).alias("volatility"), (F.avg(x) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * ROOT).alias("sharpe"),
        over(F.avg(x) * YEAR, down, unbounded).alias("sortino"), F.min("_dd").alias("max_drawdown"), F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))).alias("ulcer"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess_kurtosis"), F.first("var95").alias("var95"), F.avg(F.when(r <= F.col("var95"), r)).alias("cvar95"),
        beta.alias("beta"), ((F.avg(r) - beta * F.avg("_b")) * YEAR).alias("alpha"), safe_corr("ret", "_b").alias("correlation"), (F.stddev_samp(act) * ROOT).alias("tracking_error"), (over(F.avg(act), F.stddev_samp(act), unbounded) * ROOT).alias("information"),
    ).where((F.col("_n") >= 2) & (F.col("volatility") > 0)).drop("_n")
    month = returns.groupBy("series_id", F.trunc("date", "month").alias("_m")).agg((F.product(1 + r) - 1).alias("m")).groupBy("series_id").agg(F.max("m").alias("best_month"), F.min("m").alias("worst_month"), F.avg((F.col("m") > 0).cast("double")).alias("positive_months"))
    out = daily.join(month, "series_id").join(longest, "series_id", "left").withColumn("longest_days", F.coalesce("longest_days", F.lit(0)))
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")))
