"""Significance and overfitting: deflated Sharpe ratios, regressions with autocorrelated errors, look-ahead audits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import YEAR, expected_max_sharpe, phi
from .metrics import sharpe_inference, sharpe_of, with_bench
from .rates import with_rf
from .timeseries import by, running


def deflated_sharpe(returns: DataFrame, trials: int) -> DataFrame:
    """Probability that the Sharpe ratio beats the largest expected among ``trials`` without skill, given the spread of the series'
    own ratios."""
    s = sharpe_inference(returns)
    spread = s.agg(F.stddev_samp("sr").alias("spread"))
    unit = expected_max_sharpe(trials, 1.0)
    return s.join(F.broadcast(spread)).select("series_id", (F.col("spread") * unit * YEAR**0.5).alias("hurdle"), phi((F.col("sr") - F.col("spread") * unit) / F.col("se")).alias("dsr"))


def ols_hac(frame: DataFrame, y: str, regressors: list[str], lags: int = 10) -> DataFrame:
    """(series_id, term, coefficient, error, t): least squares with an intercept ("alpha") and Newey-West errors.

    Errors come from the score products x e of each day and those of up to ``lags`` days before, with falling weights, summed in Spark; the
    two small matrices of a series are inverted in a task. Rows that lack a figure are left out. ``frame``: (series_id, date, y, regressors).
    """
    p = len(regressors) + 1
    x = frame.select("series_id", "date", F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *(F.col(c).cast("double").alias(f"_x{i + 1}") for i, c in enumerate(regressors))).na.drop()
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    whole = lambda f: F.array(*(f(min(i, j), max(i, j)) for i in range(p) for j in range(p)))
    sums = x.groupBy("series_id").agg(F.count("*").alias("n"), *(F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"a{i}{j}") for i, j in upper), *(F.sum(F.col(f"_x{i}") * F.col("_y")).alias(f"b{i}") for i in range(p)))
    sums = sums.select("series_id", "n", whole(lambda i, j: F.col(f"a{i}{j}")).alias("a"), F.array(*(f"b{i}" for i in range(p))).alias("b"))

    def solve(batches):
        for rows in batches:
            keep = [np.linalg.cond(np.reshape(a, (p, p))) < 1e14 for a in rows["a"]]
            good = rows[keep]
            yield pd.DataFrame({"series_id": good["series_id"], "w": [np.linalg.solve(np.reshape(a, (p, p)), b).tolist() for a, b in zip(good["a"], good["b"], strict=True)], "a": good["a"]})

    kind = frame.schema["series_id"].dataType.simpleString()
    fit = sums.mapInPandas(solve, f"series_id {kind}, w array<double>, a array<double>")
    e = x.join(fit.select("series_id", "w"), "series_id").withColumn("_e", F.col("_y") - sum((F.col("w")[i] * F.col(f"_x{i}") for i in range(p)), F.lit(0.0)))
    w = by("series_id")
    score = [F.col(f"_x{i}") * F.col("_e") for i in range(p)]
    e = e.select("series_id", "date", *(s.alias(f"_s{i}") for i, s in enumerate(score)))
    for k in range(1, lags + 1):
        e = e.withColumns({f"_s{i}_{k}": F.lag(f"_s{i}", k).over(w) for i in range(p)})

    def long_run(i: int, j: int):
        out = F.sum(F.col(f"_s{i}") * F.col(f"_s{j}"))
        for k in range(1, lags + 1):
            out += (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col(f"_s{i}") * F.col(f"_s{j}_{k}") + F.col(f"_s{j}") * F.col(f"_s{i}_{k}")), F.lit(0.0))
        return out

    middle = e.groupBy("series_id").agg(*(long_run(i, j).alias(f"m{i}{j}") for i, j in upper)).select("series_id", whole(lambda i, j: F.col(f"m{i}{j}")).alias("m"))
    names = ["alpha", *regressors]

    def finish(batches):
        for rows in batches:
            for r in rows.itertuples():
                inv = np.linalg.inv(np.reshape(r.a, (p, p)))
                error = np.sqrt(np.maximum(np.diag(inv @ np.reshape(r.m, (p, p)) @ inv), 0))
                yield pd.DataFrame({"series_id": r.series_id, "term": names, "coefficient": r.w, "error": error, "t": np.array(r.w) / np.where(error > 0, error, np.nan)})

    return fit.join(middle, "series_id").mapInPandas(finish, f"series_id {kind}, term string, coefficient double, error double, t double")


def capm_hac(returns: DataFrame, bench: DataFrame, lags: int = 10) -> DataFrame:
    """(series_id, alpha, alpha_t, beta, beta_t): yearly alpha and beta against the benchmark with Newey-West t-statistics."""
    both = with_bench(returns, bench).select("series_id", "date", "ret", "bench")
    wide = ols_hac(both, "ret", ["bench"], lags).groupBy("series_id").pivot("term", ["alpha", "bench"]).agg(F.first("coefficient").alias("c"), F.first("t").alias("t"))
    return wide.select("series_id", (F.col("alpha_c") * YEAR).alias("alpha"), F.col("alpha_t"), F.col("bench_c").alias("beta"), F.col("bench_t").alias("beta_t"))


def survival_gates(returns: DataFrame, twice_cost: DataFrame, hold: DataFrame, start: str, end: str, rf: DataFrame | float = 0.0) -> DataFrame:
    """Gates of each configuration (series_id, date, ret) within a design window, against buy and hold (date, ret) on the same days.

    g1: Sharpe ratio at least that of buy and hold. g2: a shallower deepest drawdown. g3: positive Sharpe ratios in both halves. g4: g1
    at twice the cost (``twice_cost``, as ``returns``). ``survives``: all of them.
    """
    span = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    middle = F.date_add(lo, F.floor(F.datediff(hi, lo) / 2).cast("int"))
    x = returns.where(span).join(twice_cost.select("series_id", "date", F.col("ret").alias("twice")), ["series_id", "date"]).join(hold.select("date", F.col("ret").alias("hold")), "date")
    w = by("series_id")
    fall = lambda c: F.product(1 + F.col(c)).over(running(w))
    x = with_rf(x, rf).withColumns({"_a": fall("ret"), "_b": fall("hold")})
    depth = lambda c: F.col(c) / F.greatest(F.max(c).over(running(w)), F.lit(1.0)) - 1
    x = x.withColumns({"_a": depth("_a"), "_b": depth("_b")})
    sr = lambda c, when=None: sharpe_of(F.col(c) - F.col("rf") if when is None else F.when(when, F.col(c) - F.col("rf")))
    s = x.groupBy("series_id").agg(
        sr("ret").alias("sharpe"), sr("hold").alias("_hold"), F.min("_a").alias("max_drawdown"), F.min("_b").alias("_fall"), sr("ret", F.col("date") <= middle).alias("first_half"), sr("ret", F.col("date") > middle).alias("second_half"), sr("twice").alias("twice_cost"),
    )
    s = s.withColumns({"g1": F.col("sharpe") >= F.col("_hold"), "g2": F.col("max_drawdown") > F.col("_fall"), "g3": (F.col("first_half") > 0) & (F.col("second_half") > 0), "g4": F.col("twice_cost") >= F.col("_hold")})
    return s.withColumn("survives", F.col("g1") & F.col("g2") & F.col("g3") & F.col("g4")).drop("_hold", "_fall")


def truncation_audit(operator: Callable[[DataFrame], DataFrame], data: DataFrame, cut: str) -> DataFrame:
    """Rows up to the cut that change if the operator does not see what comes after it: empty for an operator without look-ahead."""
    until = F.col("date") <= F.lit(cut).cast("date")
    return operator(data).where(until).exceptAll(operator(data.where(until)))


def engine_causality(engine: Callable[[DataFrame], DataFrame], data: DataFrame, cuts: list[str], keys: list[str], values: list[str], shaken: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(cut, test, rows, differing): whether an engine's results up to each cut change if it does not see what comes after it ("short"),
    or sees garbage there ("shaken"). Both are 0 for an engine without look-ahead; rows counts what was compared.

    ``engine`` maps dated data to dated results with ``keys`` and numeric ``values``; garbage are hashed multiples of the columns ``shaken``.
    The whole run is made once for all cuts.
    """
    whole = engine(data).select(*keys, "date", *values)
    out = None
    for cut in cuts:
        at = F.lit(cut).cast("date")
        noise = lambda c: F.when(F.col("date") > at, F.col(c) * (0.5 + F.pmod(F.xxhash64("date", F.lit(c)), F.lit(1000)) / 500.0)).otherwise(F.col(c)).alias(c)  # noqa: E731, B023
        garbage = data.select(*(noise(c) if c in shaken else F.col(c) for c in data.columns))
        for test, seen in (("short", data.where(F.col("date") <= at)), ("shaken", garbage)):
            a, b = (x.where(F.col("date") <= at).select(*keys, "date", *(F.col(v).cast("double").alias(f"{v}_{k}") for v in values)) for x, k in ((whole, "a"), (engine(seen), "b")))
            same = F.lit(True)
            for v in values:
                x, y = F.col(f"{v}_a"), F.col(f"{v}_b")
                same &= F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x)), x.isNull() & y.isNull())
            met = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*keys, "date"], "full_outer")
            good = F.col("_a").isNotNull() & F.col("_b").isNotNull() & same
            one = met.agg(F.count("*").alias("rows"), F.sum((~good).cast("long")).alias("differing")).select(F.lit(cut).alias("cut"), F.lit(test).alias("test"), "rows", F.coalesce("differing", F.lit(0)).alias("differing"))
            out = one if out is None else out.union(one)
    return out


def walk_forward_efficiency(folds: DataFrame) -> DataFrame:
    """Mean out-of-sample over mean in-sample Sharpe ratio of (config, fold, is_sr, oos_sr)."""
    return folds.groupBy("config").agg((F.avg("oos_sr") / F.nullif(F.avg("is_sr"), F.lit(0.0))).alias("efficiency"))


def rank_table(folds: DataFrame) -> DataFrame:
    """In-sample and out-of-sample ranks of each configuration and their change, by fold."""
    w = Window.partitionBy("fold")
    return folds.select("config", "fold", F.rank().over(w.orderBy(F.desc("is_sr"))).alias("is_rank"), F.rank().over(w.orderBy(F.desc("oos_sr"))).alias("oos_rank"))
