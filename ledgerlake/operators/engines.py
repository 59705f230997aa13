"""Backtest engines: period decisions as windows; cash-coupled daily loops as one grouped function for each configuration."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import asof_backward, by, running


def regime_engine(returns: DataFrame, decisions: DataFrame, bps: float) -> DataFrame:
    """(config, date, weight, ret): the risky share drifts between fills; each fill trades to the decided weight at a cost.

    ``returns`` is (date, ret, cash); ``decisions`` is (config, date, weight) with the fill dates. A day belongs to the last fill
    before it, so within a period holdings are running products.
    """
    configs = decisions.select("config").distinct()
    days = returns.join(F.broadcast(configs))
    fills = decisions.select("config", "date", F.col("date").alias("fill"), "weight")
    x = asof_backward(days, fills, ["config"], ["fill", "weight"], strict=True).where("fill is not null")
    w = by("config", "fill")
    x = x.withColumn("risky", F.col("weight") * F.product(1 + F.col("ret")).over(running(w))).withColumn("safe", (1 - F.col("weight")) * F.product(1 + F.col("cash")).over(running(w)))
    before = F.coalesce(F.lag(F.col("risky") + F.col("safe")).over(w), F.lit(1.0))
    gross = x.withColumn("gross", (F.col("risky") + F.col("safe")) / before - 1).withColumn("drifted", F.col("risky") / (F.col("risky") + F.col("safe")))
    old = F.coalesce(F.lag("drifted").over(by("config")), F.lit(0.0))
    first = F.row_number().over(w) == 1
    turnover = F.when(first, F.abs(F.col("weight") - old)).otherwise(0.0)
    return gross.select("config", "date", F.col("drifted").alias("weight"), turnover.alias("turnover"), (F.col("gross") - turnover * bps / 1e4).alias("ret"))


def signed_logit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, l2: float, weights: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """(intercept, coefficients) of an L2 logistic regression whose coefficients keep the given signs (0: free).

    Mean loss, weighted if ``weights`` are given, plus l2 / 2 times the squared coefficients. Newton steps; each solves its quadratic
    under the signs by coordinate descent, and is halved until the loss falls.
    """
    n = len(y)
    z, s = np.column_stack([np.ones(n), x]), np.full(n, 1 / n) if weights is None else weights / weights.sum()
    penalty, sign = np.concatenate([[0.0], np.full(x.shape[1], l2)]), np.concatenate([[0], signs])
    loss = lambda w: float(s @ (np.logaddexp(0, z @ w) - y * (z @ w)) + 0.5 * (penalty * w * w).sum())
    w = np.zeros(z.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        g = z.T @ (s * (p - y)) + penalty * w
        h = (z * (s * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty + 1e-12)
        v = w.copy()
        for _ in range(200):
            old = v.copy()
            for j in range(len(v)):
                v[j] -= (g[j] + h[j] @ (v - w)) / h[j, j]
                if sign[j] * v[j] < 0:
                    v[j] = 0.0
            if np.abs(v - old).max() < 1e-12:
                break
        size = 1.0
        while size > 1e-6 and loss(w + size * (v - w)) > now:
            size /= 2
        w = w + size * (v - w)
        before, now = now, loss(w)
        if before - now < 1e-15:
            break
    return w


def purged_splits(n: int, folds: int, tests: int, purge: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(train, test) rows of combinatorial cross-validation: training rows within ``purge`` of a test fold are left out."""
    from itertools import combinations

    edges = np.linspace(0, n, folds + 1).astype(int)
    out = []
    for chosen in combinations(range(folds), tests):
        test = np.zeros(n, bool)
        near = np.zeros(n, bool)
        for f in chosen:
            test[edges[f] : edges[f + 1]] = True
            near[max(0, edges[f] - purge) : edges[f + 1] + purge] = True
        out.append((np.flatnonzero(~near), np.flatnonzero(test)))
    return out


def cpcv(returns: DataFrame, methods: list[str], folds: int = 10, tests: int = 2, purge: int = 5, embargo: int = 5, cap: float = 1.0, rf: float = 0.0, extra: dict | None = None) -> DataFrame:
    """(method, history, sharpe, max_drawdown): combinatorial purged cross-validation.

    Every ``tests`` of the folds are test days once; weights are fitted on the others without ``purge`` days on either side of a test
    fold and ``embargo`` more after it. Each fold is tested in as many splits as there are histories; history k strings together the
    k-th test of every fold. The days of a few series are one row of arrays, which each split's task gets once.
    """
    from .allocation import YEAR, day_vectors, weights_of

    chosen = list(itertools.combinations(range(folds), tests))
    number = {(s, f): sum(f in c for c in chosen[:s]) for s, c in enumerate(chosen) for f in c}
    whole = day_vectors(returns.withColumn("_all", F.lit(0)), "_all").groupBy("_all", "names").agg(F.sort_array(F.collect_list(F.struct("date", "r"))).alias("days"))
    splits = whole.select("names", "days", F.explode(F.sequence(F.lit(0), F.lit(len(chosen) - 1))).alias("split")).repartition(len(chosen), "split")

    def run(batches):
        for batch in batches:
            for _, row in batch.iterrows():
                split, names = int(row["split"]), list(row["names"])
                dates, r = [x["date"] for x in row["days"]], np.array([x["r"] for x in row["days"]])
                own = {k: np.array([v.get(c, 0.0) for c in names]) if isinstance(v, dict) else v for k, v in (extra or {}).items()}
                edges, train = np.linspace(0, len(r), folds + 1).astype(int), np.ones(len(r), bool)
                for f in chosen[split]:
                    train[max(0, edges[f] - purge) : edges[f + 1] + purge + embargo] = False
                for m in methods:
                    w = weights_of(m, r[train], 0.0, cap, rf, own)
                    for f in chosen[split]:
                        yield pd.DataFrame({"method": m, "history": number[split, f], "date": dates[edges[f] : edges[f + 1]], "ret": r[edges[f] : edges[f + 1]] @ w})

    days = splits.mapInPandas(run, "method string, history int, date date, ret double")
    w = Window.partitionBy("method", "history").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = days.withColumn("w", F.product(1 + F.col("ret")).over(w))
    x = x.withColumn("dd", F.col("w") / F.greatest(F.max("w").over(w), F.lit(1.0)) - 1)
    return x.groupBy("method", "history").agg((F.avg(F.col("ret") - rf / YEAR) / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * YEAR**0.5).alias("sharpe"), F.min("dd").alias("max_drawdown"))


def cpcv_summary(histories: DataFrame, against: str = "target") -> DataFrame:
    """(method, histories, median, low, high, worst_drawdown, beats): Sharpe ratios over the histories, and the share in which a method does better
    than the method ``against``."""
    base = histories.where(F.col("method") == against).select("history", F.col("sharpe").alias("_base"))
    q = lambda p: F.percentile("sharpe", F.lit(p))
    return histories.join(base, "history", "left").groupBy("method").agg(F.count("*").alias("histories"), q(0.5).alias("median"), q(0.1).alias("low"), q(0.9).alias("high"), F.min("max_drawdown").alias("worst_drawdown"), F.avg((F.col("sharpe") > F.col("_base")).cast("double")).alias("beats"))
