"""Macro regime forecasts refitted through time: training schemes, sensitivities, bands of the live signal, breaks.

A variant is a row of settings: (variant, lookback, horizon, window, half_life). All variants and refit months are one plan: designs and
labels are made once for each look-back and horizon, joined to the variants, and each fit is a group of its own rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi_square_tail
from .engines import regime_engine, signed_logit
from .macro import classify_phase, contraction_flag, event_ahead, labels_as_of, macro_features
from .metrics import cagr_of, drawdown, sharpe_of
from .signals import shift_known, stepped

#: Inputs of the forecast and the signs that their coefficients keep (0: free), fixed values.
SIGNS = {"ur_trend": 1, "ur_gap": 1, "ur_off_high": 1, "ur_pos": 0, "ff_trend": -1, "ff_pos": 1, "ff_off_peak": -1, "is_peak": 1, "is_recession": 1, "is_recovery": -1}
INPUTS = list(SIGNS)
#: Inverse strength of the penalty, and the deviations that inputs are clipped at.
C, CLIP = 0.5, 3.0


def design(panel: DataFrame, lookback: int = 30, lag: int = 1) -> DataFrame:
    """(month, INPUTS): the features of each month and its phase as 0 or 1, ``lag`` months later, when they are known."""
    x = classify_phase(macro_features(panel, lookback))
    for name in ("Peak", "Recession", "Recovery"):
        x = x.withColumn(f"is_{name.lower()}", (F.col("phase") == name).cast("double"))
    return shift_known(x.select("month", *INPUTS), lag)


def standardised(rows: pd.DataFrame, by: pd.DataFrame, weights: np.ndarray) -> np.ndarray:
    """The inputs in deviations of ``by`` (population, weighted), clipped."""
    ref = by[INPUTS].to_numpy(float)
    mean = np.average(ref, axis=0, weights=weights)
    sd = np.sqrt(np.average((ref - mean) ** 2, axis=0, weights=weights))
    return np.clip((rows[INPUTS].to_numpy(float) - mean) / np.where(sd > 0, sd, 1), -CLIP, CLIP)


def fit(rows: pd.DataFrame, weights: np.ndarray, scale: pd.DataFrame | None = None, c: float = C) -> np.ndarray:
    """Intercept and coefficients of the forecast from ``rows`` (INPUTS, y); weights have a mean of 1."""
    weights = weights / weights.mean()
    x = standardised(rows, rows if scale is None else scale, weights if scale is None else np.ones(len(scale)))
    return signed_logit(x, rows["y"].to_numpy(float), np.array(list(SIGNS.values())), 1 / (c * len(rows)), weights)


def forecast(rows: pd.DataFrame, by: pd.DataFrame, weights: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(w[0] + standardised(rows, by, weights / weights.mean()) @ w[1:])))


def training_sets(panel: DataFrame, variants: DataFrame, start: str, every: int = 12, embargo: int = 12, lag: int = 1) -> DataFrame:
    """(variant, asof, month, INPUTS, y, weight): for each variant and refit month the rows to learn from (y, weight) and, with null y,
    those to forecast until the next refit. ``variants``: (variant, lookback, horizon, window, half_life), nulls for all and none."""
    settings = variants.select("lookback", "horizon").distinct().collect()  # a short list of settings
    designs = None
    for n in sorted({r.lookback for r in settings}):
        one = design(panel, n, lag).withColumn("lookback", F.lit(n))
        designs = one if designs is None else designs.union(one)
    w = Window.partitionBy("lookback").orderBy("month")
    block = designs.where(F.col("month") >= F.lit(start).cast("date")).withColumn("_i", F.row_number().over(w) - 1)
    block = block.withColumn("asof", F.first("month").over(Window.partitionBy("lookback", F.floor(F.col("_i") / every)).orderBy("month"))).drop("_i")
    refits = block.select("asof").distinct()
    labels = None
    for h in sorted({r.horizon for r in settings}):
        one = labels_as_of(panel, refits, h, embargo, lag).withColumn("horizon", F.lit(h))
        labels = one if labels is None else labels.union(one)
    v = F.broadcast(variants)  # a short list of settings
    age = F.round(F.months_between("asof", "month")).cast("int")
    own = block.select("lookback", "asof").distinct()
    learn = designs.join(labels, "month").join(own, ["lookback", "asof"]).join(v, ["lookback", "horizon"]).where(F.col("window").isNull() | (age < F.col("window")))
    weight = F.when(F.col("half_life").isNotNull(), F.pow(F.lit(0.5), age / F.col("half_life"))).otherwise(1.0)
    learn = learn.select("variant", "asof", "month", *INPUTS, F.col("y").cast("double").alias("y"), weight.alias("weight"))
    ahead = block.join(v, "lookback").select("variant", "asof", "month", *INPUTS, F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("weight"))
    return learn.union(ahead)


def walk_forward(sets: DataFrame, least: int = 120) -> DataFrame:
    """(variant, asof, month, p): forecasts of each refit of ``training_sets``; refits of under ``least`` rows or of one class give none."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        past, now = rows[rows["y"].notna()].sort_values("month"), rows[rows["y"].isna()]
        out = pd.DataFrame({"variant": now["variant"], "asof": now["asof"], "month": now["month"], "p": np.nan})
        if len(past) < least or past["y"].nunique() < 2:
            return out.iloc[:0]
        weights = past["weight"].to_numpy(float)
        return out.assign(p=forecast(now, past, weights, fit(past, weights)))

    return sets.groupBy("variant", "asof").applyInPandas(run, "variant string, asof date, month date, p double")


def outcomes(panel: DataFrame, horizon: int) -> DataFrame:
    """(month, y): what came, with hindsight, to judge forecasts by."""
    return event_ahead(contraction_flag(panel), horizon)


def judged(forecasts: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, months, brier, auc) of forecasts (keys, month, p) against (month, y); no auc where one class is missing."""
    x = forecasts.join(truth.where("y is not null"), "month").withColumn("y", F.col("y").cast("int"))
    w = Window.partitionBy(*keys)
    ranked = x.withColumn("_r", F.rank().over(w.orderBy("p")) + (F.count("*").over(Window.partitionBy(*keys, "p")) - 1) / 2)
    n1, n0 = F.sum("y"), F.sum(1 - F.col("y"))
    auc = (F.sum(F.when(F.col("y") == 1, F.col("_r"))) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0))
    return ranked.groupBy(*keys).agg(F.count("*").alias("months"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), auc.alias("auc"))


def traded(forecasts: DataFrame, returns: DataFrame, rules: dict, bps: float = 5.0, lag: int = 1) -> DataFrame:
    """(variant, rule, days, sharpe, cagr, max_drawdown): each rule's account under each variant's forecasts. ``rules`` maps a name to a function
    from a stepped confidence to a weight; it is traded ``lag`` days after the last day of the month. ``returns``: (date, ret, cash)."""
    confidence = forecasts.select("variant", "month", stepped(1 - F.col("p")).alias("c"))
    weights = confidence.select("variant", "month", F.explode(F.create_map(*(x for name, rule in rules.items() for x in (F.lit(name), rule(F.col("c")).cast("double"))))).alias("rule", "weight"))
    days = returns.select("date", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).alias("i"))  # one calendar
    last = days.groupBy(F.trunc("date", "month").alias("month")).agg((F.max("i") + lag).alias("i")).join(days, "i").select("month", "date")
    decisions = weights.join(last, "month").select(F.concat_ws("|", "variant", "rule").alias("config"), "date", "weight")
    x = regime_engine(returns, decisions, bps).join(returns.select("date", "cash"), "date")
    dd = drawdown(x.withColumnRenamed("config", "series_id"))
    out = dd.groupBy("series_id").agg(F.count("*").alias("days"), sharpe_of(F.col("ret") - F.col("cash")).alias("sharpe"), cagr_of(F.col("ret")).alias("cagr"), F.min("drawdown").alias("max_drawdown"))
    return out.select(F.substring_index("series_id", "|", 1).alias("variant"), F.substring_index("series_id", "|", -1).alias("rule"), "days", "sharpe", "cagr", "max_drawdown")


def latest_set(sets: DataFrame, design_: DataFrame, path: int) -> DataFrame:
    """One row: the training rows (``past``) of the last refit of ``sets`` and the last ``path`` months of the design (``now``), as arrays."""
    row = F.struct("month", *INPUTS, "y", "weight")
    past = sets.where("y is not null").agg(F.sort_array(F.collect_list(row)).alias("past"))
    last = design_.orderBy(F.desc("month")).limit(path).agg(F.sort_array(F.collect_list(F.struct("month", *INPUTS))).alias("now"))
    return past.join(last)  # one row each


def live_band(sets: DataFrame, design_: DataFrame, draws: int = 300, block: int = 24, path: int = 30, seed: int = 42, levels: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """(month, confidence, low, high, draws): the live signal over the last ``path`` months with bootstrap bands.

    ``sets`` are the training rows of one refit. Each draw refits on blocks of months of that history; draws of one class are drawn anew. A
    draw's seed is its number, so a lost task draws the same again. The history is one row of arrays, sent to the draws' tasks once each.
    """
    spark = sets.sparkSession
    parts = spark.sparkContext.defaultParallelism
    one = latest_set(sets, design_, path)
    numbers = spark.range(-1, draws, 1, parts).select(F.col("id").alias("draw"), F.spark_partition_id().alias("part"))
    chunks = numbers.groupBy("part").agg(F.sort_array(F.collect_list("draw")).alias("draws")).join(F.broadcast(one))  # one row

    def run(batches):
        for chunk in batches:
            for _, r in chunk.iterrows():
                past, now = pd.DataFrame(list(r["past"])), pd.DataFrame(list(r["now"]))
                weights = past["weight"].to_numpy(float)
                for draw in r["draws"]:
                    rows, w = past, weights
                    if draw >= 0:
                        ix = block_rows(past["y"].to_numpy(), block, seed, int(draw))
                        rows, w = past.iloc[ix], weights[ix]
                    p = forecast(now, rows, w, fit(rows, w))
                    yield pd.DataFrame({"draw": draw, "month": now["month"], "confidence": 1 - p})

    x = chunks.mapInPandas(run, "draw long, month date, confidence double")
    low, high = (F.percentile(F.when(F.col("draw") >= 0, F.col("confidence")), F.lit(q)) for q in levels)
    return x.groupBy("month").agg(F.max(F.when(F.col("draw") < 0, F.col("confidence"))).alias("confidence"), low.alias("low"), high.alias("high"), F.sum((F.col("draw") >= 0).cast("int")).alias("draws"))


def block_rows(y: np.ndarray, block: int, seed: int, draw: int) -> np.ndarray:
    """Rows of one draw: blocks in a row that do not run past the end, drawn until both classes are there."""
    rng, n = np.random.default_rng([seed, draw]), len(y)
    size = min(block, n)
    while True:
        ix = (rng.integers(0, n - size + 1, -(-n // size))[:, None] + np.arange(size)).ravel()[:n]
        if len(np.unique(y[ix])) == 2:
            return ix


def structural_break(sets: DataFrame, split: str, horizon: int = 6, c: float = 1e3) -> DataFrame:
    """(statistic, freedom, p, adjusted, adjusted_p): whether one forecast fits both sides of the month ``split`` as well as two.

    Twice the gain of two fits over one, on a coefficient each, all in the deviations of the whole history; and the same divided by the
    ``horizon`` that neighbouring labels share. ``sets``: the training rows of one refit. No row where a side has one class.
    """
    rows = sets.where("y is not null").withColumn("late", F.col("month") >= F.lit(split).cast("date"))
    sides = rows.withColumn("part", F.explode(F.array(F.lit("pooled"), F.when(F.col("late"), F.lit("after")).otherwise("before"))))
    scale = rows.agg(F.sort_array(F.collect_list(F.struct("month", *INPUTS))).alias("scale"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("month")
        all_ = pd.DataFrame(list(part["scale"].iloc[0]))
        y = part["y"].to_numpy(float)
        if len(set(y)) < 2:
            return pd.DataFrame({"part": part["part"].iloc[:1], "likelihood": np.nan})
        w = fit(part, np.ones(len(part)), all_, c)
        p = np.clip(forecast(part, all_, np.ones(len(all_)), w), 1e-9, 1 - 1e-9)
        return pd.DataFrame({"part": part["part"].iloc[:1], "likelihood": float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())})

    # a history of months: it fits a task, and so does each of its sides
    got = sides.join(F.broadcast(scale)).groupBy("part").applyInPandas(run, "part string, likelihood double")
    gain = got.agg((2 * F.sum(F.col("likelihood") * F.when(F.col("part") == "pooled", -1).otherwise(1))).alias("statistic"), F.count(F.nanvl("likelihood", F.lit(None).cast("double"))).alias("n"))
    freedom = len(INPUTS) + 1
    s = F.col("statistic")
    return gain.where("n = 3").select("statistic", F.lit(freedom).alias("freedom"), chi_square_tail(s, freedom).alias("p"), (s / horizon).alias("adjusted"), chi_square_tail(s / horizon, freedom).alias("adjusted_p"))
