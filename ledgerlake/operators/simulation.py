"""Block bootstraps of whole histories, statistics of simulated paths, and live-against-expected comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import YEAR, safe_beta, safe_corr
from .timeseries import by, running


#: Paths of a series that one row's task makes in a row.
CHUNK = 64


def uniform(*key: Column | str | int) -> Column:
    """A number from 0 up to 1 of a key: the first 13 hexadecimal digits of the md5 of its parts, joined by bars. Keys that differ give
    unrelated numbers, nothing is stored or sent, a lost task draws the same again, and SQL can repeat it."""
    parts = [(F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def histories(returns: DataFrame, value: str = "ret") -> DataFrame:
    """(series_id, n, h): the values of each series as one array in order of dates. A series is a record of days."""
    rows = F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v"))))
    return returns.groupBy("series_id").agg(F.count("*").cast("int").alias("n"), F.transform(rows, lambda x: x["v"]).alias("h"))


def draw_paths(series: DataFrame, horizon: Column | int, paths: int, block: int, seed: int = 7, least: int = 20) -> DataFrame:
    """``series`` (series_id, n, h, ...) with (path, x): ``paths`` resamples of each history, ``horizon`` long, of circular blocks from
    independent uniform starts over its own n values. Histories under ``least`` values and horizons under 1 give none.

    A path is one row, so its figures need neither a sort nor an exchange.
    """
    horizon = F.lit(horizon) if isinstance(horizon, int) else horizon
    x = series.withColumn("_horizon", horizon.cast("int")).where((F.col("n") >= least) & (F.col("_horizon") >= 1))
    x = x.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(CHUNK))))
    # a few histories make many paths: chunks of them are dealt out before they are made
    x = x.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series_id", "_chunk")
    x = x.withColumn("_block", F.least(F.lit(block), F.col("n"))).withColumn("_twice", F.concat("h", "h")).drop("h")
    x = x.withColumn("path", F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + CHUNK, F.lit(paths)) - 1)))
    start = lambda k: F.floor(uniform("series_id", "path", k, seed) * F.col("n")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.col("_horizon") / F.col("_block")).cast("int") - 1), lambda k: F.slice("_twice", start(k) + 1, F.col("_block")))
    return x.withColumn("x", F.slice(F.flatten(blocks), F.lit(1), F.col("_horizon"))).drop("_horizon", "_block", "_twice", "_chunk")


def day_indices(spark: SparkSession, n: int, horizon: int, paths: int, block: int, seed: int = 7) -> DataFrame:
    """(path, step, i): what ``draw_paths`` draws, as numbers of n days that several series share, so that their days stay together."""
    size = max(1, min(block, n))
    x = spark.range(paths * -(-horizon // size)).select((F.col("id") / -(-horizon // size)).cast("long").alias("path"), (F.col("id") % -(-horizon // size)).alias("k"))
    x = x.withColumn("start", F.floor(uniform("path", "k", seed) * n)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return x.select("path", (F.col("k") * size + F.col("j")).alias("step"), ((F.col("start") + F.col("j")) % n).alias("i")).where(F.col("step") < horizon)


def numbered(returns: DataFrame) -> DataFrame:
    return returns.select("series_id", "date", (F.row_number().over(by("series_id")) - 1).cast("int").alias("i"), "ret")


def path_stats(paths: DataFrame, rates: Column | None = None, floor: Column | float = 0.0) -> DataFrame:
    """(series_id, path, total, volatility, sharpe, max_drawdown, last_drawdown, positive) of paths (series_id, path, x) of excess returns.

    ``rates``: the rate that each step adds, as an array. The Sharpe ratio is of the excess, over the larger of its deviation and
    ``floor``; the other figures are of excess and rate together. One pass over a path's array.
    """
    floor = F.lit(float(floor)) if isinstance(floor, (int, float)) else floor
    pair = lambda a, b: F.struct(a.alias("e"), b.alias("r"))
    both = F.transform("x", lambda a: pair(a, a)) if rates is None else F.zip_with("x", rates, lambda a, b: pair(a, a + b))
    names = ("w", "peak", "low", "up", "e1", "e2", "r1", "r2")
    start = F.struct(*(F.lit(1.0 if k in ("w", "peak") else 0.0).alias(k) for k in names))

    def step(a: Column, v: Column) -> Column:
        e, r = v["e"], v["r"]
        w = a["w"] * (1 + r)
        peak = F.greatest(a["peak"], w)
        values = (w, peak, F.least(a["low"], w / peak - 1), a["up"] + (r > 0).cast("double"), a["e1"] + e, a["e2"] + e * e, a["r1"] + r, a["r2"] + r * r)
        return F.struct(*(v.alias(k) for k, v in zip(names, values, strict=True)))

    y = paths.select("series_id", "path", F.size("x").alias("_n"), floor.alias("_floor"), F.aggregate(both, start, step).alias("_a"))
    n = F.col("_n")
    sd = lambda k: F.when(n > 1, F.sqrt(F.greatest(F.col(f"_a.{k}2") - F.col(f"_a.{k}1") * F.col(f"_a.{k}1") / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))))
    return y.select(
        "series_id", "path", (F.col("_a.w") - 1).alias("total"), (sd("r") * YEAR**0.5).alias("volatility"), (F.col("_a.e1") / n / F.nullif(F.greatest(sd("e"), "_floor"), F.lit(0.0)) * YEAR**0.5).alias("sharpe"),
        F.col("_a.low").alias("max_drawdown"), (F.col("_a.w") / F.col("_a.peak") - 1).alias("last_drawdown"), (F.col("_a.up") / n).alias("positive"),
    )


def steps(paths: DataFrame, rates: Column | None = None, keep: list[str] = ()) -> DataFrame:
    """(series_id, path, step, ret) of paths of arrays, and the columns ``keep``."""
    x = F.col("x") if rates is None else F.zip_with("x", rates, lambda a, b: a + b)
    return paths.select("series_id", "path", *keep, F.posexplode(x).alias("step", "ret"))


def cone(paths: DataFrame, rates: Column | None = None, start: Column | float = 1.0, levels: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(series_id, step, quantiles) of wealth at each step, ``start`` before the first."""
    start = F.lit(float(start)) if isinstance(start, (int, float)) else start
    wealth = steps(paths.withColumn("_start", start), rates, ["_start"]).withColumn("w", F.col("_start") * F.product(1 + F.col("ret")).over(running(by("series_id", "path", order="step"))))
    q = F.percentile("w", F.array(*map(F.lit, levels)))
    return wealth.groupBy("series_id", "step").agg(q.alias("q")).select("series_id", "step", *(F.col("q")[k].alias(f"p{round(100 * x):02d}") for k, x in enumerate(levels)))


def forward_risk(stats: DataFrame) -> DataFrame:
    """The chance of a loss, the median and the worst of returns and drawdowns over the paths."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return stats.groupBy("series_id").agg(
        F.avg((F.col("total") < 0).cast("double")).alias("p_loss"), q("total", 0.5).alias("median"), q("total", 0.05).alias("p05"),
        q("max_drawdown", 0.5).alias("dd50"), q("max_drawdown", 0.05).alias("dd05"), q("max_drawdown", 0.01).alias("dd01"),
    )


def percentile_of(stats: DataFrame, live: DataFrame, value: str) -> DataFrame:
    """The mid-rank percentile of each live figure among the simulated ones."""
    both = stats.select("series_id", F.col(value).alias("sim")).join(F.broadcast(live.select("series_id", F.col(value).alias("live"))), "series_id")
    return both.groupBy("series_id").agg(F.avg((F.col("sim") < F.col("live")).cast("double") + 0.5 * (F.col("sim") == F.col("live")).cast("double")).alias("percentile"))


def tracking(live: DataFrame, model: DataFrame, least: int = 5) -> DataFrame:
    """Shortfall, tracking error, correlation and beta of live against model returns on common dates."""
    both = live.join(model.select("series_id", "date", F.col("ret").alias("model")), ["series_id", "date"])
    diff = F.col("ret") - F.col("model")
    return both.groupBy("series_id").agg(
        F.count("*").alias("n"), (F.product(1 + F.col("ret")) - F.product(1 + F.col("model"))).alias("shortfall"), (F.stddev_samp(diff) * F.sqrt(F.lit(float(YEAR)))).alias("tracking_error"),
        safe_corr("ret", "model").alias("corr"), safe_beta("ret", "model").alias("beta"),
    ).where(F.col("n") >= least)


def circular_shift(returns: DataFrame, positions: DataFrame, shifts: DataFrame) -> DataFrame:
    """Mean return of positions (series_id, i, position) rotated by each shift: a join on (i + shift) mod n, never on all pairs."""
    n = returns.groupBy("series_id").agg(F.count("*").alias("n"))
    moved = positions.join(F.broadcast(n), "series_id").join(F.broadcast(shifts)).select("series_id", "shift", ((F.col("i") + F.col("shift")) % F.col("n")).alias("i"), "position")
    return moved.join(returns, ["series_id", "i"]).groupBy("series_id", "shift").agg(F.avg(F.col("position") * F.col("ret")).alias("mean"))


def block_sums(returns: DataFrame, configs: str, blocks: int) -> DataFrame:
    """(config, block, n, s1, s2): sums of returns and squares in equal blocks; the rows left over at the head are dropped."""
    w = Window.partitionBy(configs)
    i = F.row_number().over(w.orderBy("date")) - 1
    n = F.count("*").over(w)
    size = F.floor(n / blocks)
    placed = returns.withColumn("b", F.floor((i - n % blocks) / size).cast("int")).where("b >= 0")
    return placed.groupBy(configs, "b").agg(F.count("*").alias("n"), F.sum("ret").alias("s1"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))


def pbo_cscv(sums: DataFrame, configs: str, blocks: int) -> DataFrame:
    """(mask, best, logit): for every half of the blocks, the in-sample best and the logit of its out-of-sample rank.

    Only block sums meet the masks: C(blocks, blocks / 2) x configs x blocks rows of a few numbers.
    """
    spark = sums.sparkSession
    masks = spark.range(1 << blocks).select(F.col("id").alias("mask")).where(F.bit_count("mask") == blocks // 2)
    inside = F.expr("getbit(mask, b)") == 1
    part = sums.join(F.broadcast(masks)).groupBy("mask", configs, inside.alias("ins")).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    sd = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")) / (F.col("n") - 1))
    sr = part.select("mask", configs, "ins", (F.col("s1") / F.col("n") / F.nullif(sd, F.lit(0.0))).alias("sr"))
    wide = sr.groupBy("mask", configs).agg(F.max(F.when(F.col("ins"), F.col("sr"))).alias("is_sr"), F.max(F.when(~F.col("ins"), F.col("sr"))).alias("oos_sr"))
    of = Window.partitionBy("mask")
    rank = F.rank().over(of.orderBy("oos_sr")) + (F.count("*").over(Window.partitionBy("mask", "oos_sr")) - 1) / 2
    ranked = wide.withColumn("w", rank / (F.count("*").over(of) + 1)).withColumn("first", F.row_number().over(of.orderBy(F.desc("is_sr"), configs)))
    return ranked.where("first = 1").select("mask", F.col(configs).alias("best"), F.ln(F.col("w") / (1 - F.col("w"))).alias("logit"))
