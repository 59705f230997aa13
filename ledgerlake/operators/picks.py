"""Stock selection panels: share counts and market values as they were known, trend filters, entry candidates and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import asof_backward, by, last_rows


def shares_history(cover: DataFrame, diluted: DataFrame) -> DataFrame:
    """(cik, end, filed, shares): the sum of a filing's different cover-page counts, or where it has none its diluted shares.

    ``cover``: (cik, accn, end, filed, value), a row for each class of shares; ``diluted``: (cik, end, filed, value)."""
    own = cover.dropDuplicates(["cik", "accn", "end", "value"]).groupBy("cik", "end", "filed").agg(F.sum("value").alias("shares"))
    rest = diluted.join(own, ["cik", "end", "filed"], "left_anti").select("cik", "end", "filed", F.col("value").alias("shares"))
    return own.unionByName(rest)


def pit_market_cap(prices: DataFrame, shares: DataFrame, splits: DataFrame, max_age: int = 400) -> DataFrame:
    """(symbol, date, market_cap): close times the last share count filed before the day, restated by the splits after its own date.

    ``prices`` are split-adjusted closes; ``shares``: (symbol, end, filed, shares); ``splits``: (symbol, ex, ratio). Counts over
    ``max_age`` days old are unknown."""
    s, x = shares.alias("s"), F.broadcast(splits).alias("x")
    restated = s.join(x, F.expr("x.symbol = s.symbol and x.ex > s.end"), "left").groupBy("s.symbol", "s.end", "s.filed", "s.shares").agg(F.coalesce(F.product("ratio"), F.lit(1.0)).alias("f"))
    known = restated.select("symbol", F.col("filed").alias("date"), F.col("end").alias("e"), (F.col("shares") * F.col("f")).alias("n"))
    at = asof_backward(prices, known, ["symbol"], ["e", "n"], strict=True)
    fresh = F.datediff("date", "e") <= max_age
    return at.select("symbol", "date", F.when(fresh, F.col("close") * F.col("n")).alias("market_cap"))


def market_filter(bench: DataFrame, n: int = 200, share: float = 0.95) -> DataFrame:
    """(date, ok): the benchmark's close is at or over its mean of ``n`` days, or the mean is not known yet; with ``share`` of the days."""
    w = last_rows(Window.partitionBy(F.lit(0)).orderBy("date"), n)  # one row a day
    mean = F.when(F.count("close").over(w) >= max(1, int(n * share)), F.avg("close").over(w))
    return bench.select("date", F.coalesce(F.col("close") >= mean, F.lit(True)).alias("ok"))


def with_trends(prices: DataFrame, fast: int, slow: int, share: float = 0.95) -> DataFrame:
    """``prices`` with means of ``fast`` and ``slow`` days, where ``share`` of the days are there."""
    w = by("symbol")
    mean = lambda n: F.when(F.count("close").over(last_rows(w, n)) >= max(1, int(n * share)), F.avg("close").over(last_rows(w, n)))
    return prices.withColumn("fast", mean(fast)).withColumn("slow", mean(slow))


def entry_candidates(panel: DataFrame, least: int, excluded: list[str]) -> DataFrame:
    """Rows of (symbol, date, close, fast, slow, member, fscore, market_cap, sector) that may be entered: a member whose price is under
    its slow and over its fast mean, with a score of ``least`` or more, a market value and an allowed sector."""
    c = F.col
    ok = c("member") & (c("close") < c("slow")) & (c("close") > c("fast")) & (c("fscore") >= least) & (c("market_cap") > 0)
    return panel.where(ok & ~F.coalesce("sector", F.lit("Unknown")).isin(*excluded))


def coverage_report(panel: DataFrame, least: int, excluded: list[str]) -> DataFrame:
    """(year, members, scored, passing, candidates): the mean daily count of stocks that pass each filter, by year."""
    c = F.col
    seen = c("member") & c("close").isNotNull()
    enter = seen & (c("close") < c("slow")) & (c("close") > c("fast")) & (c("fscore") >= least) & (c("market_cap") > 0) & ~F.coalesce("sector", F.lit("Unknown")).isin(*excluded)
    count = lambda when: F.sum(F.coalesce(when, F.lit(False)).cast("long"))
    day = panel.groupBy("date").agg(count(seen).alias("members"), count(seen & c("fscore").isNotNull()).alias("scored"), count(seen & (c("fscore") >= least)).alias("passing"), count(enter).alias("candidates"))
    return day.groupBy(F.year("date").alias("year")).agg(*(F.avg(k).alias(k) for k in ("members", "scored", "passing", "candidates")))
