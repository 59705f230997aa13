"""Time-series primitives: running products, islands, as-of joins and look-backs, all partitioned by series.

None needs a global window or a Cartesian product: as-of joins are a union and a running last value, and nearest matches are
bucketed by the tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def running(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(1 - n, Window.currentRow)


def next_rows(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(1, n)


def running_product(value: Column, window: WindowSpec) -> Column:
    return F.product(value).over(running(window))


def full(value: Column, window: WindowSpec, n: int) -> Column:
    """``value`` over the last n rows, null until there are n."""
    frame = last_rows(window, n)
    return F.when(F.count(F.lit(1)).over(frame) == n, value.over(frame))


def islands(df: DataFrame, keys: list[str], condition: Column, order: str = "date") -> DataFrame:
    """Rows where ``condition`` holds, with the number of their unbroken run (``island``) within the keys."""
    w = by(*keys, order=order)
    flagged = df.withColumn("_in", F.coalesce(condition, F.lit(False)))
    starts = flagged.withColumn("_first", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    return starts.withColumn("island", F.sum("_first").over(running(w))).where("_in").drop("_in", "_first")


def spells(df: DataFrame, keys: list[str], value: str, order: str = "date") -> DataFrame:
    """First and last ``order`` and length of each run of equal values."""
    w = by(*keys, order=order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    run = df.withColumn("_change", change).withColumn("_run", F.sum("_change").over(running(w)))
    return run.groupBy(*keys, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_run")


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], order: str = "date", strict: bool = False, max_age: int | None = None, seq: str | None = None) -> DataFrame:
    """Each left row with the latest right values at or before (``strict``: before) its time.

    Of right rows of one time the last by ``seq`` counts, without one the greatest values. Over ``max_age`` days old they are null.
    """
    one = F.max_by(F.struct(*values), seq) if seq else F.max(F.struct(*values))
    r = right.groupBy(*keys, order).agg(one.alias("_right"))
    if max_age is not None:
        r = r.withColumn("_right", F.struct(*(F.col(f"_right.{v}").alias(v) for v in values), F.col(order).alias("_at")))
    r = r.select(*keys, order, F.col("_right"), F.lit(0 if not strict else 2).alias("_side"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*keys, order)))
    both = left.select("*", F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.lit(1).alias("_side")).unionByName(r)
    w = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    if max_age is None:
        return seen.select(*left.columns, *(F.col(f"_right.{v}").alias(v) for v in values))
    young = F.datediff(order, "_right._at") <= max_age
    return seen.select(*left.columns, *(F.when(young, F.col(f"_right.{v}")).alias(v) for v in values))


def asof_days(left: DataFrame, right: DataFrame, values: list[str], order: str = "date") -> DataFrame:
    """``asof_backward`` without a key: it is done on the different days, which are few, and joined to the rows by day."""
    days = left.select(order).distinct().withColumn("_k", F.lit(1))
    found = asof_backward(days, right.withColumn("_k", F.lit(1)), ["_k"], values, order).drop("_k")
    return left.join(found, order).select(*left.columns, *values)


def asof_membership(days: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``days`` with ``members``: the list of the last change (date, members) at or before the day; null before the first."""
    return asof_backward(days, changes, keys, ["members"])


def asof_forward(left: DataFrame, calendar: DataFrame, order: str = "date", out: str = "snapped") -> DataFrame:
    """Each left row with the first calendar day at or after it, else the last calendar day. Rows without a date are left out.

    Every date up to the calendar's end is mapped to its day once, a few thousand rows; ``left`` is neither sorted nor exchanged."""
    days = calendar.select(F.col(order).alias("_day")).distinct()
    before = F.lag("_day").over(Window.partitionBy(F.lit(0)).orderBy("_day"))  # one calendar
    each = days.withColumn("_from", F.coalesce(F.date_add(before, 1), F.col("_day"))).select(F.explode(F.sequence("_from", "_day")).alias(order), "_day")
    span = days.agg(F.min("_day").alias("_first"), F.max("_day").alias("_end"))
    near = left.where(F.col(order).isNotNull()).join(F.broadcast(each), order, "left").join(F.broadcast(span))  # days, and one row
    return near.withColumn(out, F.coalesce("_day", F.when(F.col(order) < F.col("_first"), F.col("_first")).otherwise(F.col("_end")))).select(*left.columns, out)


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: int, order: str = "date") -> DataFrame:
    """Each left row with the right row nearest in days within the tolerance; ties go to the earlier one. Null where there is none.

    Both sides are bucketed by the tolerance, so a row meets three buckets, never its whole key.
    """
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    size = max(1, tolerance)
    r = right.select(*keys, F.col(order).alias("_at"), *values).withColumn("_bucket", F.explode(F.array(*(F.floor(number(F.col("_at")) / size) + k for k in (-1, 0, 1)))))
    base = left.withColumn("_bucket", F.floor(number(F.col(order)) / size))
    near = base.join(r, [*keys, "_bucket"], "left").where(F.col("_at").isNull() | (F.abs(F.datediff("_at", order)) <= tolerance))
    pick = F.min(F.struct(F.abs(F.datediff("_at", order)).alias("gap"), F.col("_at").alias("at"), *values))
    best = near.where("_at is not null").groupBy(*keys, order).agg(pick.alias("_best"))
    return left.join(best, [*keys, order], "left").select(*left.columns, F.col("_best.at").alias("matched"), *(F.col(f"_best.{v}").alias(v) for v in values))


def lookback(df: DataFrame, keys: list[str], value: str, days: int, order: str = "date") -> Column:
    """``value`` on the last row at least ``days`` calendar days earlier, as a range frame."""
    w = Window.partitionBy(*keys).orderBy(F.datediff(order, F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -days)
    return F.last(value).over(w)


def inner_align(returns: DataFrame, n_series: int, series: str = "series_id") -> DataFrame:
    """Rows of the dates that all series have: one aggregate, no N-way join."""
    whole = returns.where("ret is not null").groupBy("date").agg(F.count_distinct(series).alias("_n")).where(F.col("_n") == n_series).select("date")
    return returns.where("ret is not null").join(whole, "date")


def splice(series: DataFrame, priority: DataFrame) -> DataFrame:
    """(date, series_id, value): from each series' first date on, the series of the best rank takes over from those below it."""
    ranked = series.join(F.broadcast(priority), "series_id")
    return ranked.groupBy("date").agg(F.min_by(F.struct("series_id", "value"), "rank").alias("s")).select("date", "s.series_id", "s.value")
