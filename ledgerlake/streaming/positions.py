"""Streams of events: windowed sums with watermarks, sessions, and running positions kept in state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_sums(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(event_type, start, n, value) of tumbling windows; rows later than the watermark are left out."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = stamped.groupBy("event_type", F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return w.select("event_type", F.col("w.start").alias("start"), "n", "value")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = stamped.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), "n")


def running_positions(fills: DataFrame) -> DataFrame:
    """(sleeve, symbol, qty, cost, n): the position after each micro-batch; its last state equals the batch sum of fills.

    The state of a key is three numbers, however many fills it has seen.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        qty, cost, n = state.get if state.exists else (0.0, 0.0, 0)
        for rows in batches:
            qty += float(rows["qty"].sum())
            cost += float((rows["qty"] * rows["price"]).sum())
            n += len(rows)
        state.update((qty, cost, n))
        yield pd.DataFrame({"sleeve": [key[0]], "symbol": [key[1]], "qty": [qty], "cost": [cost], "n": [n]})

    return fills.groupBy("sleeve", "symbol").applyInPandasWithState(update, "sleeve int, symbol string, qty double, cost double, n long", "qty double, cost double, n long", "update", GroupStateTimeout.NoTimeout)
