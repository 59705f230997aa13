"""Orders from targets and holdings, netting across strategies, and money-weighted returns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import multipliers


def business_days(start: Column, end: Column) -> Column:
    """Weekdays after ``start`` up to ``end``."""
    span = F.when(end > start, F.sequence(F.date_add(start, 1), end, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(span, lambda d: F.dayofweek(d).between(2, 6)))


def staleness(as_of: Column, today: Column) -> Column:
    """Weekdays after the signal's close up to the last weekday before today."""
    return business_days(as_of, F.date_sub(today, 1))


def is_stale(signals: DataFrame, today: str) -> DataFrame:
    """``signals`` (sleeve, as_of, next_trade) with ``stale``: a daily signal after one trading day; a monthly one, which names its next
    trade date, from the month after that date on."""
    day = F.lit(today).cast("date")
    monthly = day >= F.trunc(F.add_months("next_trade", 1), "month")
    return signals.withColumn("days", staleness(F.col("as_of"), day)).withColumn("stale", F.when(F.col("next_trade").isNotNull(), monthly).otherwise(F.col("days") > 1))


def current_weights(signals: DataFrame, today: str) -> DataFrame:
    """(sleeve, symbol, weight, change): of signal rows (sleeve, symbol, weight, next_weight, next_trade) the weights to hold today.

    From the next trade date on those are the next weights. ``change``: due, scheduled, none, or null without a schedule.
    """
    day, plan = F.lit(today).cast("date"), F.col("next_trade").isNotNull()
    due = plan & (day >= F.col("next_trade"))
    differs = F.max((F.coalesce("next_weight", F.lit(0.0)) != F.coalesce("weight", F.lit(0.0))).cast("int")).over(Window.partitionBy("sleeve")) == 1
    change = F.when(due, "due").when(plan & differs, "scheduled").when(plan, "none")
    return signals.select("sleeve", "symbol", F.coalesce(F.when(due, F.col("next_weight")).otherwise(F.col("weight")), F.lit(0.0)).alias("weight"), change.alias("change"))


def last_prices(prices: DataFrame) -> DataFrame:
    """(symbol, price): the last positive close."""
    return prices.where("close > 0").groupBy("symbol").agg(F.max_by("close", "date").alias("price"))


def sleeve_positions(positions: DataFrame) -> DataFrame:
    """(sleeve, symbol, qty) held on the last day of each, none left out but the flat ones."""
    return positions.groupBy("sleeve", "symbol").agg(F.max_by("qty", "date").alias("qty")).where("abs(qty) > 1e-9")


def order_capital(nav: DataFrame, weights: DataFrame, invest: float = 1.0) -> DataFrame:
    """(sleeve, capital): all sleeves' NAV times the share that is invested times each sleeve's weight. ``nav``: (sleeve, nav)."""
    account = nav.agg(F.sum("nav").alias("_account"))
    return weights.join(F.broadcast(account)).select("sleeve", (F.col("_account") * invest * F.col("weight")).alias("capital"))  # one row


def order_plans(targets: DataFrame, holdings: DataFrame, prices: DataFrame, nav: DataFrame, weights: DataFrame, invest: float = 1.0, instruments: DataFrame | None = None, model: DataFrame | None = None, entries: DataFrame | None = None, band: float = 0.1) -> DataFrame:
    """(sleeve, symbol, side, quantity, kind, limit, reason): the orders of every sleeve on its share of the account.

    Sleeves in ``targets`` go to their weights (``plan_weights``); those in ``model`` or ``entries`` follow their picks (``plan_stock_picks``).
    A sleeve without a weight has no capital and plans nothing. ``weights``: (sleeve, weight)."""
    sleeves = targets.select("sleeve").union(holdings.select("sleeve")).distinct()
    whole = sleeves.join(weights.select("sleeve", "weight"), "sleeve", "left").na.fill(0.0, ["weight"])
    capital = order_capital(nav, whole, invest)
    picked = None if model is None else model.select("sleeve").union(entries.select("sleeve")).distinct()
    of_weights = holdings if picked is None else holdings.join(picked, "sleeve", "left_anti")
    none = F.lit(None).cast("double")
    out = plan_weights(targets, of_weights, prices, capital, instruments, band).select("sleeve", "symbol", "side", "quantity", F.lit("market").alias("kind"), none.alias("limit"), "reason")
    if picked is not None:
        funds = order_capital(nav, picked.join(weights.select("sleeve", "weight"), "sleeve", "left").na.fill(0.0, ["weight"]), invest)
        out = out.unionByName(plan_stock_picks(model, entries, holdings.join(picked, "sleeve", "left_semi"), prices, funds))
    return out


def weight_table(targets: DataFrame, holdings: DataFrame, prices: DataFrame, capital: DataFrame, instruments: DataFrame | None = None) -> DataFrame:
    """(sleeve, symbol, weight, qty, price, multiplier, future, capital, current, target_qty) of every target and holding.

    Whole shares rounded down, futures to the nearest contract, halves to even. Without a price, current and target are null.
    """
    both = targets.where("weight > 0").select("sleeve", "symbol", "weight").join(holdings.where("abs(qty) > 1e-9").select("sleeve", "symbol", "qty"), ["sleeve", "symbol"], "full_outer").na.fill(0.0, ["qty", "weight"])
    x = multipliers(both.join(prices.where("price > 0").select("symbol", "price"), "symbol", "left"), instruments).join(F.broadcast(capital), "sleeve")
    units = F.col("capital") * F.col("weight") / (F.col("price") * F.col("multiplier"))
    current = F.when(F.col("capital") > 0, F.col("qty") * F.col("price") * F.col("multiplier") / F.nullif("capital", F.lit(0.0)))
    return x.withColumn("current", current).withColumn("target_qty", F.when(F.col("future"), F.bround(units, 0)).otherwise(F.floor(units + 1e-9).cast("double")))


def plan_weights(targets: DataFrame, holdings: DataFrame, prices: DataFrame, capital: DataFrame, instruments: DataFrame | None = None, band: float = 0.1) -> DataFrame:
    """(sleeve, symbol, side, quantity, price, value, reason): orders to the target weights.

    A sleeve trades all its symbols if any of them enters or leaves, or if the largest gap of current and target weight is over the
    band; else none. A symbol without a price is not sized.
    """
    w = Window.partitionBy("sleeve")
    x = weight_table(targets, holdings, prices, capital, instruments)
    flip = (F.col("weight") > 0) != (F.abs("qty") > 1e-9)
    x = x.withColumn("flips", F.max(flip.cast("int")).over(w)).withColumn("drift", F.max(F.abs(F.col("current") - F.col("weight"))).over(w))
    move = F.col("target_qty") - F.col("qty")
    goes = (F.col("capital") > 0) & ((F.col("flips") == 1) | (F.col("drift") > band)) & (F.abs(move) >= 1e-9)
    return x.where(goes).select(
        "sleeve", "symbol", F.when(move > 0, "BUY").otherwise("SELL").alias("side"), F.abs(move).alias("quantity"), "price", (F.abs(move) * F.col("price") * F.col("multiplier")).alias("value"),
        F.when(F.col("flips") == 1, "signal change").otherwise("drift").alias("reason"),
    )


def missing_vs_model(holdings: DataFrame, model: DataFrame) -> DataFrame:
    """(sleeve, symbol, status): what is held but not in the model, what the model holds and the sleeve does not, and what both hold."""
    both = holdings.where("qty > 1e-9").select("sleeve", "symbol", F.lit(True).alias("held")).join(model.select("sleeve", "symbol", F.coalesce("exit", F.lit("")).alias("exit")), ["sleeve", "symbol"], "full_outer")
    status = F.when(F.col("exit").isNull(), "not in model").when(F.col("held").isNull(), F.when(F.col("exit") == "", "not held")).when(F.col("exit") != "", "exit").otherwise("hold")
    return both.select("sleeve", "symbol", status.alias("status")).where("status is not null")


def plan_stock_picks(model: DataFrame, entries: DataFrame, holdings: DataFrame, prices: DataFrame, capital: DataFrame, least: float = 0.02) -> DataFrame:
    """(sleeve, symbol, side, quantity, kind, limit, reason): exits, protective orders of what stays, and entries while the cash lasts.

    ``model``: (sleeve, symbol, exit, take_profit, stop); ``entries``: (sleeve, rank, symbol, weight). Cash is the capital less what is
    kept. Entries are taken by rank, each of weight x capital or what cash is left, in whole shares; under ``least`` of the wanted
    money the rest are left out. The fold runs over a sleeve's entries, a handful.
    """
    held = holdings.where("qty > 1e-9").select("sleeve", "symbol", "qty").join(prices.select("symbol", "price"), "symbol", "left").join(model.withColumn("known", F.lit(True)), ["sleeve", "symbol"], "left")
    stays = F.col("known").isNotNull() & (F.coalesce("exit", F.lit("")) == "")
    sell = lambda kind, limit, why, when: F.when(when, F.struct(F.lit(kind).alias("kind"), limit.alias("limit"), why.alias("reason")))
    none = F.lit(None).cast("double")
    sells = held.select("sleeve", "symbol", F.lit("SELL").alias("side"), F.col("qty").alias("quantity"), F.explode(F.array_compact(F.array(
        sell("market on open", none, F.lit("not in model"), F.col("known").isNull()), sell("market on open", none, F.col("exit"), F.col("known").isNotNull() & ~stays),
        sell("limit", F.round("take_profit", 2), F.lit("take profit"), stays & F.col("take_profit").isNotNull()), sell("stop", F.round("stop", 2), F.lit("stop loss"), stays & F.col("stop").isNotNull()),
    ))).alias("x")).select("sleeve", "symbol", "side", "quantity", "x.kind", "x.limit", "x.reason")
    kept = held.where(stays).groupBy("sleeve").agg(F.sum(F.col("qty") * F.coalesce("price", F.lit(0.0))).alias("kept"))
    fresh = entries.join(held.select("sleeve", "symbol"), ["sleeve", "symbol"], "left_anti").join(prices.select("symbol", "price"), "symbol", "left")
    queue = fresh.groupBy("sleeve").agg(F.array_sort(F.collect_list(F.struct("rank", "symbol", "weight", "price"))).alias("queue"))
    queue = queue.join(F.broadcast(capital), "sleeve").join(kept, "sleeve", "left").withColumn("cash", F.greatest(F.col("capital") - F.coalesce("kept", F.lit(0.0)), F.lit(0.0)))
    start = F.struct(F.col("cash").alias("cash"), F.lit(False).alias("stopped"), F.array().cast("array<struct<symbol:string,quantity:double>>").alias("buys"))

    def step(acc: Column, b: Column) -> Column:
        want = F.col("capital") * b.weight
        money = F.least(want, acc.cash)
        stop = acc.stopped | ((want > 0) & (money < least * want))
        q = F.coalesce(F.floor(money / b.price + 1e-9).cast("double"), F.lit(0.0))
        buys = ~stop & (q >= 1)
        return F.struct(
            F.when(buys, acc.cash - q * b.price).otherwise(acc.cash).alias("cash"), stop.alias("stopped"),
            F.when(buys, F.concat(acc.buys, F.array(F.struct(b.symbol.alias("symbol"), q.alias("quantity"))))).otherwise(acc.buys).alias("buys"),
        )

    bought = queue.select("sleeve", F.explode(F.aggregate("queue", start, step)["buys"]).alias("b"))
    return sells.unionByName(bought.select("sleeve", "b.symbol", F.lit("BUY").alias("side"), "b.quantity", F.lit("market on open").alias("kind"), none.alias("limit"), F.lit("entry").alias("reason")))


def net_orders(orders: DataFrame) -> DataFrame:
    """Market orders (sleeve, symbol, side, quantity, timing, kind) netted by symbol and timing; limit orders stay apart."""
    signed = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    net = orders.where("kind = 'market'").groupBy("symbol", "timing").agg(F.sum(signed).alias("q"), F.array_join(F.array_sort(F.collect_set(F.col("sleeve").cast("string"))), ", ").alias("strategies"))
    net = net.where("q <> 0").select("symbol", "timing", F.when(F.col("q") > 0, "BUY").otherwise("SELL").alias("side"), F.abs("q").alias("quantity"), F.lit("market").alias("kind"), "strategies")
    limits = orders.where("kind <> 'market'").select("symbol", "timing", "side", "quantity", "kind", F.col("sleeve").cast("string").alias("strategies"))
    return net.unionByName(limits)


def xirr_rate(days: np.ndarray, amounts: np.ndarray) -> float | None:
    """The continuous rate k in [-60, 60] with sum of amount x exp(-k t) = 0, by bisection; None if there is none."""
    t = days / 365.0
    f = lambda k: float((amounts * np.exp(-k * t)).sum())
    lo, hi = -60.0, 60.0
    a, b = f(lo), f(hi)
    if not (amounts > 0).any() or not (amounts < 0).any() or a * b > 0:
        return None
    for _ in range(200):
        mid = (lo + hi) / 2
        if a * f(mid) <= 0:
            hi = mid
        else:
            lo = mid
    return (lo + hi) / 2


def money_weighted(flows: DataFrame, key: str) -> DataFrame:
    """(key, annual, period, years): the internal rate of return of (key, date, amount) flows, summed by day before they leave the JVM."""
    daily = flows.groupBy(key, "date").agg(F.sum("amount").alias("amount"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        when = pd.to_datetime(rows["date"])
        days = (when - when.min()).dt.days.to_numpy(float)
        k = xirr_rate(days, rows["amount"].to_numpy(float))
        years = float(days.max() / 365.0)
        return pd.DataFrame({key: [rows[key].iloc[0]], "annual": [None if k is None else float(np.expm1(k))], "period": [None if k is None else float(np.expm1(k * years))], "years": [years]})

    return daily.groupBy(key).applyInPandas(solve, f"{key} {flows.schema[key].dataType.simpleString()}, annual double, period double, years double")
