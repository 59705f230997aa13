"""Journals of fills and cash flows to accounts: positions, cash, NAV, returns and round trips.

Everything is partitioned by sleeve and symbol. Sequential definitions (time-weighted returns with funding, flat-to-flat trips)
are written as window expressions; only the average cost of open positions needs a fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .timeseries import asof_forward, by, running

#: Shares under this size are none.
TINY = 1e-9
KEY = ["sleeve", "symbol"]
#: Legs in a row of a key's history.
PACK = 256


def split_restate(fills: DataFrame, splits: DataFrame) -> DataFrame:
    """Quantities times, and prices over, the product of the split ratios after each fill; their product stays."""
    f, s = fills.alias("f"), F.broadcast(splits).alias("s")
    factor = f.join(s, F.expr("s.symbol = f.symbol and s.ex > f.date"), "left").groupBy(*(F.col(f"f.{c}") for c in fills.columns)).agg(F.coalesce(F.product("ratio"), F.lit(1.0)).alias("factor"))
    return factor.withColumn("qty", F.col("qty") * F.col("factor")).withColumn("price", F.col("price") / F.col("factor"))


def build_calendar(days: DataFrame, *events: DataFrame, inception: str | None = None, end: str | None = None) -> DataFrame:
    """(date, i): the trading days from the first event (or inception) to ``end``, numbered from 0; the first event's own day opens
    the calendar where no trading day falls on it. A calendar is days, so one task numbers it."""
    first = events[0].select("date")
    for e in events[1:]:
        first = first.union(e.select("date"))
    least = F.min("date")
    first = first.agg((F.least(least, F.lit(inception).cast("date")) if inception else least).alias("date")).where("date is not null")
    if end:
        first, days = first.where(F.col("date") <= F.lit(end).cast("date")), days.where(F.col("date") <= F.lit(end).cast("date"))
    opened = days.select("date").distinct().join(F.broadcast(first.select(F.col("date").alias("_first"))), F.col("date") >= F.col("_first")).select("date")
    return opened.union(first).distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).cast("long") - 1)


def on_calendar(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows booked on the first calendar day at or after their own, on the last day at most: none is lost."""
    return asof_forward(rows, calendar, out="_booked").withColumn("date", F.col("_booked")).select(rows.columns)


def multipliers(rows: DataFrame, instruments: DataFrame | None) -> DataFrame:
    """``rows`` with the multiplier (else 1) and future flag (else false) of their symbol; instruments are one row a symbol."""
    if instruments is None:
        return rows.withColumns({"multiplier": F.lit(1.0), "future": F.lit(False)})
    known = instruments.select("symbol", F.col("multiplier").cast("double").alias("multiplier"), (F.col("kind") == "future").alias("future"))
    return rows.join(F.broadcast(known), "symbol", "left").withColumns({"multiplier": F.coalesce("multiplier", F.lit(1.0)), "future": F.coalesce("future", F.lit(False))})


def daily_fills(fills: DataFrame) -> DataFrame:
    """Signed quantity, notional and fees of each sleeve, symbol and day."""
    return fills.groupBy(*KEY, "date").agg(F.sum("qty").alias("traded"), F.sum(F.col("qty") * F.col("price")).alias("notional"), F.sum("fees").alias("fees"))


def grid(keys: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every key with every calendar day from its first day on; ``keys`` has a column ``first``. A calendar is days, so it is broadcast."""
    return keys.join(F.broadcast(calendar.select("date")), F.col("date") >= F.col("first")).drop("first")


def marks(booked: DataFrame, prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """(symbol, date, mark) on every calendar day: the last close at or before it, on the calendar or not, else the last fill price of
    any sleeve. ``booked`` are fills on calendar days."""
    fill = booked.groupBy("symbol", "date").agg(F.max_by("price", F.struct("seq", "sleeve")).alias("fill"))
    symbols = fill.select("symbol").distinct()
    none = F.lit(None).cast("double")
    rows = symbols.join(F.broadcast(calendar.select("date"))).select("symbol", "date", none.alias("close"), none.alias("fill"), F.lit(1).alias("wanted"))
    rows = rows.union(prices.join(symbols, "symbol", "left_semi").select("symbol", "date", "close", none, F.lit(0))).union(fill.select("symbol", "date", none, "fill", F.lit(0)))
    w = running(Window.partitionBy("symbol").orderBy("date", "wanted"))
    mark = F.coalesce(F.last("close", True).over(w), F.last("fill", True).over(w))
    return rows.withColumn("mark", mark).where("wanted = 1").select("symbol", "date", "mark")


def positions_daily(fills: DataFrame, prices: DataFrame, calendar: DataFrame, dividends: DataFrame | None = None, instruments: DataFrame | None = None) -> DataFrame:
    """(sleeve, symbol, date, qty, mark, value, notional, fees, income, pnl, future) on every calendar day since the first fill.

    Fills and dividends off the calendar are booked on the next day, or the last. Value and traded notional carry the multiplier.
    Income is the dividend a share times the quantity held the day before, not for futures. Profit is the change of value less
    traded notional plus income. ``instruments``: (symbol, multiplier, kind); ``dividends``: (symbol, date, dividend).
    """
    booked = on_calendar(fills, calendar)
    return positions_of_days(daily_fills(booked), marks(booked, prices, calendar), calendar, dividends, instruments)


def positions_of_days(day: DataFrame, marked: DataFrame, calendar: DataFrame, dividends: DataFrame | None = None, instruments: DataFrame | None = None) -> DataFrame:
    """``positions_daily`` from what ``daily_fills`` gives of booked fills, and from marks."""
    dense = grid(day.groupBy(*KEY).agg(F.min("date").alias("first")), calendar)
    rows = multipliers(dense.join(day, [*KEY, "date"], "left").join(marked, ["symbol", "date"], "left"), instruments)
    w = by(*KEY)
    if dividends is None:
        rows = rows.withColumn("dividend", F.lit(0.0))
    else:
        span = calendar.agg(F.min("date").alias("a"), F.max("date").alias("b"))
        within = dividends.where("dividend > 0").join(F.broadcast(span), F.col("date").between(F.col("a"), F.col("b"))).select("symbol", "date", "dividend")
        rows = rows.join(on_calendar(within, calendar).groupBy("symbol", "date").agg(F.sum("dividend").alias("dividend")), ["symbol", "date"], "left")
    qty = F.sum(F.coalesce("traded", F.lit(0.0))).over(running(w))
    out = rows.select(
        *KEY, "date", F.when(F.abs(qty) <= TINY, F.lit(0.0)).otherwise(qty).alias("qty"), "mark", "multiplier", "future",
        (F.coalesce("notional", F.lit(0.0)) * F.col("multiplier")).alias("notional"), F.coalesce("fees", F.lit(0.0)).alias("fees"), F.when(~F.col("future"), F.col("dividend")).alias("dividend"),
    ).withColumn("value", F.col("qty") * F.col("mark") * F.col("multiplier"))
    out = out.withColumn("income", F.lag("qty", 1, 0.0).over(w) * F.coalesce("dividend", F.lit(0.0)) * F.col("multiplier"))
    return out.withColumn("pnl", F.col("value") - F.lag("value", 1, 0.0).over(w) - F.col("notional") + F.col("income")).drop("multiplier", "dividend")


def dividend_credit(positions: DataFrame) -> DataFrame:
    """(sleeve, symbol, date, credit): dividends paid on what was held at the previous close."""
    return positions.where("income <> 0").select(*KEY, "date", F.col("income").alias("credit"))


def sleeve_flows(cashflows: DataFrame) -> DataFrame:
    """External money in and out, and internal income and fees, of each sleeve and day."""
    x, v = F.col("external"), F.col("value")
    part = lambda c: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    return cashflows.groupBy("sleeve", "date").agg(part(x & (v > 0)).alias("flow_in"), part(x & (v < 0)).alias("flow_out"), part(~x).alias("income"))


def sleeve_daily(positions: DataFrame, cashflows: DataFrame, calendar: DataFrame) -> DataFrame:
    """(sleeve, date, flow_in, flow_out, income, fees, cash, value, nav, long, short, n_positions, pnl) on every calendar day.

    Flows off the calendar are booked on the next day, or the last. Income is that of the journal and of dividends. NAV is all money
    in, less what was spent, plus positions; cash is NAV less positions other than futures, whose notional ties up no money.
    """
    part = lambda c: F.sum(F.when(c, F.col("value")).otherwise(F.lit(0.0)))
    book = positions.groupBy("sleeve", "date").agg(
        F.sum("value").alias("value"), part(F.col("future")).alias("futures"), F.sum("notional").alias("notional"), F.sum("fees").alias("fees"), F.sum("income").alias("dividends"),
        F.sum(F.greatest("value", F.lit(0.0))).alias("long"), F.sum(F.least("value", F.lit(0.0))).alias("short"), F.sum((F.col("qty") != 0).cast("long")).alias("n_positions"),
    )
    flows = sleeve_flows(on_calendar(cashflows, calendar))
    ids = flows.select("sleeve").union(book.select("sleeve")).distinct()
    dense = grid(ids.join(F.broadcast(calendar.agg(F.min("date").alias("first")))), calendar)
    rows = dense.join(book, ["sleeve", "date"], "left").join(flows, ["sleeve", "date"], "left").na.fill(0.0).na.fill(0)
    w = by("sleeve")
    money = F.sum(F.col("flow_in") + F.col("flow_out") + F.col("income") + F.col("dividends") - F.col("notional") - F.col("fees")).over(running(w))
    out = rows.withColumn("nav", money + F.col("value")).withColumn("income", F.col("income") + F.col("dividends")).withColumn("cash", F.col("nav") - F.col("value") + F.col("futures"))
    return out.withColumn("pnl", F.col("nav") - F.lag("nav", 1, 0.0).over(w) - F.col("flow_in") - F.col("flow_out")).drop("dividends", "futures")


def twr_returns(daily: DataFrame, least: float = 1.0, keys: tuple[str, ...] = ("sleeve",)) -> DataFrame:
    """Time-weighted return: (NAV - out) / (previous NAV + in) - 1 while funded.

    Money in opens a sleeve. A withdrawal that leaves no more than ``least`` or 1 % of what was there closes it until new money
    comes. As a window: the last opening or closing event before the day says whether it is funded.
    """
    w = by(*keys)
    nav, into, out = F.col("nav"), F.col("flow_in"), F.col("flow_out")
    closes = (out < 0) & (nav <= F.greatest(F.lit(least), 0.01 * (nav - out)))
    event = daily.withColumn("_event", F.when(closes, 0).when(into > 0, 1))
    state = event.withColumn("_state", F.last("_event", True).over(running(w)))
    base = F.coalesce(F.lag("nav").over(w), F.lit(0.0)) + into
    funded = (into > 0) | (F.lag("_state").over(w) == 1)
    return state.withColumn("ret", F.when(funded & (base > least), (nav - out) / F.nullif(base, F.lit(0.0)) - 1)).drop("_event", "_state")


def book_total(daily: DataFrame, cashflows: DataFrame, calendar: DataFrame) -> DataFrame:
    """The sleeves summed by day; transfers between sleeves cancel, and what does not cancel counts by its sign. Deposits and
    withdrawals of a day are net within a sleeve."""
    cashflows = on_calendar(cashflows, calendar)
    moved = cashflows.where("type = 'transfer'").groupBy("date").agg(F.sum("value").alias("net"))
    own = cashflows.where("external and type <> 'transfer'").groupBy("date", "sleeve").agg(F.sum("value").alias("value")).groupBy("date").agg(F.sum(F.greatest("value", F.lit(0.0))).alias("own_in"), F.sum(F.least("value", F.lit(0.0))).alias("own_out"))
    total = daily.groupBy("date").agg(*(F.sum(c).alias(c) for c in ("cash", "value", "nav", "long", "short", "pnl")))
    rows = total.join(own, "date", "left").join(moved, "date", "left").na.fill(0.0, ["own_in", "own_out", "net"])
    return rows.withColumn("flow_in", F.col("own_in") + F.greatest("net", F.lit(0.0))).withColumn("flow_out", F.col("own_out") + F.least("net", F.lit(0.0))).drop("own_in", "own_out", "net")


def ledger_weights(daily: DataFrame) -> DataFrame:
    total = F.sum("nav").over(Window.partitionBy("date"))
    return daily.withColumn("weight", F.when(F.abs(total) > 1e-6, F.col("nav") / F.nullif(total, F.lit(0.0))))


def size_of(shares: Column) -> Column:
    return F.when(F.abs(shares) <= TINY, F.lit(0.0)).otherwise(shares)


def legs_of(held: DataFrame, w: WindowSpec, *keep: str) -> DataFrame:
    """Legs of fills with the position ``before`` and ``after``, in the number of their flat-to-flat episode within the window; a fill
    that flips the sign is two legs with fees in proportion. Episodes are counted before flips are cut in two, where a row is a fill."""
    flip = F.col("before") * F.col("after") < 0
    share = lambda q: F.struct(q.alias("q"), (F.col("fees") * F.abs(q / F.col("qty"))).alias("fee"))
    one = F.array(F.struct(F.col("qty").alias("q"), F.col("fees").alias("fee")))
    two = F.array(share(-F.col("before")), share(F.col("after")))
    begun = F.sum((F.col("before") == 0).cast("int") + flip.cast("int")).over(running(w))
    held = held.withColumns({"flip": flip, "begun": begun})
    cut = held.select(*KEY, *keep, "seq", "date", "price", "before", "flip", "begun", F.posexplode(F.when(flip, two).otherwise(one)).alias("leg", "x"))
    episode = F.col("begun") - (F.col("flip") & (F.col("leg") == 0)).cast("int")
    return cut.select(*KEY, *keep, "seq", "leg", "date", "price", "x.q", "x.fee", F.when(F.col("leg") == 1, F.lit(0.0)).otherwise(F.col("before")).alias("before"), episode.alias("episode"))


def episodes(fills: DataFrame) -> DataFrame:
    """Legs of fills with the position before, in the number of their episode. One sort of a key's fills serves all."""
    w = by(*KEY, order="seq")
    after = fills.withColumn("after", size_of(F.sum("qty").over(running(w)))).withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0.0)))
    return legs_of(after, w)


def parts_of(fills: DataFrame, parts: int | None) -> int:
    return parts or int(fills.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def day_starts(unordered: DataFrame) -> DataFrame:
    """(sleeve, symbol, day, qty, begins): the position that a key's day begins with, and whether an episode surely begins on the day: it
    begins flat, or ends on the other side by more than a sum's rounding."""
    sums = unordered.groupBy(*KEY, F.col("date").alias("day")).agg(F.sum("qty").alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(by(*KEY, order="day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    qty, end = F.col("qty"), F.col("qty") + F.coalesce("_sum", F.lit(0.0))
    begins = (size_of(qty) == 0) | ((qty * end < 0) & (F.abs(end) > 1e-6 * (1 + F.abs(qty))))
    return sums.withColumn("qty", start).select(*KEY, "day", "qty", begins.alias("begins"))


def day_legs(fills: DataFrame, starts: DataFrame, parts: int | None = None, order: tuple[str, ...] = ("seq",), values: dict[str, Column] | None = None) -> DataFrame:
    """Legs of fills whose episodes are counted anew on each day of a key (``day``); 0 goes on from the day before. ``starts``: the
    position that a key's day begins with. Of another ``order`` than by seq, seq is the number within the day. ``values``: qty, price and
    fees as Columns of ``order``, made where the rows are dealt to, so that they are not exchanged besides.

    A task sorts days, never a key's whole history, and days are dealt to ``parts`` partitions, else the session's: merged by their
    compressed size they would be millions of fills in a task."""
    keys, values = [*KEY, "day"], values or {}
    starts = starts.select(*keys, F.col("qty").alias("_start"), F.lit(False).alias("_fill"))  # a day's first row, so no join is needed
    rows = fills.select(*KEY, F.col("date").alias("day"), *order, *(c for c in ("price", "fees", "qty") if c not in values), F.lit(True).alias("_fill"))
    rows = rows.unionByName(starts, allowMissingColumns=True).repartition(parts_of(fills, parts), *keys)
    rows = rows.withColumns({"date": F.col("day"), **values}).withColumn("qty", F.when(F.col("_fill"), F.col("qty")).otherwise(F.col("_start")))
    w = Window.partitionBy(*keys).orderBy("_fill", *order)
    held = rows.withColumns({"after": size_of(F.sum("qty").over(running(w))), "before": size_of(F.sum("qty").over(w.rowsBetween(Window.unboundedPreceding, -1)))})
    if order != ("seq",):
        held = held.withColumn("seq", F.row_number().over(w))
    return legs_of(held.where("_fill"), w, "day")


def last_legs(fills: DataFrame, unordered: DataFrame, parts: int | None = None, order: tuple[str, ...] = ("seq",), values: dict[str, Column] | None = None) -> DataFrame:
    """``day_legs`` of the days from which on a key's last episode may have begun; those before can't be of it. A row a key is broadcast."""
    starts = day_starts(unordered).withColumn("_first", F.max(F.when(F.col("begins"), F.col("day"))).over(Window.partitionBy(*KEY))).where("day >= _first")
    first = starts.groupBy(*KEY).agg(F.min("day").alias("_first")).select(*(F.col(k).alias(f"_{k}") for k in KEY), "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    late = fills.join(F.broadcast(first), [*same, F.col("date") >= F.col("_first")]).select(fills.columns)
    return day_legs(late, starts, parts, order, values)


def days_joined(pieces: DataFrame) -> DataFrame:
    """One row for each episode of a key from one for each of its days, in the numbers that the whole history gives."""
    whole = pieces.withColumn("episode", F.sum((F.col("episode") > 0).cast("int")).over(running(Window.partitionBy(*KEY).orderBy("day", "episode"))))
    how = {c: F.min if c == "entry_date" else F.max if c in ("exit_date", "exit_seq", "quantity", "multiplier", "closed", "side") else F.sum for c in pieces.columns if c not in (*KEY, "day", "episode", "direction")}
    return whole.groupBy(*KEY, "episode").agg(F.when(F.max("side") > 0, "long").otherwise("short").alias("direction"), *(f(c).alias(c) for c, f in how.items()))


def round_trips(fills: DataFrame, calendar: DataFrame | None = None, instruments: DataFrame | None = None, unordered: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Flat-to-flat episodes of each sleeve and symbol, closed or open. Net of fees, without dividends, with the multiplier.

    For a closed episode the average-cost profit is exit value less entry value, so it needs sums alone. With a calendar, dates are
    booked days and ``bars`` counts them. ``quantity`` is the largest position. An episode keeps its sign and ends where nothing is left, so
    each leg tells its side and whether it closes; the sums need no order.

    ``unordered``, the same fills without ``seq``, says that dates never fall as ``seq`` rises: fills are then summed within days, and a
    key's days put together, so that a task holds days and not a key's history. ``parts`` of them, which should grow with the fills.
    """
    book = lambda x: x if calendar is None else on_calendar(x, calendar)
    legs = episodes(book(fills)) if unordered is None else day_legs(book(fills), day_starts(book(unordered)), parts)
    e = multipliers(legs, instruments).withColumn("after", F.col("before") + F.col("q"))
    e = e.withColumn("side", F.signum(F.when(F.col("before") != 0, F.col("before")).otherwise(F.col("q"))))
    enters = F.col("q") * F.col("side") > 0
    value = F.abs(F.col("q")) * F.col("price") * F.col("multiplier")
    part = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))
    price = lambda v, q: v / F.nullif(q * F.col("multiplier"), F.lit(0.0))
    out = e.groupBy(*KEY, *(() if unordered is None else ("day",)), "episode").agg(
        F.when(F.max("side") > 0, "long").otherwise("short").alias("direction"), F.min("date").alias("entry_date"), F.max("date").alias("exit_date"), F.max("seq").alias("exit_seq"),
        F.max(F.abs("after")).alias("quantity"), part(enters, value).alias("entry_value"), part(~enters, value).alias("exit_value"), F.sum("fee").alias("fees"),
        part(enters, F.abs("q")).alias("entry_qty"), part(~enters, F.abs("q")).alias("exit_qty"), F.count("*").alias("fills"), F.max("multiplier").alias("multiplier"),
        F.max(F.abs("after") <= TINY).alias("closed"), F.max("side").alias("side"),
    )
    if unordered is not None:
        out = days_joined(out)
    pnl = F.col("side") * (F.col("exit_value") - F.col("entry_value")) - F.col("fees")
    done = out.withColumns({
        "pnl": F.when(F.col("closed"), pnl), "ret": F.when(F.col("closed"), pnl / F.nullif("entry_value", F.lit(0.0))), "days": F.datediff("exit_date", "entry_date"),
        "entry_price": price(F.col("entry_value"), F.col("entry_qty")), "exit_price": price(F.col("exit_value"), F.col("exit_qty")),
    }).drop("side", "entry_qty", "exit_qty", "multiplier")
    if calendar is None:
        return done
    at = lambda c: F.broadcast(calendar.select(F.col("date").alias(f"{c}_date"), F.col("i").alias(f"_{c}")))
    return done.join(at("entry"), "entry_date").join(at("exit"), "exit_date").withColumn("bars", F.col("_exit") - F.col("_entry")).select(*done.columns, "bars")


def costs_of(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(sleeve, symbol, quantity, avg, realized, fees, entry_date) of each key's last episode. ``rows``: (sleeve, symbol, day, episode, qs,
    prices, quantity, fees, entry_date) in order, some legs each. An episode of 0 goes on. None is SQL's null, also in sums."""
    add = lambda a, b: b if a is None else a if b is None else a + b
    key = now = None
    for sleeve, symbol, day, episode, qs, prices, quantity, fees, entry in rows:
        if key != (sleeve, symbol) or (episode > 0 and now != (day, episode)):
            if key not in (None, (sleeve, symbol)):
                yield *key, total, avg, gain, paid, first
            key, now, q, avg, gain, total, paid, first = (sleeve, symbol), (day, episode), 0.0, 0.0, 0.0, None, None, entry
        total, paid, first = add(total, quantity), add(paid, fees), min(first, entry)
        for x, p in zip(qs, prices, strict=True):
            if q is None or x is None:
                q = gain = None
            elif q * x >= 0:
                left = q + x
                avg = None if avg is None or p is None else (avg * abs(q) + p * abs(x)) / abs(left) if left else math.nan
                q = left
            else:
                gain = None if gain is None or avg is None or p is None else gain + (p - avg) * abs(x) * (1.0 if q > 0 else -1.0)
                q += x
    if key:
        yield *key, total, avg, gain, paid, first


def average_costs(legs: DataFrame, parts: int | None = None) -> DataFrame:
    """(sleeve, symbol, quantity, avg, realized, fees, entry_date) of each key's last episode, from the legs of ``episodes`` or of days.

    Legs are packed, ``PACK`` of them a row at most, before a key's are put in order; a task then reads them as a stream. They are folded
    one by one, as in SQL, so that every bit is the same; days folded apart and put together would round otherwise."""
    of_days = "day" in legs.columns
    legs = legs if of_days else legs.withColumn("day", F.lit(None).cast("date"))
    packed = legs.withColumn("pack", F.floor(F.col("seq") / PACK)).groupBy(*KEY, "day", "episode", "pack").agg(
        F.sort_array(F.collect_list(F.struct("seq", "leg", "q", "price"))).alias("x"), F.sum("q").alias("quantity"), F.sum("fee").alias("fees"), F.min("date").alias("entry_date")
    )
    packed = packed.select(*KEY, "day", "episode", F.col("x.q").alias("qs"), F.col("x.price").alias("prices"), "quantity", "fees", "entry_date", "pack")
    if of_days:
        packed = packed.repartition(parts_of(legs, parts), *KEY)
    rows = packed.sortWithinPartitions(*KEY, "day", "episode", "pack").drop("pack")
    sums = ("quantity", "avg", "realized", "fees")
    out = StructType([*(rows.schema[k] for k in KEY), *(StructField(c, DoubleType()) for c in sums), rows.schema["entry_date"]])

    def value(x):
        return x.as_py() if not isinstance(x, pa.ListScalar) else x.values.to_pylist() if x.values.null_count else x.values.to_numpy().tolist()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {}

        def each():
            for b in batches:
                types.update({c: b.schema.field(c).type for c in (*KEY, "entry_date")})
                for row in zip(*b.columns, strict=True):
                    yield tuple(map(value, row))

        for r in costs_of(each()):
            yield pa.RecordBatch.from_arrays([pa.array([x], types.get(c, pa.float64())) for c, x in zip(out.names, r, strict=True)], out.names)

    return rows.mapInArrow(fold, out)


def open_positions(
    fills: DataFrame, last: DataFrame, calendar: DataFrame, nav: DataFrame | None = None, instruments: DataFrame | None = None,
    unordered: DataFrame | None = None, parts: int | None = None, order: tuple[str, ...] = ("seq",), values: dict[str, Column] | None = None,
) -> DataFrame:
    """What each sleeve holds at the calendar's end, with its average cost: a fold over the ordered legs of each open episode.

    Adding averages in, reducing realises profit at the average. ``last``: (symbol, last); ``nav``: (sleeve, nav) gives the weights.
    Returns quantity, avg_cost, last, market_value, unrealized, unrealized_pct, realized (net of fees), entry_date, days, bars, weight.

    ``unordered``, the same fills or their sums by day, says that dates never fall in the ``order`` of fills, as in ``round_trips``: no task
    then sorts a key's history, and days before the last episode are not exchanged. ``parts`` of them, which should grow with the fills;
    ``order`` and ``values`` as in ``day_legs``.
    """
    booked = on_calendar(fills, calendar)
    legs = episodes(booked) if unordered is None else last_legs(booked, on_calendar(unordered, calendar), parts, order, values)
    held = multipliers(average_costs(legs, parts).where(F.abs("quantity") > TINY), instruments)
    held = held.join(F.broadcast(last.select("symbol", "last")), "symbol", "left")
    held = held.withColumn("nav", F.lit(None).cast("double")) if nav is None else held.join(F.broadcast(nav.select("sleeve", "nav")), "sleeve", "left")
    end = F.broadcast(calendar.agg(F.max("date").alias("_end"), F.max("i").alias("_last")))
    held = held.join(F.broadcast(calendar.select(F.col("date").alias("entry_date"), "i")), "entry_date").join(end)
    gain = (F.col("last") - F.col("avg")) * F.col("quantity") * F.col("multiplier")
    value = F.col("quantity") * F.col("last") * F.col("multiplier")
    return held.select(
        *KEY, "quantity", F.col("avg").alias("avg_cost"), "last", value.alias("market_value"), gain.alias("unrealized"),
        (gain / F.nullif(F.col("avg") * F.abs("quantity") * F.col("multiplier"), F.lit(0.0))).alias("unrealized_pct"), (F.col("realized") * F.col("multiplier") - F.col("fees")).alias("realized"),
        "entry_date", F.datediff("_end", "entry_date").alias("days"), (F.col("_last") - F.col("i")).alias("bars"), F.when(F.abs("nav") > 1.0, value / F.col("nav")).alias("weight"),
    )


def unbalanced_transfers(cashflows: DataFrame) -> DataFrame:
    return cashflows.where("type = 'transfer'").groupBy("date").agg(F.sum("value").alias("net")).where("abs(net) > 0.005")


def flows_by_period(cashflows: DataFrame, unit: str = "month") -> DataFrame:
    """Net external flow of every period from the first to the last, and its running sum."""
    net = cashflows.where("external").groupBy("sleeve", F.date_trunc(unit, "date").cast("date").alias("period")).agg(F.sum("value").alias("net"))
    step = {"month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[unit]
    dense = net.groupBy("sleeve").agg(F.min("period").alias("a"), F.max("period").alias("b")).select("sleeve", F.explode(F.expr(f"sequence(a, b, {step})")).alias("period"))
    rows = dense.join(net, ["sleeve", "period"], "left").na.fill(0.0, ["net"])
    return rows.withColumn("cumulative", F.sum("net").over(running(by("sleeve", order="period"))))


def ledger_warnings(daily: DataFrame, fills: DataFrame, prices: DataFrame, cashflows: DataFrame | None = None, end: str | None = None, least: float = 1.0) -> DataFrame:
    """(scope, message): NAV at or under ``least`` with positions, value or profit before any money came in, symbols without prices,
    and entries dated after ``end``."""
    funded = F.sum(F.col("flow_in")).over(running(by("sleeve")))
    sleeve = F.concat(F.lit("sleeve "), F.col("sleeve").cast("string"))
    broke = daily.where(F.col("nav") <= least).where("abs(value) > 0").groupBy("sleeve").count().select(sleeve.alias("scope"), F.lit("NAV at or below zero with open positions").alias("message"))
    early = daily.withColumn("_funded", funded).where("_funded = 0 and (abs(value) > 0 or abs(pnl) > 0.005)").groupBy("sleeve").count().select(sleeve.alias("scope"), F.lit("profit or loss before funding").alias("message"))
    bare = fills.select("symbol").distinct().join(prices.select("symbol").distinct(), "symbol", "left_anti").select(F.col("symbol").alias("scope"), F.lit("no prices").alias("message"))
    out = broke.union(early).union(bare)
    if end is None:
        return out
    dates = fills.select("date") if cashflows is None else fills.select("date").union(cashflows.select("date"))
    late = dates.agg(F.max("date").alias("d")).where(F.col("d") > F.lit(end).cast("date")).select(F.lit("journal").alias("scope"), F.lit("entries dated after the end").alias("message"))
    return out.union(late)


def capital_summary(daily: DataFrame, cashflows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Money in and out of each sleeve, its NAV, profit, income, fees and time-weighted return. ``daily`` has returns.

    Income leaves out the journal's fee rows, which count as fees. For a whole book, give the book's rows under one sleeve.
    """
    booked = on_calendar(cashflows, calendar)
    part = lambda c: F.sum(F.when(F.expr(c), F.col("value")).otherwise(F.lit(0.0)))
    money = booked.groupBy("sleeve").agg(
        part("type = 'deposit'").alias("deposited"), F.abs(part("type = 'withdrawal'")).alias("withdrawn"), part("type = 'transfer' and value > 0").alias("transfers_in"), F.abs(part("type = 'transfer' and value < 0")).alias("transfers_out"),
        part("external").alias("net_invested"), part("type = 'fee'").alias("_fee"), F.min(F.when(F.col("external"), F.col("date"))).alias("first_flow"),
    )
    end = daily.groupBy("sleeve").agg(F.max_by("nav", "date").alias("nav"), F.sum("income").alias("income"), F.sum("fees").alias("fees"), (F.product(1 + F.col("ret")) - 1).alias("time_weighted"))
    return end.join(money, "sleeve", "left").select(
        "sleeve", "deposited", "withdrawn", "transfers_in", "transfers_out", "net_invested", "nav", (F.col("nav") - F.col("net_invested")).alias("pnl"), (F.col("income") - F.col("_fee")).alias("income"),
        (F.col("fees") - F.col("_fee")).alias("fees"), "time_weighted", "first_flow",
    )


def kpis(daily: DataFrame) -> DataFrame:
    """The figures of each sleeve's last day, and its returns of the month, the year and since inception. ``daily`` has returns."""
    last = daily.withColumn("_end", F.max("date").over(Window.partitionBy("sleeve")))
    since = lambda unit: F.coalesce(F.product(F.when(F.col("date") >= F.trunc("_end", unit), 1 + F.col("ret"))), F.lit(1.0)) - 1
    at = lambda c: F.max_by(c, "date")
    x = last.groupBy("sleeve").agg(
        at("nav").alias("nav"), F.sum(F.col("flow_in") + F.col("flow_out")).alias("net_invested"), at("pnl").alias("day_pnl"), at("cash").alias("cash"), at(F.col("long") - F.col("short")).alias("gross"),
        at(F.col("long") + F.col("short")).alias("net"), F.max_by("ret", F.when(F.col("ret").isNotNull(), F.col("date"))).alias("day_return"), since("month").alias("mtd"), since("year").alias("ytd"), (F.coalesce(F.product(1 + F.col("ret")), F.lit(1.0)) - 1).alias("itd"), F.max("date").alias("as_of"),
    )
    share = lambda c: (F.col(c) / F.nullif("nav", F.lit(0.0))).alias(c)
    return x.select("sleeve", "nav", "net_invested", (F.col("nav") - F.col("net_invested")).alias("pnl"), "day_pnl", "cash", share("gross"), share("net"), "day_return", "mtd", "ytd", "itd", "as_of")
