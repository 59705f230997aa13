"""A daily stock-picking account for many configurations at once.

Cash couples the symbols of an account and each day needs the one before, so an account cannot be cut. Accounts are independent of each
other: they are dealt out in batches, and a task takes one batch through the days. The panel comes to it as a stream ordered by
date; the task holds the state of its accounts as arrays (account, symbol) and one day of quotes, never the panel. So the panel is read
once a batch, not once an account.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import YEAR
from .metrics import cagr_of, drawdown, sharpe_of

#: Accounts that one task runs side by side.
BATCH = 64
#: What a panel row holds besides symbol and date; ``fast`` is an array of 0 or 1, one for each of the configurations' fast averages.
QUOTES = ("open", "high", "low", "close", "adjust")
KNOWN = ("slow", "score", "before", "size", "vol")


@dataclass(frozen=True)
class Rules:
    """What all accounts share: limits, costs and modes."""

    capital: float = 100_000.0
    exit_score: float = 7.0
    stop: float | None = 0.25
    max_days: int | None = None
    target: bool = True  #: sell where the day before's slow average is reached
    market: str | None = None  #: where the market is off: None, "hold" (no entries) or "sell"
    rank: str = "size"  #: or "upside" or "score"
    upgrades: bool = False  #: enter only where the last filing lifted the score over ``exit_score``
    missing: int = 10  #: days without a quote until a position is sold at its last close
    slip: float = 5e-4
    slip_stop: float = 1e-3
    fee_order: float = 0.0
    fee_share: float = 3e-6  #: of each share, both ways
    fee_value: float = 2.78e-5  #: of sales
    fee_sold: float = 1.66e-4  #: of each share sold, up to ``fee_sold_most``
    fee_sold_most: float = 8.3
    bounds: tuple[float, float] = (0.5, 2.0)  #: of sizes by inverse volatility
    least: float = 0.02  #: an entry below this share of the budget ends the day's entries


SCHEMA = """kind string, config string, date date, symbol string, reason string, equity double, invested double, positions int, entry_date date, entry double, exit double,
 ret double, pnl double, fees double, days int, bars int, score double, weight double, amount double"""
_NAMES = [x.split()[0] for x in SCHEMA.replace("\n", " ").split(",")]
_TYPES = {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "int": pa.int32()}
_ARROW = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in SCHEMA.replace("\n", " ").split(",")])


class Accounts:
    """The state of a batch of accounts. Settings are arrays (account) or, of schedules, lists of (from ordinal, settings)."""

    def __init__(self, schedules: dict[str, list[dict]], symbols: list[str], sectors: np.ndarray, rules: Rules):
        self.names, self.symbols, self.sectors, self.rules = list(schedules), symbols, sectors, rules
        self.schedules = [sorted(schedules[n], key=lambda s: s["since"] or 0) for n in self.names]
        shape = len(self.names), len(symbols)
        self.cash = np.full(shape[0], rules.capital)
        self.equity = self.cash.copy()
        self.amount, self.shares, self.paid, self.entry, self.fee, self.stop, self.score0, self.size0, self.weight = (np.zeros(shape) for _ in range(9))
        self.bar, self.date0, self.gap = (np.zeros(shape, np.int64) for _ in range(3))
        self.known = {k: np.full(shape[1], np.nan) for k in KNOWN}
        self.ok, self.fast = np.zeros(shape[1], bool), None
        self.last = np.full(shape[1], np.nan)  # adjusted close
        self.factor = np.ones(shape[1])
        self.reference, self.market, self.day, self.ordinal = np.nan, True, -1, 0
        self.rows: list[tuple] = []

    held = property(lambda self: self.amount > 0)

    def settings(self) -> dict[str, np.ndarray]:
        """Each account's settings in force: the last of its schedule that has begun, or the first."""
        now = [([s for s in plan if (s["since"] or 0) <= self.ordinal] or plan[:1])[-1] for plan in self.schedules]
        return {k: np.array([s[k] for s in now]) for k in ("fast", "per_sector", "least_score", "slots", "inverse")}

    def sell(self, which: np.ndarray, price: np.ndarray, reason: str, slip: float) -> None:
        a, s = np.nonzero(which)
        if not len(a):
            return
        r, px = self.rules, np.broadcast_to(price, which.shape)[a, s]
        value = self.amount[a, s] * px * (1 - slip) * self.factor[s]
        shares = self.shares[a, s]
        fee = r.fee_order + r.fee_value * value + np.minimum(r.fee_sold * shares, r.fee_sold_most) + r.fee_share * shares
        got, paid = value - fee, self.paid[a, s]
        np.add.at(self.cash, a, got)
        for i in range(len(a)):
            why = "target below entry" if reason == "target" and got[i] <= paid[i] else reason
            x, y = a[i], s[i]
            self.rows.append(("trade", self.names[x], self.ordinal, self.symbols[y], why, None, None, None, self.date0[x, y], self.entry[x, y], px[i], got[i] / paid[i] - 1, got[i] - paid[i],
                              self.fee[x, y] + fee[i], self.ordinal - self.date0[x, y], self.day - self.bar[x, y], self.score0[x, y], self.weight[x, y], self.size0[x, y]))
        self.amount[a, s] = 0.0

    def leaving(self) -> list[tuple[str, np.ndarray]]:
        """Positions that go at the next open by what is known, with the reason; the first reason counts."""
        r, held, out = self.rules, self.held.copy(), []
        for reason, rule in (
            ("market", np.full(held.shape, r.market == "sell" and not self.market)),
            ("score", np.broadcast_to(~(self.known["score"] >= r.exit_score), held.shape)),
            ("time", self.day + 1 - self.bar >= r.max_days if r.max_days else np.zeros(held.shape, bool)),
        ):
            out.append((reason, held & rule))
            held &= ~rule
        return out

    def entries(self, opens: np.ndarray | None):
        """(symbol, accounts, amounts) of purchases, best first; without ``opens`` (the plan for the next day) no quote is asked for.
        The caller books each before it asks for the next."""
        r, k, p = self.rules, self.known, self.settings()
        live = np.full(len(self.names), r.market is None or self.market)
        good = self.ok & np.isfinite(k["score"])
        if r.upgrades:
            good &= k["before"] < r.exit_score
        key = {"size": k["size"], "upside": k["slow"] / np.where(self.last > 0, self.last / self.factor, np.nan), "score": k["score"]}[r.rank]
        at = np.flatnonzero(good)
        at = at[np.lexsort((-k["size"][at], -key[at]))]
        budget = self.equity / p["slots"]
        for j in at:
            if opens is not None and not (np.isfinite(opens[j]) and opens[j] < k["slow"][j]):
                continue
            held = self.held
            in_sector = held[:, self.sectors == self.sectors[j]].sum(axis=1)
            want = live & (held.sum(axis=1) < p["slots"]) & ~held[:, j] & (self.fast[j][p["fast"]] > 0) & (k["score"][j] >= p["least_score"]) & ((p["per_sector"] == 0) | (in_sector < p["per_sector"]))
            size = np.clip(self.reference / k["vol"][j], *r.bounds) if k["vol"][j] > 0 and np.isfinite(self.reference) else 1.0
            spend = np.minimum(budget * np.where(p["inverse"], size, 1.0), self.cash)
            live &= ~(want & (spend < r.least * budget))
            a = np.flatnonzero(want & live)
            if len(a):
                yield j, a, spend[a]

    def trade(self, ordinal: int, quotes: dict[str, np.ndarray]) -> None:
        """One day: exits at the open, entries at the open, stops and targets within the day, the mark at the close."""
        r = self.rules
        leaving = self.leaving()  # decided by what the day before knew
        self.day, self.ordinal = self.day + 1, ordinal
        o, quoted = quotes["open"], np.isfinite(quotes["open"])
        self.factor = np.where(np.isfinite(quotes["adjust"]), quotes["adjust"], self.factor)
        self.gap = np.where(quoted, 0, self.gap + 1)
        self.sell(self.held & (self.gap >= r.missing) & ~quoted, self.last / self.factor, "no quote", 0.0)
        for reason, which in leaving:
            self.sell(which & self.held & quoted, o, reason, r.slip)
        for j, a, spend in self.entries(o):
            fill = o[j] * (1 + r.slip)
            fee = r.fee_order + r.fee_share * spend / fill
            self.cash[a] -= spend
            self.amount[a, j], self.shares[a, j] = (spend - fee) / (fill * self.factor[j]), (spend - fee) / fill
            self.paid[a, j], self.fee[a, j], self.entry[a, j], self.weight[a, j] = spend, fee, o[j], spend / self.equity[a]
            self.bar[a, j], self.date0[a, j], self.score0[a, j], self.size0[a, j], self.gap[a, j] = self.day, ordinal, self.known["score"][j], self.known["size"][j], 0
            self.stop[a, j] = o[j] * (1 - r.stop) if r.stop else -np.inf
        goal = np.where(np.isfinite(self.known["slow"]), self.known["slow"], np.inf) if r.target else np.full(len(o), np.inf)
        now = lambda: self.held & quoted
        with np.errstate(invalid="ignore"):
            self.sell(now() & (o >= goal), o, "target", 0.0)
            self.sell(now() & (o <= self.stop), o, "stop", r.slip_stop)
            self.sell(now() & (quotes["low"] <= self.stop), self.stop, "stop", r.slip_stop)
            self.sell(now() & (quotes["high"] >= goal), goal, "target", 0.0)
        close = quotes["close"] * self.factor
        self.last = np.where(np.isfinite(close), close, self.last)
        value = np.where(self.held, self.amount * self.last, 0.0).sum(axis=1)
        self.equity = self.cash + value
        counts = self.held.sum(axis=1)
        self.rows += [("day", n, ordinal, None, None, e, v, int(c), *[None] * 11) for n, e, v, c in zip(self.names, self.equity.tolist(), value.tolist(), counts.tolist(), strict=True)]

    def learn(self, day: dict, seen: np.ndarray) -> None:
        """What is known after the day's close. A symbol without a row keeps its figures, but is no candidate."""
        for k in KNOWN:
            self.known[k][seen] = day[k][seen]
        self.ok = seen & (day["ok"] > 0)
        if self.fast is None:
            self.fast = np.zeros((len(self.symbols), day["fast"].shape[1]))
        self.fast[seen] = day["fast"][seen]
        self.reference, self.market = day["reference"], day["market"]

    def finish(self) -> None:
        """Open positions, and what the next open would do: sales by reason, then purchases with their amounts."""
        for a, s in zip(*np.nonzero(self.held), strict=True):
            self.rows.append(("open", self.names[a], self.ordinal, self.symbols[s], None, None, None, None, self.date0[a, s], self.entry[a, s], self.last[s] / self.factor[s], self.amount[a, s] * self.last[s] / self.paid[a, s] - 1, None, None,
                              self.ordinal - self.date0[a, s], self.day - self.bar[a, s], self.known["score"][s], self.weight[a, s], self.amount[a, s] * self.last[s]))
        for reason, which in self.leaving():
            for a, s in zip(*np.nonzero(which), strict=True):
                value = self.amount[a, s] * self.last[s]
                self.rows.append(("sell", self.names[a], self.ordinal, self.symbols[s], reason, *[None] * 13, value))
                self.cash[a] += value
                self.amount[a, s] = 0.0
        for j, a, spend in self.entries(None):
            self.rows += [("buy", self.names[x], self.ordinal, self.symbols[j], None, *[None] * 11, self.known["score"][j], y / self.equity[x], y) for x, y in zip(a.tolist(), spend.tolist(), strict=True)]
            self.cash[a] -= spend
            self.amount[a, j] = 1e-300  # held from now on, worth nothing yet

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type, from_pandas=True) if t.type != pa.date32() else pa.array(c, pa.int32()).cast(pa.date32()) for c, t in zip(zip(*rows, strict=True), _ARROW)] if rows else [pa.nulls(0, t.type) for t in _ARROW], schema=_ARROW)


def run_accounts(panel: DataFrame, configs: list[dict], rules: Rules | dict[str, Rules] = Rules(), start: str | None = None) -> DataFrame:
    """(kind, config, date, ...) of every account: "day" (equity, invested, positions), "trade" (entries and exits with reason, return, fees,
    days, and the size at entry as amount), "open" (what is held at the end), "sell" and "buy" (the plan for the next open, with amounts).

    ``panel``: (symbol, date, sector, QUOTES, KNOWN, ok, fast, reference, market), one row for each symbol and day. ``ok`` marks candidates,
    ``fast`` which fast averages the close is over, ``reference`` is the median volatility, ``market`` whether it is on. Decisions use
    the rows of the day before. ``configs``: dicts of config, fast (a place in ``fast``), per_sector (0: no limit), least_score, slots,
    inverse (size by volatility), and since (a date or None) for a schedule of several settings of one config. With several ``rules``
    each config runs under each of them, or under its ``variant`` alone, and is named "variant|config". Trading begins on ``start``;
    earlier rows only inform.
    """
    spark = panel.sparkSession
    # the listed symbols and the settings are short lists
    listed = [(r.symbol, r.sector) for r in panel.groupBy("symbol").agg(F.min("sector").alias("sector")).orderBy("symbol").collect()]
    symbols = [s for s, _ in listed]
    sectors = np.unique(np.array([str(x) for _, x in listed]), return_inverse=True)[1] if listed else np.zeros(0, int)
    begin = 0 if start is None else int((np.datetime64(start) - np.datetime64("1970-01-01")).astype(int))
    kinds = rules if isinstance(rules, dict) else {"": rules}
    schedules: dict[str, list[dict]] = {}
    batches: list[tuple[Rules, list[str]]] = []
    for variant, own in kinds.items():
        names = []
        for c in configs:
            if c.get("variant", variant) != variant:
                continue
            name, since = f"{variant}|{c['config']}" if variant else c["config"], c.get("since")
            schedules.setdefault(name, []).append({**c, "since": None if since is None else int((np.datetime64(since) - np.datetime64("1970-01-01")).astype(int))})
            names.append(name)
        names = sorted(set(names))
        batches += [(own, names[i : i + BATCH]) for i in range(0, len(names), BATCH)]
    number = spark.createDataFrame([(s, i) for i, s in enumerate(symbols)], "symbol string, s int")
    x = panel.join(F.broadcast(number), "symbol").withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(len(batches) - 1))))  # listed symbols
    x = x.select("batch", F.datediff("date", F.lit("1970-01-01").cast("date")).alias("d"), "s", *QUOTES, *KNOWN, F.col("ok").cast("int").alias("ok"), "fast", "reference", F.col("market").cast("int").alias("market"))
    columns = [c for c in x.columns if c not in ("fast",)]

    def play(parts):
        accounts, current, held = None, None, []

        def day_of(rows):
            s = rows["s"].astype(np.int64)
            seen = np.zeros(len(symbols), bool)
            seen[s] = True
            out = {"reference": rows["reference"][0], "market": bool(rows["market"][0])}
            for c in (*QUOTES, *KNOWN, "ok"):
                out[c] = np.full(len(symbols), np.nan)
                out[c][s] = rows[c]
            out["fast"] = np.zeros((len(symbols), rows["fast"].shape[1]))
            out["fast"][s] = rows["fast"]
            return out, seen

        def step(rows):
            day, seen = day_of(rows)
            day["ok"] = np.nan_to_num(day["ok"])
            if int(rows["d"][0]) >= begin and accounts.fast is not None:
                accounts.trade(int(rows["d"][0]), day)
            else:
                close = day["close"] * np.where(np.isfinite(day["adjust"]), day["adjust"], 1.0)
                accounts.last = np.where(np.isfinite(close), close, accounts.last)
                accounts.factor = np.where(np.isfinite(day["adjust"]), day["adjust"], accounts.factor)
                accounts.ordinal = int(rows["d"][0])
            accounts.learn(day, seen)

        def close_off():
            step({c: np.concatenate([h[c] for h in held]) for c in held[0]})
            held.clear()

        for part in parts:
            if not part.num_rows:
                continue
            values = {c: part.column(c).to_numpy(zero_copy_only=False) for c in columns}
            values["fast"] = np.array(part.column("fast").to_pylist(), float)
            key = values["batch"].astype(np.int64) << 32 | values["d"].astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() + [len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if current is not None and key[a] != current:
                    close_off()
                    if key[a] >> 32 != current >> 32:
                        accounts.finish()
                        yield accounts.taken()
                        accounts = None
                    elif len(accounts.rows) > 20_000:
                        yield accounts.taken()
                if accounts is None:
                    own, names_ = batches[int(key[a]) >> 32]
                    accounts = Accounts({n: schedules[n] for n in names_}, symbols, sectors, own)
                current = key[a]
                held.append({c: v[a:b] for c, v in values.items()})
        if accounts is not None:
            close_off()
            accounts.finish()
            yield accounts.taken()

    dealt = x.repartition(max(1, len(batches)), "batch").sortWithinPartitions("batch", "d", "s")
    return dealt.mapInArrow(play, SCHEMA)


def days_of(run: DataFrame) -> DataFrame:
    return run.where("kind = 'day'").select("config", "date", "equity", "invested", "positions")


def returns_of(run: DataFrame, capital: float = Rules.capital) -> DataFrame:
    """(series_id, date, ret): each account's daily returns."""
    w = Window.partitionBy("config").orderBy("date")
    return days_of(run).select(F.col("config").alias("series_id"), "date", (F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(capital)) - 1).alias("ret"))


def yearly_picks(returns: DataFrame, least: int = 200) -> DataFrame:
    """(variant, year, config): for each year the config of the best Sharpe ratio over all days before it, ties to the first name.

    ``returns`` of "variant|config" accounts; a year's sums are enough, so days are read once."""
    x = returns.select(F.substring_index("series_id", "|", 1).alias("variant"), F.substring_index("series_id", "|", -1).alias("config"), F.year("date").alias("y"), "ret")
    year = x.groupBy("variant", "config", "y").agg(F.count("*").alias("n"), F.sum("ret").alias("s1"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))
    w = Window.partitionBy("variant", "config").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    past = year.select("variant", "config", F.col("y").alias("year"), F.sum("n").over(w).alias("n"), F.sum("s1").over(w).alias("s1"), F.sum("s2").over(w).alias("s2")).where(F.col("n") >= least)
    sd = F.sqrt(F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0)) / (F.col("n") - 1))
    sharpe = F.round(F.coalesce(F.col("s1") / F.col("n") / F.nullif(sd, F.lit(0.0)), F.lit(float("-inf"))), 9)
    return past.groupBy("variant", "year").agg(F.min(F.struct((-sharpe).alias("k"), "config"))["config"].alias("config"))


def walk_forward_variants(panel: DataFrame, configs: list[dict], rules: dict[str, Rules], start: str | None = None, least: int = 200) -> DataFrame:
    """The accounts "variant|walk" of each set of rules: all configs are run under it, each year takes up the config that was best
    before, and the account goes through the schedule that this makes. Trading starts with the first year that has a pick."""
    picks = yearly_picks(returns_of(run_accounts(panel, configs, rules, start)), least).orderBy("variant", "year").collect()  # a row a variant and year
    by_name = {c["config"]: c for c in configs}
    plan = [{**by_name[p.config], "config": "walk", "variant": p.variant, "since": f"{p.year}-01-01"} for p in picks]
    first = min((p.year for p in picks), default=None)
    return run_accounts(panel, plan, rules, None if first is None else f"{first}-01-01")


def risk_summary(run: DataFrame, level: float = -0.2) -> DataFrame:
    """(config, figures): an account's returns, drawdowns, trades and exits in one row. ``falls``: times that the account fell by more than ``level``
    below its peak."""
    dd = drawdown(returns_of(run)).withColumn("_under", (F.col("drawdown") < level).cast("int"))
    w = Window.partitionBy("series_id").orderBy("date")
    dd = dd.withColumn("_new", F.col("_under") * (1 - F.coalesce(F.lag("_under").over(w), F.lit(0))))
    low = F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), F.lit(2))))
    daily = dd.groupBy(F.col("series_id").alias("config")).agg(
        F.count("*").alias("days"), cagr_of(F.col("ret")).alias("cagr"), sharpe_of(F.col("ret")).alias("sharpe"), (F.avg("ret") / F.nullif(low, F.lit(0.0)) * YEAR**0.5).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), F.sum("_new").alias("falls"),
    ).withColumn("calmar", F.col("cagr") / F.nullif(F.abs("max_drawdown"), F.lit(0.0)))
    month = dd.groupBy("series_id", F.trunc("date", "month").alias("m")).agg((F.product(1 + F.col("ret")) - 1).alias("r")).groupBy(F.col("series_id").alias("config")).agg(F.min("r").alias("worst_month"))
    exposure = days_of(run).groupBy("config").agg(F.avg(F.col("invested") / F.col("equity")).alias("exposure"))
    share = lambda reason: F.avg((F.col("reason") == reason).cast("double"))
    trades = run.where("kind = 'trade'").groupBy("config").agg(
        F.count("*").alias("trades"), F.min("ret").alias("worst_trade"), F.avg("ret").alias("avg_trade"), share("stop").alias("stopped"), share("time").alias("timed"), F.max("days").alias("longest"), F.median("amount").alias("median_size"),
    )
    return daily.join(month, "config").join(exposure, "config").join(trades, "config", "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


def trades_of(run: DataFrame) -> DataFrame:
    return run.where("kind = 'trade'").select("config", "symbol", "entry_date", F.col("date").alias("exit_date"), "reason", "entry", "exit", "ret", "pnl", "fees", "days", "bars", "score", "weight")


def plan_of(run: DataFrame) -> DataFrame:
    """(config, action, symbol, reason, amount): what each account would do at the next open."""
    return run.where("kind in ('sell', 'buy')").select("config", F.col("kind").alias("action"), "symbol", "reason", "amount")
