"""Stock accounts against one plain account at a time, day by day; plans, schedules, variants and audits."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import significance as sf
from ledgerlake.operators import stockloop as sl

SCHEMA = "symbol string, date date, sector string, open double, high double, low double, close double, adjust double, slow double, score double, before double, size double, vol double, ok boolean, fast array<int>, reference double, market boolean"
DAY0 = dt.date(2020, 1, 1)


def rows(n=120, stocks=14, seed=3):
    """Stocks that move at random; some rows are missing, one stock is gone for good, and factors grow."""
    rng, out = np.random.default_rng(seed), []
    close, hist = np.full(stocks, 50.0), [[] for _ in range(stocks)]
    market = rng.random(n) > 0.2
    score = rng.integers(4, 10, (n // 20 + 1, stocks))
    for t in range(n):
        for s in range(stocks):
            o = float(close[s]) * math.exp(rng.normal(0, 0.01))
            c = o * math.exp(rng.normal(0, 0.03))
            hi, lo = max(o, c) * (1 + abs(rng.normal(0, 0.01))), min(o, c) * (1 - abs(rng.normal(0, 0.01)))
            close[s] = c
            hist[s].append(c)
            if rng.random() < 0.05 or (s == 0 and t > 60):
                continue
            slow = float(np.mean(hist[s][-30:])) * 1.02
            fast = [int(c > np.mean(hist[s][-k:])) for k in (3, 6)]
            vol = float(rng.uniform(0.1, 0.5)) if rng.random() > 0.1 else None
            out.append((f"S{s:02d}", DAY0 + dt.timedelta(t), f"sector{s % 3}", o, hi, lo, c, 1 + 0.001 * t, slow, float(score[t // 20, s]), float(score[max(0, t // 20 - 1), s]), float(c * (s + 1)), vol, bool(c < slow), fast, 0.3, bool(market[t])))
    return out


CONFIGS = [
    {"config": f"{f}{cap}{q}{n}{inv}", "fast": f, "per_sector": cap, "least_score": q, "slots": n, "inverse": inv}
    for f, cap, q, n, inv in ((0, 0, 6, 3, False), (1, 1, 7, 5, False), (0, 2, 6, 6, True), (1, 0, 4, 2, True))
]


def plain(data, plan, r, begin=0):
    """One account as a dictionary of positions. ``plan``: [(first day, settings)]."""
    names = sorted({x[0] for x in data})
    days, quotes = sorted({x[1] for x in data}), {}
    for x in data:
        quotes[x[0], x[1]] = dict(zip("symbol date sector open high low close adjust slow score before size vol ok fast reference market".split(), x))
    sector = {x[0]: x[2] for x in data}
    known, cash, held, equity, trades, curve = {}, r.capital, {}, r.capital, [], []
    last, factor, missing, was = {}, {}, {}, {}
    off = None

    def sell(s, price, slip, why):
        nonlocal cash
        p = held.pop(s)
        value = p["amount"] * price * (1 - slip) * factor[s]
        fee = r.fee_order + r.fee_value * value + min(r.fee_sold * p["shares"], r.fee_sold_most) + r.fee_share * p["shares"]
        cash += value - fee
        trades.append((s, p["day"], today, "target below entry" if why == "target" and value - fee <= p["paid"] else why, round((value - fee) / p["paid"] - 1, 9)))

    first = True
    for i, today in enumerate(days):
        row = {s: quotes[s, today] for s in names if (s, today) in quotes}
        if i >= begin and not first:
            c = [x for d, x in plan if d is None or d <= today][-1]
            gone = [(s, "market" if r.market == "sell" and not off else "score" if not known[s]["score"] >= r.exit_score else "time") for s in held
                    if (r.market == "sell" and not off) or not known[s]["score"] >= r.exit_score or (r.max_days and i - held[s]["i"] >= r.max_days)]
            for s in row:
                factor[s] = row[s]["adjust"]
            for s in names:
                missing[s] = 0 if s in row else missing.get(s, 0) + 1
            for s in [s for s in held if s not in row and missing[s] - held[s]["missed"] >= r.missing]:
                sell(s, last[s] / factor[s], 0, "no quote")
            for s, why in gone:
                if s in held and s in row:
                    sell(s, row[s]["open"], r.slip, why)
            free = c["slots"] - len(held)
            if free > 0 and (r.market is None or off):
                good = [s for s in known if was.get(s) and known[s]["score"] >= c["least_score"] and known[s]["fast"][c["fast"]]]
                good = [s for s in good if not r.upgrades or known[s]["before"] < r.exit_score]
                rank = {"size": lambda s: (-known[s]["size"],), "score": lambda s: (-known[s]["score"], -known[s]["size"]), "upside": lambda s: (-known[s]["slow"] * factor[s] / last[s], -known[s]["size"])}[r.rank]
                for s in sorted(good, key=rank):
                    if free == 0:
                        break
                    if s in held or s not in row or row[s]["open"] >= known[s]["slow"] or (c["per_sector"] and sum(sector[h] == sector[s] for h in held) >= c["per_sector"]):
                        continue
                    w = min(max(ref / known[s]["vol"], r.bounds[0]), r.bounds[1]) if c["inverse"] and known[s]["vol"] else 1.0
                    spend = min(equity / c["slots"] * w, cash)
                    if spend < r.least * equity / c["slots"]:
                        break
                    o = row[s]["open"]
                    fill = o * (1 + r.slip)
                    fee = r.fee_order + r.fee_share * spend / fill
                    cash -= spend
                    held[s] = {"amount": (spend - fee) / fill / factor[s], "shares": (spend - fee) / fill, "paid": spend, "i": i, "day": today, "stop": o * (1 - r.stop) if r.stop else -math.inf, "missed": 0}
                    free -= 1
            for s in [s for s in held if s in row]:
                q, p = row[s], held[s]
                goal = known[s]["slow"] if r.target and s in known else math.inf
                if q["open"] >= goal:
                    sell(s, q["open"], 0, "target")
                elif q["open"] <= p["stop"]:
                    sell(s, q["open"], r.slip_stop, "stop")
                elif q["low"] <= p["stop"]:
                    sell(s, p["stop"], r.slip_stop, "stop")
                elif q["high"] >= goal:
                    sell(s, goal, 0, "target")
        for s in row:
            factor[s] = row[s]["adjust"]
            last[s] = row[s]["close"] * factor[s]
        if i >= begin and not first:
            equity = cash + sum(p["amount"] * last[s] for s, p in held.items())
            curve.append((today, round(equity, 6), len(held)))
        first = False
        known |= row
        was = {s: row[s]["ok"] for s in row}
        any_ = next(iter(row.values()))
        ref, off = any_["reference"], any_["market"]
    return curve, sorted(trades), held


RULES = [
    sl.Rules(exit_score=6, stop=0.05, missing=4), sl.Rules(exit_score=5, stop=None, max_days=8, market="hold", rank="score", target=False), sl.Rules(exit_score=6, stop=0.1, market="sell", rank="upside", upgrades=True, fee_order=1.0),
]


@pytest.mark.parametrize("r", RULES)
def test_accounts_equal_a_plain_account(spark, r):
    data = rows()
    run = sl.run_accounts(spark.createDataFrame(data, SCHEMA).repartition(5), CONFIGS, r).persist()
    days, trades = {}, {}
    for x in sl.days_of(run).orderBy("date").collect():
        days.setdefault(x.config, []).append((x.date, round(x.equity, 6), x.positions))
    for x in sl.trades_of(run).collect():
        trades.setdefault(x.config, []).append((x.symbol, x.entry_date, x.exit_date, x.reason, round(x.ret, 9)))
    some = 0
    for c in CONFIGS:
        curve, done, held = plain(data, [(None, c)], r)
        assert [d[::2] for d in days[c["config"]]] == [d[::2] for d in curve]
        assert np.allclose([d[1] for d in days[c["config"]]], [d[1] for d in curve], rtol=1e-9)
        assert [x[:4] for x in sorted(trades.get(c["config"], []))] == [x[:4] for x in done]
        assert {x.symbol for x in run.where(f"kind = 'open' and config = '{c['config']}'").collect()} == set(held)
        some += len(done)
    assert some > 20
    run.unpersist()


def test_schedules_switch_and_batches_do_not_matter(spark, monkeypatch):
    data, r = rows(seed=9), RULES[0]
    late = DAY0 + dt.timedelta(60)
    plan = [{**CONFIGS[0], "config": "walk"}, {**CONFIGS[1], "config": "walk", "since": late.isoformat()}]
    panel = spark.createDataFrame(data, SCHEMA)
    got = [round(x.equity, 6) for x in sl.days_of(sl.run_accounts(panel, plan, r)).orderBy("date").collect()]
    assert np.allclose(got, [x[1] for x in plain(data, [(None, CONFIGS[0]), (late, CONFIGS[1])], r)[0]], rtol=1e-9)
    one = {(x.config, x.date): x.equity for x in sl.days_of(sl.run_accounts(panel, CONFIGS, r)).collect()}
    monkeypatch.setattr(sl, "BATCH", 1)
    assert {(x.config, x.date): x.equity for x in sl.days_of(sl.run_accounts(panel, CONFIGS, r)).collect()} == one


def test_the_plan_is_what_the_next_day_does(spark):
    """Without gaps and with opens at the close before, the next day does what the plan says."""
    data = [x for x in rows(80, seed=5)]
    cut = DAY0 + dt.timedelta(60)
    before = [x for x in data if x[1] <= cut]
    closes = {x[0]: x for x in before}
    nxt = [(s, cut + dt.timedelta(1), x[2], x[6], x[6], x[6], x[6], x[7], *x[8:]) for s, x in closes.items()]
    r = sl.Rules(exit_score=7, stop=None, target=False, slip=0, slip_stop=0, fee_share=0, fee_value=0, fee_sold=0)
    plan = {(x.config, x.action, x.symbol) for x in sl.plan_of(sl.run_accounts(spark.createDataFrame(before, SCHEMA), CONFIGS, r)).collect()}
    run = sl.run_accounts(spark.createDataFrame(before + nxt, SCHEMA), CONFIGS, r).persist()
    day = F.lit(cut + dt.timedelta(1))
    done = {(x.config, "sell", x.symbol) for x in run.where((F.col("kind") == "trade") & (F.col("date") == day)).collect()}
    done |= {(x.config, "buy", x.symbol) for x in run.where((F.col("kind") == "open") & (F.col("entry_date") == day)).collect()}
    run.unpersist()
    skipped = {p for p in plan if p[1] == "buy" and closes[p[2]][6] >= closes[p[2]][8]}
    assert done and done == plan - skipped


def test_variants_walk_through_the_best_of_the_years_before(spark):
    data = [(x[0], x[1] + dt.timedelta(365 * (i % 3)), *x[2:]) for i in range(3) for x in rows(60, seed=i)]
    data = sorted({(x[0], x[1]): x for x in data}.values(), key=lambda x: (x[1], x[0]))
    panel = spark.createDataFrame(data, SCHEMA)
    rules = {"a": RULES[0], "b": RULES[1]}
    got = sl.walk_forward_variants(panel, CONFIGS, rules, least=20)
    summary = {x.config: x for x in sl.risk_summary(got, -0.01).collect()}
    assert set(summary) == {"a|walk", "b|walk"} and summary["b|walk"].stopped in (0, None) and summary["a|walk"].timed in (0, None)
    grid = sl.returns_of(sl.run_accounts(panel, CONFIGS, rules))
    picks = {(x.variant, x.year): x.config for x in sl.yearly_picks(grid, 20).collect()}
    table = grid.toPandas()
    for (variant, year), config in picks.items():
        past = table[(table["series_id"].str.startswith(variant)) & (table["date"] < dt.date(year, 1, 1))].groupby("series_id")["ret"]
        sharpe = (past.mean() / past.std()).round(9).fillna(-np.inf)
        assert config == min(sharpe.index[sharpe == sharpe.max()]).split("|")[1]


def test_a_leak_in_an_engine_is_found(spark):
    panel = spark.createDataFrame(rows(60), SCHEMA)
    honest = lambda x: sl.days_of(sl.run_accounts(x, CONFIGS[:1], RULES[0]))
    ahead = lambda x: honest(x.join(x.select("symbol", F.date_sub("date", 5).alias("date"), F.col("close").alias("_c")), ["symbol", "date"], "left").withColumn("score", F.when(F.col("_c") > F.col("close"), 9.0).otherwise(0.0)).drop("_c"))
    check = lambda e: {(r.test): r.differing for r in sf.engine_causality(e, panel, ["2020-02-10"], ["config"], ["equity"], ["open", "high", "low", "close"]).collect()}
    assert check(honest) == {"short": 0, "shaken": 0}
    leaked = check(ahead)
    assert leaked["shaken"] > 0 and leaked["short"] > 0
