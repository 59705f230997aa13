"""Registered queries: allocation, simulation, overfitting statistics, signals and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import allocation as al
from ..operators import orders as od
from ..operators import signals as sg
from ..operators import simulation as sim
from ..operators.timeseries import inner_align
from ..sources import testdata as v
from . import ledger_queries as lq
from .registry import query, r, rounded

CUM = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
RET, BOTH, PX = v.with_views("returns"), v.with_views("returns", "bench"), v.with_views("prices")
PAIRS = "pr AS (SELECT a.series_id AS a, b.series_id AS b, date, a.ret AS x, b.ret AS y FROM returns a JOIN returns b USING (date) WHERE a.series_id <= b.series_id)"
WEIGHTS = [("A", 0.5), ("N", 0.3), ("R", 0.1)]
WT = "wt(series_id, weight) AS (VALUES ('A', 0.5), ('N', 0.3), ('R', 0.1))"


def weights(spark):
    return spark.createDataFrame(WEIGHTS, "series_id string, weight double")


def aligned(spark, d):
    return inner_align(v.returns(spark, d), 3).select("series_id", "date", "ret")


AL = f"{RET}, al AS (SELECT * FROM returns WHERE date IN (SELECT date FROM returns GROUP BY 1 HAVING count(*) = 3))"


@query(f"{RET}, {PAIRS} SELECT a, b, {r('corr(x, y)')} AS corr, count(*) AS n FROM pr WHERE a < b GROUP BY 1, 2")
def correlations(spark, d):
    return rounded(al.correlations(v.returns(spark, d)))


@query(f"{BOTH}, bad AS (SELECT date FROM bench WHERE ret <= (SELECT quantile_cont(ret, 0.1) FROM bench)), {PAIRS} SELECT a, b, {r('corr(x, y)')} AS corr, count(*) AS n FROM pr JOIN bad USING (date) WHERE a < b GROUP BY 1, 2 HAVING count(*) > 10")
def stress_correlation(spark, d):
    return rounded(al.stress_correlation(v.returns(spark, d), v.bench(spark, d)))


#: The shrunk yearly covariance of every ordered pair.
LW = """ce AS (SELECT date, series_id, ret - avg(ret) OVER (PARTITION BY series_id) AS x FROM al), s AS (SELECT a.series_id AS a, b.series_id AS b, avg(a.x * b.x) AS s, count(*) AS t FROM ce a JOIN ce b USING (date) GROUP BY 1, 2),
 q AS (SELECT sum(z * z) AS q FROM (SELECT sum(x * x) AS z FROM ce GROUP BY date)), k AS (SELECT sum(s) FILTER (WHERE a = b) / 3 AS mu, sum(s * s) AS nm, sum(s) FILTER (WHERE a = b) AS tr, max(t) AS t FROM s),
 sh AS (SELECT mu, least(nm - mu * tr, (q - t * nm) / (t * t)) / (nm - mu * tr) AS share FROM k, q), lw AS (SELECT a, b, (share * CASE WHEN a = b THEN mu ELSE 0 END + (1 - share) * s) * 252 AS cov FROM s, sh)"""


@query(f"{AL}, {LW} SELECT a, b, {r('cov', 9)} AS cov FROM lw WHERE a <= b")
def ledoit_wolf(spark, d):
    return rounded(al.ledoit_wolf(aligned(spark, d)), 9)


@query(f"""{AL}, {WT}, x AS (SELECT series_id, date, weight, date_trunc('quarter', date) AS p, weight * product(1 + ret) OVER (PARTITION BY series_id, date_trunc('quarter', date) ORDER BY date {CUM}) AS h FROM al JOIN wt USING (series_id)),
 y AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY series_id, p ORDER BY date), weight) AS b FROM x) SELECT date, {r('(sum(h) + 0.1) / (sum(b) + 0.1) - 1', 8)} AS ret FROM y GROUP BY 1""")
def drift_rebalance_portfolio(spark, d):
    return rounded(al.drift_portfolio(aligned(spark, d), weights(spark)), 8)


@query(f"{AL}, {WT} SELECT date, {r('sum(weight * ret)', 8)} AS ret FROM al JOIN wt USING (series_id) GROUP BY 1")
def constant_mix(spark, d):
    return rounded(al.constant_mix(aligned(spark, d), weights(spark)), 8)


#: Risk parts of the weights with the shrunk covariance.
RISK = f"""{LW}, rp AS (SELECT a, wa.weight AS w, sum(wb.weight * cov) AS slope, sqrt(max(CASE WHEN a = b THEN cov END)) AS volatility FROM lw JOIN wt wa ON a = wa.series_id JOIN wt wb ON b = wb.series_id GROUP BY 1, 2), rs AS (SELECT *, sqrt(sum(w * slope) OVER ()) AS vol FROM rp), rc AS (SELECT a AS series_id, w AS weight, volatility, slope / vol AS marginal, w * slope / vol AS contribution, w * slope / (vol * vol) AS share FROM rs)"""


@query(f"{AL}, {WT}, {RISK} SELECT series_id, CAST(weight AS DOUBLE) AS weight, {', '.join(f'{r(c, 7)} AS {c}' for c in ('volatility', 'marginal', 'contribution', 'share'))} FROM rc")
def risk_contributions(spark, d):
    return rounded(al.risk_contributions(aligned(spark, d), weights(spark)), 7)


@query(f"{RET}, w(name, start, fin) AS (VALUES ('one', DATE '1995-06-01', DATE '1995-09-30'), ('two', DATE '1999-01-01', DATE '1999-03-31'), ('late', DATE '2001-06-01', DATE '2003-01-01')), s AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM returns GROUP BY 1) SELECT name, series_id, {r('product(1 + ret) - 1')} AS ret FROM returns JOIN s USING (series_id) JOIN w ON date > start AND date <= fin WHERE lo <= start AND hi >= fin GROUP BY 1, 2")
def stress_test(spark, d):
    w = spark.createDataFrame([("one", "1995-06-01", "1995-09-30"), ("two", "1999-01-01", "1999-03-31"), ("late", "2001-06-01", "2003-01-01")], "name string, s string, e string").selectExpr("name", "date(s) start", "date(e) end")
    return rounded(al.stress_test(v.returns(spark, d), w))


@query(f"{lq.SLEEVE}, l AS (SELECT sleeve, max_by(nav, date) AS nav FROM sl GROUP BY 1), o AS (SELECT *, sum(nav) OVER () AS total, max(abs(nav / (SELECT sum(nav) FROM l) - 0.2)) OVER () AS worst FROM l) SELECT sleeve, {r('CASE WHEN worst > 0.02 THEN 0.2 * total - nav ELSE 0 END', 2)} AS transfer FROM o")
def rebalance_orders(spark, d):
    h = lq._daily(spark, d).groupBy("sleeve").agg(F.max_by("nav", "date").alias("nav")).withColumn("target", F.lit(0.2))
    return rounded(al.rebalance_orders(h, 0.02), 2)


@query("SELECT * FROM (VALUES (1, 'A'), (2, 'N'), (3, 'A,N'), (4, 'R'), (5, 'A,R'), (6, 'N,R'), (7, 'A,N,R')) t(mask, members)")
def powerset(spark, d):
    return al.powerset(v.returns(spark, d).select("series_id").distinct())


EXTRA = {"target": {"A": 3.0, "N": 1.0, "R": 1.0}, "budget": {"A": 0.5, "N": 0.3, "R": 0.2}}


@query()
def optimise_methods(spark, d):
    return rounded(al.optimise(aligned(spark, d).withColumn("grp", F.lit("all")), list(al.METHODS), cap=0.6, floor=0.05, extra=EXTRA))


def _one_method(spark, d, method):
    return rounded(al.optimise(aligned(spark, d).withColumn("grp", F.lit("all")), [method], cap=0.6, extra=EXTRA).select("series_id", "weight"))


@query(f"{AL} SELECT series_id, {r('1.0 / 3')} AS weight FROM al GROUP BY 1")
def opt_equal(spark, d):
    return _one_method(spark, d, "equal")


@query("SELECT * FROM (VALUES ('A', 0.6e0), ('N', 0.2e0), ('R', 0.2e0)) t(series_id, weight)")
def opt_target(spark, d):
    return _one_method(spark, d, "target")


@query(f"{AL}, {LW} SELECT a AS series_id, {r('1 / sqrt(cov) / sum(1 / sqrt(cov)) OVER ()')} AS weight FROM lw WHERE a = b")
def opt_inverse_vol(spark, d):
    return _one_method(spark, d, "inverse_vol")


@query(f"""{AL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, date_trunc('quarter', date) AS q FROM al), m AS (SELECT series_id, date, q, 1.0 / 3 * product(1 + ret) OVER (PARTITION BY series_id, q, date_trunc('month', date) ORDER BY date {CUM}) AS h, date_trunc('month', date) AS mo FROM n WHERE i >= 756),
 b AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY series_id, q, mo ORDER BY date), 1.0 / 3) AS b FROM m) SELECT 'equal' AS method, CAST(q AS DATE) AS quarter, date, {r('sum(h) / sum(b) - 1', 8)} AS ret FROM b GROUP BY q, date""")
def alloc_walk_forward(spark, d):
    return rounded(al.walk_forward(aligned(spark, d), ["equal"]).drop("weights"), 8)


@query()
def walk_forward_methods(spark, d):
    return rounded(al.walk_forward(aligned(spark, d), ["min_variance", "risk_parity", "max_sharpe"], cap=0.6, extra=EXTRA).drop("weights"), 8)


@query()
def compare_methods(spark, d):
    return rounded(al.compare_methods(aligned(spark, d), list(al.METHODS), cap=0.6, extra=EXTRA | {"resamples": 30}))


@query()
def recommend(spark, d):
    return al.recommend(al.compare_methods(aligned(spark, d), list(al.METHODS), cap=0.6, extra=EXTRA | {"resamples": 30}))


@query()
def explore(spark, d):
    return rounded(al.rank_combinations(al.explore(aligned(spark, d), ["equal", "risk_parity", "max_sharpe"], cap=0.6)))


@query()
def efficient_frontier(spark, d):
    return rounded(al.efficient_frontier(aligned(spark, d), cap=0.6).drop("weights"))


@query(f"{RET}, w AS (SELECT series_id, date_trunc('quarter', date) AS p, 1 / stddev_samp(ret) AS v FROM returns GROUP BY 1, 2), n AS (SELECT series_id, p, v / sum(v) OVER (PARTITION BY p) AS w FROM w), c AS (SELECT p, abs(w - lag(w) OVER (PARTITION BY series_id ORDER BY p)) AS d FROM n), t AS (SELECT p, sum(d) / 2 AS t FROM c WHERE d IS NOT NULL GROUP BY 1) SELECT 'inverse_vol' AS method, {r('avg(t)')} AS turnover FROM t")
def weight_turnover(spark, d):
    x = v.returns(spark, d).groupBy("series_id", F.date_trunc("quarter", "date").alias("period")).agg((1 / F.stddev_samp("ret")).alias("v"))
    x = x.select("series_id", "period", F.lit("inverse_vol").alias("method"), (F.col("v") / F.sum("v").over(Window.partitionBy("period"))).alias("weight"))
    return rounded(al.weight_turnover(x))


NUM = "nm AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, ret FROM returns)"


@query(f"{RET}, m AS (SELECT series_id, date, ret, avg(ret) OVER (PARTITION BY date) AS mo FROM returns) SELECT series_id, count(*) AS n, {r('product(1 + ret) - product(1 + mo)')} AS shortfall, {r('stddev_samp(ret - mo) * sqrt(252)')} AS tracking_error, {r('corr(ret, mo)')} AS corr, {r('covar_samp(ret, mo) / var_samp(mo)')} AS beta FROM m GROUP BY 1")
def tracking(spark, d):
    x = v.returns(spark, d)
    model = x.select("series_id", "date", F.avg("ret").over(Window.partitionBy("date")).alias("ret"))
    return rounded(sim.tracking(x, model))


@query(f"{RET}, {NUM}, c AS (SELECT series_id, count(*) AS n FROM nm GROUP BY 1), ps AS (SELECT series_id, i, CASE WHEN ret > 0.0003 THEN 1.0 ELSE 0.0 END AS position FROM nm), sh AS (SELECT range * 100 AS shift FROM range(20)), mv AS (SELECT series_id, shift, (i + shift) % n AS i, position FROM ps JOIN c USING (series_id), sh) SELECT series_id, CAST(shift AS INTEGER) AS shift, {r('avg(position * ret)', 8)} AS mean FROM mv JOIN nm USING (series_id, i) GROUP BY 1, 2")
def circular_shift_test(spark, d):
    x = sim.numbered(v.returns(spark, d))
    pos = x.select("series_id", "i", (F.col("ret") > 0.0003).cast("double").alias("position"))
    shifts = spark.range(20).select((F.col("id") * 100).cast("int").alias("shift"))
    return rounded(sim.circular_shift(x.select("series_id", "i", "ret"), pos, shifts), 8)


@query(f"""{RET}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM returns), b AS (SELECT series_id, CAST(floor((i - n % 8) / (n // 8)) AS INTEGER) AS b, ret FROM i WHERE i >= n % 8), s AS (SELECT series_id, b, count(*) AS n, sum(ret) AS s1, sum(ret * ret) AS s2 FROM b GROUP BY 1, 2),
 mk AS (SELECT range AS mask FROM range(256) WHERE bit_count(range) = 4), p AS (SELECT mask, series_id, (mask >> b) & 1 AS ins, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2 FROM s, mk GROUP BY 1, 2, 3), sr AS (SELECT mask, series_id, ins, s1 / n / sqrt((s2 - s1 * s1 / n) / (n - 1)) AS sr FROM p),
 w AS (SELECT mask, series_id, max(sr) FILTER (WHERE ins = 1) AS a, max(sr) FILTER (WHERE ins = 0) AS o FROM sr GROUP BY 1, 2), k AS (SELECT *, rank() OVER (PARTITION BY mask ORDER BY o) / 4.0 AS w, row_number() OVER (PARTITION BY mask ORDER BY a DESC, series_id) AS f FROM w) SELECT mask, series_id AS best, {r('ln(w / (1 - w))')} AS logit FROM k WHERE f = 1""")
def pbo_cscv(spark, d):
    return rounded(sim.pbo_cscv(sim.block_sums(v.returns(spark, d), "series_id", 8), "series_id", 8))


@query(f"""{PX}, m AS (SELECT p.symbol, p.date, p.close, CASE WHEN b.close IS NOT NULL THEN CASE WHEN p.close / b.close - 1 > 0 THEN 1 ELSE 0 END END AS signal FROM (SELECT *, date - INTERVAL 90 DAY AS ref FROM prices) p ASOF LEFT JOIN prices b ON p.symbol = b.symbol AND p.ref >= b.date),
 x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS asset, lag(signal) OVER (PARTITION BY symbol ORDER BY date) AS position FROM m), y AS (SELECT * FROM x WHERE position IS NOT NULL AND asset IS NOT NULL) SELECT symbol, date, CAST(position AS INTEGER) AS position, {r('position * asset - abs(position - coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY date), 0)) * 10 / 1e4')} AS ret FROM y""")
def longflat_backtest(spark, d):
    return rounded(sg.longflat(sg.momentum_signal(v.prices(spark, d), 90), ["symbol"], 10).select("symbol", "date", "position", "ret"))


@query(f"""{PX}, """ + ", ".join(f"m{n} AS (SELECT 's{n}' AS config, p.symbol, p.date, p.close, CASE WHEN b.close IS NOT NULL THEN CASE WHEN p.close / b.close - 1 > 0 THEN 1 ELSE 0 END END AS signal FROM (SELECT *, date - INTERVAL {n} DAY AS ref FROM prices) p ASOF LEFT JOIN prices b ON p.symbol = b.symbol AND p.ref >= b.date)" for n in (30, 90, 180)) +
       f""", m AS (SELECT * FROM m30 UNION ALL SELECT * FROM m90 UNION ALL SELECT * FROM m180), x AS (SELECT *, close / lag(close) OVER (PARTITION BY config, symbol ORDER BY date) - 1 AS asset, lag(signal) OVER (PARTITION BY config, symbol ORDER BY date) AS position FROM m), y AS (SELECT * FROM x WHERE position IS NOT NULL AND asset IS NOT NULL),
 z AS (SELECT config, symbol, position, abs(position - coalesce(lag(position) OVER (PARTITION BY config, symbol ORDER BY date), 0)) AS ch FROM y) SELECT config, symbol, {r('avg(position)')} AS in_market, CAST(sum(ch) AS BIGINT) AS switches FROM z GROUP BY 1, 2""")  # fmt: skip
def exposure_switches(spark, d):
    x = sg.run_lookbacks(v.prices(spark, d), [30, 90, 180], 10)
    return rounded(x.groupBy("config", "symbol").agg(F.avg("position").alias("in_market"), F.sum((F.col("cost") > 0).cast("long")).alias("switches")))


#: Signals of five sleeves on the brands, with next weights and trade dates; holdings are the sums of the sleeves' fills.
SIGNALS = """sg AS (SELECT s.sleeve, o.symbol, CASE WHEN (k + s.sleeve) % 5 = 0 THEN 2e-1 ELSE 0e0 END AS weight, CASE WHEN s.sleeve < 3 THEN CASE WHEN (k + s.sleeve) % 4 = 0 THEN 15e-2 ELSE 0e0 END END AS next_weight, CASE s.sleeve WHEN 0 THEN DATE '2002-01-31' WHEN 1 THEN DATE '2002-02-20' END AS next_trade, CAST('2002-02-0' || (s.sleeve + 1) AS DATE) AS as_of
 FROM (SELECT DISTINCT sleeve FROM fills) s, (SELECT symbol, CAST(substr(symbol, 7) AS INTEGER) AS k FROM prices GROUP BY 1) o),
 cw AS (SELECT sleeve, symbol, coalesce(CASE WHEN next_trade <= DATE '2002-02-10' THEN next_weight ELSE weight END, 0) AS weight, CASE WHEN next_trade <= DATE '2002-02-10' THEN 'due' WHEN next_trade IS NOT NULL AND max((coalesce(next_weight, 0) <> weight)::INT) OVER (PARTITION BY sleeve) = 1 THEN 'scheduled' WHEN next_trade IS NOT NULL THEN 'none' END AS change FROM sg)"""


def _signals(spark, d):
    s, o = v.fills(spark, d, numbered=False).select("sleeve").distinct(), v.prices(spark, d).select("symbol", F.expr("cast(substr(symbol, 7) as int)").alias("k")).distinct()
    weight = F.when((F.col("k") + F.col("sleeve")) % 5 == 0, 0.2).otherwise(0.0)
    later = F.when(F.col("sleeve") < 3, F.when((F.col("k") + F.col("sleeve")) % 4 == 0, 0.15).otherwise(0.0))
    trade = F.when(F.col("sleeve") == 0, F.lit("2002-01-31")).when(F.col("sleeve") == 1, F.lit("2002-02-20")).cast("date")
    return s.join(F.broadcast(o)).select("sleeve", "symbol", weight.alias("weight"), later.alias("next_weight"), trade.alias("next_trade"), F.concat(F.lit("2002-02-0"), (F.col("sleeve") + 1).cast("string")).cast("date").alias("as_of"))


@query(f"{v.with_views('fills', 'prices')}, {SIGNALS} SELECT sleeve, symbol, {r('weight')} AS weight, change FROM cw")
def current_weights(spark, d):
    return rounded(od.current_weights(_signals(spark, d), "2002-02-10"))


@query(f"{v.with_views('fills', 'prices')}, {SIGNALS}, x AS (SELECT DISTINCT sleeve, as_of, next_trade FROM sg), y AS (SELECT *, (SELECT count(*) FROM generate_series(as_of + INTERVAL 1 DAY, TIMESTAMP '2002-03-03', INTERVAL 1 DAY) g(t) WHERE isodow(t) <= 5) AS days FROM x) SELECT sleeve, as_of, CAST(days AS INTEGER) AS days, CASE WHEN next_trade IS NOT NULL THEN DATE '2002-03-04' >= date_trunc('month', next_trade + INTERVAL 1 MONTH) ELSE days > 1 END AS stale FROM y")
def is_stale(spark, d):
    return od.is_stale(_signals(spark, d).select("sleeve", "as_of", "next_trade").distinct(), "2002-03-04").select("sleeve", "as_of", "days", "stale")


PLAN = f"""{v.with_views('fills', 'prices', 'instruments')}, {SIGNALS}, hd AS (SELECT sleeve, symbol, sum(qty) AS qty FROM fills WHERE (CAST(substr(symbol, 7) AS INTEGER) + sleeve) % 5 = 0 GROUP BY 1, 2 HAVING abs(sum(qty)) > 1e-9), lp AS (SELECT symbol, max_by(close, date) AS price FROM prices GROUP BY 1),
 bt AS (SELECT coalesce(c.sleeve, h.sleeve) AS sleeve, coalesce(c.symbol, h.symbol) AS symbol, coalesce(weight, 0) AS weight, coalesce(qty, 0) AS qty FROM (SELECT * FROM cw WHERE weight > 0) c FULL JOIN hd h ON c.sleeve = h.sleeve AND c.symbol = h.symbol),
 wt AS (SELECT *, 1e6 * (sleeve + 1) AS capital, 1e6 * (sleeve + 1) * weight / (price * multiplier) AS u, qty * price * multiplier / (1e6 * (sleeve + 1)) AS cur FROM bt JOIN lp USING (symbol) JOIN instruments USING (symbol)),
 tg AS (SELECT *, CASE WHEN future THEN round_even(u, 0) ELSE floor(u + 1e-9) END AS target_qty FROM wt), st AS (SELECT *, max(((weight > 0) <> (abs(qty) > 1e-9))::INT) OVER (PARTITION BY sleeve) AS flips, max(abs(cur - weight)) OVER (PARTITION BY sleeve) AS drift FROM tg)"""


def _plan_inputs(spark, d):
    held = v.fills(spark, d, numbered=False).where("(cast(substr(symbol, 7) as int) + sleeve) % 5 = 0").groupBy("sleeve", "symbol").agg(F.sum("qty").alias("qty"))
    capital = held.select("sleeve").distinct().withColumn("capital", 1e6 * (F.col("sleeve") + 1))
    return od.current_weights(_signals(spark, d), "2002-02-10"), held, od.last_prices(v.prices(spark, d)), capital, v.instruments(spark, d)


@query(f"{PLAN} SELECT sleeve, symbol, CASE WHEN target_qty > qty THEN 'BUY' ELSE 'SELL' END AS side, abs(target_qty - qty) AS quantity, {r('price')} AS price, {r('abs(target_qty - qty) * price * multiplier', 3)} AS value, CASE WHEN flips = 1 THEN 'signal change' ELSE 'drift' END AS reason FROM st WHERE (flips = 1 OR drift > 0.1) AND abs(target_qty - qty) >= 1e-9")
def plan_weights(spark, d):
    x = od.plan_weights(*_plan_inputs(spark, d))
    return rounded(x).withColumn("value", F.round("value", 3) + F.lit(0.0))


@query(f"{PLAN}, m AS (SELECT sleeve, symbol, CASE WHEN CAST(substr(symbol, 7) AS INTEGER) % 3 = 0 THEN 'stop' ELSE '' END AS exit FROM cw WHERE weight > 0), h AS (SELECT * FROM hd WHERE qty > 1e-9) SELECT coalesce(h.sleeve, m.sleeve) AS sleeve, coalesce(h.symbol, m.symbol) AS symbol, CASE WHEN m.symbol IS NULL THEN 'not in model' WHEN h.symbol IS NULL THEN 'not held' WHEN exit <> '' THEN 'exit' ELSE 'hold' END AS status FROM h FULL JOIN m ON h.sleeve = m.sleeve AND h.symbol = m.symbol WHERE h.symbol IS NOT NULL OR exit = ''")
def missing_vs_model(spark, d):
    targets, held, *_ = _plan_inputs(spark, d)
    model = targets.where("weight > 0").select("sleeve", "symbol", F.when(F.expr("cast(substr(symbol, 7) as int) % 3 = 0"), "stop").otherwise("").alias("exit"))
    return od.missing_vs_model(held, model)


NAVS = f"{lq.SLEEVE}, n AS (SELECT sleeve, max_by(nav, date) AS nav FROM sl GROUP BY 1), oc AS (SELECT sleeve, (SELECT sum(nav) FROM n) * 0.9 * (0.1 + 0.05 * sleeve) AS capital FROM n)"


def _navs(spark, d):
    nav = lq._daily(spark, d).groupBy("sleeve").agg(F.max_by("nav", "date").alias("nav"))
    return nav, nav.select("sleeve", (0.1 + 0.05 * F.col("sleeve")).alias("weight"))


@query(f"{NAVS} SELECT sleeve, {r('capital', 2)} AS capital FROM oc")
def order_capital(spark, d):
    return rounded(od.order_capital(*_navs(spark, d), 0.9), 2)


#: The plan on each sleeve's share of the account.
ORDERS = PLAN[len(v.with_views("fills", "prices", "instruments")) :].replace("1e6 * (sleeve + 1) AS capital", "capital").replace("1e6 * (sleeve + 1)", "capital").replace("FROM bt JOIN lp", "FROM bt JOIN oc USING (sleeve) JOIN lp")


@query(f"{NAVS}{ORDERS} SELECT sleeve, symbol, CASE WHEN target_qty > qty THEN 'BUY' ELSE 'SELL' END AS side, abs(target_qty - qty) AS quantity, CASE WHEN flips = 1 THEN 'signal change' ELSE 'drift' END AS reason FROM st WHERE (flips = 1 OR drift > 0.1) AND abs(target_qty - qty) >= 1e-9 AND capital > 0")
def order_plans(spark, d):
    """Every sleeve's orders to its signal's weights, on its share of nine tenths of the account."""
    targets, held, prices, _, instruments = _plan_inputs(spark, d)
    return od.order_plans(targets, held, prices, *_navs(spark, d), 0.9, instruments).select("sleeve", "symbol", "side", "quantity", "reason")


@query(f"{lq.FP}, {lq.POS} SELECT sleeve, symbol, {r('max_by(qty, date)')} AS qty FROM val GROUP BY 1, 2 HAVING abs(max_by(qty, date)) > 1e-9")
def sleeve_positions(spark, d):
    return rounded(od.sleeve_positions(lq._positions(spark, d)))


#: Nets every fill: orders of both timings, one of seven a limit order.
NET = f"{lq.FILLS}, o AS (SELECT sleeve, symbol, side, abs(qty) AS quantity, CASE WHEN seq % 2 = 0 THEN 'open' ELSE 'close' END AS timing, CASE WHEN seq % 7 = 0 THEN 'limit' ELSE 'market' END AS kind FROM fills), n AS (SELECT symbol, timing, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS q, string_agg(DISTINCT CAST(sleeve AS VARCHAR), ', ' ORDER BY CAST(sleeve AS VARCHAR)) AS strategies FROM o WHERE kind = 'market' GROUP BY 1, 2) SELECT symbol, timing, CASE WHEN q > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(q) AS quantity, 'market' AS kind, strategies FROM n WHERE q <> 0 UNION ALL SELECT symbol, timing, side, quantity, kind, CAST(sleeve AS VARCHAR) FROM o WHERE kind <> 'market'"


@query(NET)
def net_orders(spark, d):
    return od.net_orders(_orders(v.fills(spark, d)))


def _orders(fills):
    return fills.select("sleeve", "symbol", "side", F.abs("qty").alias("quantity"), F.when(F.col("seq") % 2 == 0, "open").otherwise("close").alias("timing"), F.when(F.col("seq") % 7 == 0, "limit").otherwise("market").alias("kind"))


@query("WITH e AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT day, (SELECT count(*) FROM generate_series(day::TIMESTAMP + INTERVAL 1 DAY, TIMESTAMP '2024-02-15', INTERVAL 1 DAY) g(x) WHERE isodow(x) <= 5) AS stale FROM e")
def staleness(spark, d):
    e = v.ticks(spark, d).select(F.to_date("ts").alias("day")).distinct()
    return e.select("day", od.business_days(F.col("day"), F.expr("date'2024-02-15'")).cast("long").alias("stale"))


@query(f"""{lq.SLEEVE.replace('WITH ', 'WITH RECURSIVE ', 1)}, mf AS (SELECT sleeve, date, -value AS amount FROM cashflows WHERE external UNION ALL SELECT sleeve, max(date), max_by(nav, date) FROM sl GROUP BY 1), fd AS (SELECT sleeve, date, sum(amount) AS a FROM mf GROUP BY 1, 2),
 ar AS (SELECT sleeve, list({{'t': date_diff('day', mn, date) / 365.0e0, 'a': a::DOUBLE}}) AS x, max(date_diff('day', mn, date)) / 365.0e0 AS years, bool_or(a > 0) AND bool_or(a < 0) AS mixed FROM (SELECT *, min(date) OVER (PARTITION BY sleeve) AS mn FROM fd) GROUP BY 1),
 bi AS (SELECT sleeve, -60.0e0 AS lo, 60.0e0 AS hi, list_sum(list_transform(x, lambda v: v.a * exp(60 * v.t))) AS fa, 0 AS k FROM ar UNION ALL SELECT * FROM (SELECT b.sleeve, CASE WHEN fa * fm <= 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN fa * fm <= 0 THEN (lo + hi) / 2 ELSE hi END, fa, k + 1 FROM (SELECT bi.*, list_sum(list_transform(x, lambda v: v.a * exp(-(lo + hi) / 2 * v.t))) AS fm FROM bi JOIN ar USING (sleeve) WHERE k < 100) b)),
 rt AS (SELECT sleeve, CASE WHEN mixed AND fa * list_sum(list_transform(x, lambda v: v.a * exp(-60 * v.t))) <= 0 THEN (lo + hi) / 2 END AS r, years FROM bi JOIN ar USING (sleeve) WHERE k = 100) SELECT sleeve, {r('exp(r) - 1', 5)} AS annual, {r('exp(r * years) - 1', 5)} AS period, {r('years', 5)} AS years FROM rt""")
def money_weighted_return(spark, d):
    c = v.cashflows(spark, d).where("external")
    end = lq._daily(spark, d).groupBy("sleeve").agg(F.max("date").alias("date"), F.max_by("nav", "date").alias("amount")).select("sleeve", "date", "amount")
    return rounded(od.money_weighted(c.select("sleeve", "date", (-F.col("value")).alias("amount")).union(end), "sleeve"), 5)


@query(f"{RET}, c AS (SELECT series_id, year(date) AS y, (avg(ret) / stddev_samp(ret)) AS sr, count(*) AS n FROM returns GROUP BY 1, 2), g AS (SELECT CASE series_id WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS x, CAST(y AS INTEGER) AS y, sr FROM c) SELECT CAST(a.x AS INTEGER) AS x, a.y, {r('a.sr')} AS sr, {r('avg(b.sr)')} AS neighbourhood FROM g a JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.x, a.y, a.sr")
def grid_neighbourhood(spark, d):
    g = v.returns(spark, d).groupBy("series_id", F.year("date").alias("y")).agg((F.avg("ret") / F.stddev_samp("ret")).alias("sr"))
    g = g.select(F.when(F.col("series_id") == "A", 0).when(F.col("series_id") == "N", 1).otherwise(2).alias("x"), "y", "sr")
    return rounded(sg.grid_neighbourhood(g, "x", "y", "sr"))


@query(f"{RET}, s AS (SELECT series_id, {r('avg(ret) / stddev_samp(ret)')} AS sr, {r('product(1 + ret) - 1')} AS total, {r('stddev_samp(ret)')} AS sd FROM returns GROUP BY 1) SELECT *, CAST((sr = (SELECT max(sr) FROM s))::INT + (total = (SELECT max(total) FROM s))::INT + (sd = (SELECT min(sd) FROM s))::INT AS INTEGER) AS points FROM s")
def scorecard_pick(spark, d):
    s = v.returns(spark, d).groupBy("series_id").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sr"), (F.product(1 + F.col("ret")) - 1).alias("total"), F.stddev_samp("ret").alias("sd"))
    return sg.scorecard(rounded(s), ["sr", "total"], ["sd"])


@query("WITH e AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, value FROM events) SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS k, round(sum(value), 4) + 0.0 AS value FROM e GROUP BY 1")
def event_props(spark, d):
    return rounded(v.ticks(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.sum("value").alias("value")), 4)


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS value FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    e = v.ticks(spark, d).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rounded(e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "value"), 4)


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS st FROM events), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, d):
    e = v.ticks(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
