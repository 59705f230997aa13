"""Registered queries: bootstrap paths, cones, and live records against what their backtests led to expect."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import allocation as al
from ..operators import expectations as ex
from ..operators import simulation as sim
from ..sources import testdata as v
from .metric_queries import CUM, RF, _rf, phi_sql
from .portfolio_queries import AL, aligned
from .registry import query, r, rounded, u

RET = v.with_views("returns")
#: First live day, and the first day of the backtest that counts (series A: all).
LIVE, HONEST = "2001-01-01", "1996-01-01"
BLOCK, AHEAD = 63, 252
CONE_PATHS, RISK_PATHS, COMPARE_PATHS, TEST_PATHS = 2000, 4000, 3000, 1000


def starts(spark, d):
    return v.returns(spark, d).select("series_id").distinct().select("series_id", F.when(F.col("series_id") != "A", F.lit(HONEST)).cast("date").alias("start"), F.lit(LIVE).cast("date").alias("live_start"))


def expected(spark, d):
    return ex.expectation_window(v.returns(spark, d), starts(spark, d))


def live(spark, d):
    return ex.model_on_live_dates(v.returns(spark, d), starts(spark, d))


#: ew: all days with their rates; eb: the backtest's days by number; lv: the live days by number.
SPLIT = f"""{v.with_views('returns', 'yields')}, {RF}, ew AS (SELECT r.series_id, r.date, r.ret, coalesce(rf, 0) AS rf FROM returns r LEFT JOIN rf USING (date)),
 eb AS (SELECT *, ret - rf AS e, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM ew WHERE date < DATE '{LIVE}' AND (series_id = 'A' OR date >= DATE '{HONEST}')),
 lv AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS step FROM ew WHERE date >= DATE '{LIVE}'), bn AS (SELECT series_id, count(*) AS n FROM eb GROUP BY 1)"""


def drawn(source: str, sizes: str, horizon: str, paths: int, value: str, seed: int = 7) -> str:
    """ix: ``value`` of ``source`` (series_id, i) at each step of each path; ``sizes`` has series_id, n and what ``horizon`` needs."""
    return f"""bs AS (SELECT series_id, n, {horizon} AS h, p.range AS path, k.range AS k, CAST(floor({u('series_id', 'p.range', 'k.range', seed)} * n) AS BIGINT) AS st FROM {sizes}, range({paths}) p, range(100) k WHERE n >= 20 AND k.range * least({BLOCK}, n) < {horizon}),
 ix AS (SELECT b.series_id, b.path, b.k * least({BLOCK}, n) + j.range AS step, s.{value} AS v FROM bs b, range({BLOCK}) j JOIN {source} s ON s.series_id = b.series_id AND s.i = (b.st + j.range) % b.n WHERE j.range < least({BLOCK}, n) AND b.k * least({BLOCK}, n) + j.range < h)"""


#: pw: steps with excess e and whole return ret; ps: the figures of each path.
STATS = f"""pw AS (SELECT *, product(1 + ret) OVER (PARTITION BY series_id, path ORDER BY step {CUM}) AS w FROM xr), pd AS (SELECT *, w / greatest(max(w) OVER (PARTITION BY series_id, path ORDER BY step {CUM}), 1) - 1 AS dd FROM pw),
 ps AS (SELECT series_id, path, product(1 + ret) - 1 AS total, stddev_samp(ret) * sqrt(252) AS volatility, avg(e) / greatest(stddev_samp(e), any_value(fl)) * sqrt(252) AS sharpe, least(min(dd), 0) AS max_drawdown, max_by(dd, step) AS last_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM pd GROUP BY 1, 2)"""
FIGURES = "total volatility sharpe max_drawdown last_drawdown positive".split()
REBASED = f"""{SPLIT}, lz AS (SELECT series_id, count(*) AS h FROM lv GROUP BY 1), {drawn('eb', '(SELECT * FROM bn JOIN lz USING (series_id)) z', 'h', COMPARE_PATHS, 'e')}, fl AS (SELECT series_id, 0.1 * stddev_samp(e) AS fl FROM eb GROUP BY 1),
 xr AS (SELECT series_id, path, step, v AS e, v + rf AS ret, fl FROM ix JOIN lv USING (series_id, step) JOIN fl USING (series_id))"""


@query(f"{RET}, eb AS (SELECT series_id, ret AS e, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i FROM returns), bn AS (SELECT series_id, count(*) AS n FROM eb GROUP BY 1), {drawn('eb', 'bn', str(AHEAD), CONE_PATHS, 'e')}"
       f" SELECT series_id, CAST(path AS INTEGER) AS path, {r('max(v) FILTER (WHERE step = 0)', 8)} AS first, {r(f'max(v) FILTER (WHERE step = {AHEAD - 1})', 8)} AS last, {r('sum(v)', 8)} AS total, {r('sum(v * step)')} AS weighted FROM ix GROUP BY 1, 2")
def block_bootstrap(spark, d):
    x = sim.draw_paths(sim.histories(v.returns(spark, d)), AHEAD, CONE_PATHS, BLOCK)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return rounded(rounded(x.select("series_id", "path", F.col("x")[0].alias("first"), F.element_at("x", -1).alias("last"), total(F.col("x")).alias("total"), F.round(total(F.transform("x", lambda y, i: y * i)), 6).alias("weighted")), 8))


@query(f"{REBASED} SELECT series_id, CAST(path AS INTEGER) AS path, count(*) AS days, {r('sum(e)')} AS excess, {r('sum(ret)')} AS ret FROM xr GROUP BY 1, 2")
def excess_rebase(spark, d):
    x = ex.excess_rebase(expected(spark, d), live(spark, d), COMPARE_PATHS, BLOCK, _rf(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return rounded(x.select("series_id", "path", F.size("x").cast("long").alias("days"), total("x").alias("excess"), (total("x") + total("rates")).alias("ret")))


@query(f"{REBASED}, {STATS} SELECT series_id, CAST(path AS INTEGER) AS path, {', '.join(f'{r(c)} AS {c}' for c in FIGURES)} FROM ps")
def path_stats(spark, d):
    x, rf = expected(spark, d), _rf(spark, d)
    floors = x.join(rf, "date", "left").groupBy("series_id").agg((0.1 * F.stddev_samp(F.col("ret") - F.coalesce("rf", F.lit(0.0)))).alias("floor"))
    paths = ex.excess_rebase(x, live(spark, d), COMPARE_PATHS, BLOCK, rf).join(floors, "series_id")
    return rounded(sim.path_stats(paths, F.col("rates"), F.col("floor")))


QUANTILES = ", ".join(f"{r(f'quantile_cont(w, {q})')} AS p{round(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))


@query(f"""{SPLIT}, lz AS (SELECT series_id, count(*) AS h FROM lv GROUP BY 1), {drawn('eb', '(SELECT * FROM bn JOIN lz USING (series_id)) z', 'h', CONE_PATHS, 'e')}, xr AS (SELECT series_id, path, step, date, v + rf AS ret FROM ix JOIN lv USING (series_id, step)),
 pw AS (SELECT *, product(1 + ret) OVER (PARTITION BY series_id, path ORDER BY step {CUM}) AS w FROM xr) SELECT series_id, date, {QUANTILES} FROM pw GROUP BY 1, 2""")
def cone(spark, d):
    return rounded(ex.expectation_cone(expected(spark, d), live(spark, d).select("series_id", "date"), CONE_PATHS, BLOCK, _rf(spark, d)))


@query(f"""{SPLIT}, {drawn('eb', 'bn', str(AHEAD), CONE_PATHS, 'e')}, nw AS (SELECT max_by(rf, date) AS now FROM rf), en AS (SELECT series_id, max(date) AS last, product(1 + ret) AS start FROM lv GROUP BY 1),
 wd AS (SELECT series_id, start, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS step FROM (SELECT series_id, start, CAST(last + INTERVAL 1 DAY * k.range AS DATE) AS date FROM en, range(1, 400) k) WHERE isodow(date) < 6),
 pw AS (SELECT series_id, path, step, start * product(1 + v + now) OVER (PARTITION BY series_id, path ORDER BY step {CUM}) AS w FROM ix JOIN en USING (series_id), nw) SELECT series_id, date, {QUANTILES} FROM pw JOIN wd USING (series_id, step) GROUP BY 1, 2""")
def forward_cone(spark, d):
    last = live(spark, d).groupBy("series_id").agg(F.max("date").alias("last"), F.product(1 + F.col("ret")).alias("start"))
    return rounded(ex.forward_cone(expected(spark, d), last, AHEAD, CONE_PATHS, BLOCK, _rf(spark, d)))


@query(f"""{SPLIT}, {drawn('eb', 'bn', str(AHEAD), RISK_PATHS, 'e')}, nw AS (SELECT max_by(rf, date) AS now FROM rf), xr AS (SELECT series_id, path, step, v AS e, v + now AS ret, 0.0 AS fl FROM ix, nw), {STATS}
 SELECT series_id, {r('avg(CASE WHEN total < 0 THEN 1.0 ELSE 0.0 END)')} AS p_loss, {r('median(total)')} AS median, {r('quantile_cont(total, 0.05)')} AS p05, {r('median(max_drawdown)')} AS dd50, {r('quantile_cont(max_drawdown, 0.05)')} AS dd05, {r('quantile_cont(max_drawdown, 0.01)')} AS dd01 FROM ps GROUP BY 1""")
def forward_risk(spark, d):
    return rounded(ex.outlook(expected(spark, d), AHEAD, RISK_PATHS, BLOCK, _rf(spark, d)))


LIVE_FIGURES = f"""lw AS (SELECT *, product(1 + ret) OVER (PARTITION BY series_id ORDER BY date {CUM}) AS w FROM lv), ld AS (SELECT *, w / greatest(max(w) OVER (PARTITION BY series_id ORDER BY date {CUM}), 1) - 1 AS dd FROM lw),
 la AS (SELECT series_id, product(1 + ret) - 1 AS total, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret - rf) / stddev_samp(ret - rf) * sqrt(252) AS sharpe, min(dd) AS max_drawdown, max_by(dd, date) AS last_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS positive, count(*) AS days FROM ld GROUP BY 1)"""
RANK = "avg(CASE WHEN {s} < {a} THEN 1.0 WHEN {s} = {a} THEN 0.5 ELSE 0.0 END)"
#: cm: the comparison of each series and metric.
COMPARED = f"""{REBASED}, {STATS}, {LIVE_FIGURES}, su AS (UNPIVOT ps ON {', '.join(FIGURES)} INTO NAME metric VALUE sim), au AS (UNPIVOT la ON {', '.join(FIGURES)} INTO NAME metric VALUE actual),
 cm AS (SELECT series_id, metric, median(sim) AS expected, quantile_cont(sim, 0.05) AS low, quantile_cont(sim, 0.95) AS high, any_value(actual) AS actual, CASE WHEN metric = 'sharpe' AND any_value(days) < 126 THEN NULL ELSE {RANK.format(s='sim', a='actual')} END AS pc FROM su JOIN au USING (series_id, metric) GROUP BY 1, 2)"""
ONE_SIDE = "CASE WHEN pc < 0.05 THEN 'Below expectations' WHEN pc < 0.15 THEN 'Watch' WHEN pc > 0.95 THEN 'Above expectations' ELSE 'In line' END"


@query(f"{COMPARED} SELECT series_id, {r('pc')} AS percentile, {ONE_SIDE} AS status FROM cm WHERE metric = 'total'")
def compare_live(spark, d):
    """The percentile of the live total return alone."""
    rf = _rf(spark, d)
    stats = sim.path_stats(ex.excess_rebase(expected(spark, d), live(spark, d), COMPARE_PATHS, BLOCK, rf), F.col("rates"))
    p = sim.percentile_of(stats, ex.live_table(live(spark, d), rf), "total")
    return rounded(p.withColumn("status", ex.status(F.lit("total"), F.col("percentile"))))


@query(f"""{COMPARED} SELECT series_id, metric, {r('expected', 5)} AS expected, {r('low', 5)} AS low, {r('high', 5)} AS high, {r('actual', 5)} AS actual, {r('pc', 5)} AS percentile,
 CASE WHEN pc IS NULL THEN CASE WHEN metric = 'sharpe' THEN 'Too early' ELSE 'n/a' END WHEN metric = 'volatility' THEN CASE WHEN pc < 0.05 THEN 'Lower than expected' WHEN pc > 0.95 THEN 'Higher than expected' ELSE 'In line' END ELSE {ONE_SIDE} END AS status FROM cm""")
def comparison(spark, d):
    return rounded(ex.compare(live(spark, d), expected(spark, d), COMPARE_PATHS, BLOCK, _rf(spark, d)), 5)


def _inference(table: str, name: str) -> str:
    moments = "count(*) AS n, avg(x) / stddev_samp(x) AS sr, (avg(pow(x, 3)) - 3 * avg(x) * avg(pow(x, 2)) + 2 * pow(avg(x), 3)) / pow(var_pop(x), 1.5) AS g3, kurtosis_pop(x) + 3 AS g4"
    return f"{name}m AS (SELECT series_id, {moments} FROM (SELECT series_id, ret - rf AS x FROM {table}) GROUP BY 1), {name} AS (SELECT *, sqrt(greatest(1 - g3 * sr + (g4 - 1) / 4 * sr * sr, 1e-12) / (n - 1)) AS se FROM {name}m)"


@query(f"""{SPLIT}, {_inference('lv', 'il')}, {_inference('eb', 'ib')}, j AS (SELECT l.series_id, l.n, l.sr AS a, l.se AS sa, b.sr AS b, b.se AS sb, sqrt(l.se * l.se + b.se * b.se) AS sd, CASE WHEN b.sr <= 0 THEN CAST('inf' AS DOUBLE) ELSE (1 + (1 - b.g3 * b.sr + (b.g4 - 1) / 4 * b.sr * b.sr) * pow(1.6448536269514722 / b.sr, 2)) / 252 END AS need FROM il l JOIN ib b USING (series_id)), z AS (SELECT *, (a - b) / sd AS z FROM j)
 SELECT series_id, {r('a * sqrt(252)')} AS live, {r('b * sqrt(252)')} AS backtest, {r('sa * sqrt(252)')} AS se_live, {r('sb * sqrt(252)')} AS se_backtest, {r('sd * sqrt(252)')} AS se_difference, {r('z')} AS z, {r('2 * (' + phi_sql('(-abs(z))') + ')')} AS p, {r(phi_sql('(a / sa)'))} AS psr_zero, {r(phi_sql('((a - b / 2) / sa)'))} AS psr_half, {r('n / 252.0')} AS years, {r('need')} AS years_needed FROM z""")
def sharpe_consistency(spark, d):
    return rounded(ex.sharpe_consistency(live(spark, d), expected(spark, d), _rf(spark, d)))


def _pair(spark, d):
    wide = aligned(spark, d).groupBy("date").agg(F.max(F.when(F.col("series_id") == "A", F.col("ret"))).alias("x"), F.max(F.when(F.col("series_id") == "N", F.col("ret"))).alias("y"))
    return wide.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)


@query(f"""{AL}, k AS (SELECT date, max(ret) FILTER (WHERE series_id = 'A') AS x, max(ret) FILTER (WHERE series_id = 'N') AS y, row_number() OVER (ORDER BY date) - 1 AS i FROM al GROUP BY date), sz AS (SELECT count(*) AS n FROM k), bs AS (SELECT n, p.range AS path, k.range AS k, CAST(floor({u('p.range', 'k.range', 7)} * n) AS BIGINT) AS st FROM sz, range({TEST_PATHS}) p, range(1000) k WHERE k.range * {BLOCK} < n),
 ix AS (SELECT path, (st + j.range) % n AS i FROM bs, range({BLOCK}) j WHERE k * {BLOCK} + j.range < n), o AS (SELECT (avg(x) / stddev_samp(x) - avg(y) / stddev_samp(y)) * sqrt(252) AS d FROM k), g AS (SELECT path, (avg(x) / stddev_samp(x) - avg(y) / stddev_samp(y)) * sqrt(252) AS df FROM ix JOIN k USING (i) GROUP BY 1)
 SELECT any_value(n) AS days, {r('any_value(o.d)')} AS difference, {r('quantile_cont(df, 0.05)')} AS low, {r('quantile_cont(df, 0.95)')} AS high, {r('avg(CASE WHEN df < 0 THEN 1.0 WHEN df = 0 THEN 0.5 ELSE 0.0 END)')} AS p FROM g, o, sz""")
def sharpe_diff_test(spark, d):
    x = _pair(spark, d)
    n = x.count()
    return rounded(al.sharpe_difference(x, sim.day_indices(spark, n, n, TEST_PATHS, BLOCK)))


LIMITS = {"drawdown_percentile": 0.95, "return_percentile": 0.05, "vol_ratio": 1.02, "tracking_error": 0.02, "weight_drift": 0.05, "correlation": 0.1}


@query(f"""{COMPARED}, hw AS (SELECT series_id, max(pc) FILTER (WHERE metric = 'max_drawdown') AS dp, max(pc) FILTER (WHERE metric = 'total') AS tp, max(actual) FILTER (WHERE metric = 'volatility') AS va FROM cm GROUP BY 1), hv AS (SELECT series_id, stddev_samp(ret) * sqrt(252) AS vol FROM eb GROUP BY 1),
 hm AS (SELECT series_id, ret, avg(ret) OVER (PARTITION BY date) AS mo FROM lv), ht AS (SELECT series_id, count(*) AS n, stddev_samp(ret - mo) * sqrt(252) AS te FROM hm GROUP BY 1), hx AS (SELECT * FROM hw JOIN hv USING (series_id) JOIN ht USING (series_id)),
 hp AS (SELECT p.series_id AS a, q.series_id AS b, corr(p.ret, q.ret) AS c, count(*) AS n FROM lv p JOIN lv q USING (date) WHERE p.series_id < q.series_id AND date > (SELECT max(date) FROM lv) - 63 GROUP BY 1, 2), hg AS (SELECT series_id, product(1 + ret) / sum(product(1 + ret)) OVER () AS w FROM lv GROUP BY 1),
 hr AS (SELECT 'red' AS level, series_id AS scope, 'fell further than nearly all paths' AS message FROM hx WHERE dp < 0.05 UNION ALL SELECT 'red', series_id, 'earned less than nearly all paths' FROM hx WHERE tp < 0.05 UNION ALL SELECT 'amber', series_id, 'earned less than most paths' FROM hx WHERE tp >= 0.05 AND tp < 0.15
 UNION ALL SELECT 'amber', series_id, 'swings more than its history' FROM hx WHERE va / vol > 1.02 UNION ALL SELECT 'amber', series_id, 'strays from its model' FROM hx WHERE n >= 10 AND te > 0.02 UNION ALL SELECT 'info', series_id, 'no record of how it was chosen' FROM hx WHERE series_id = 'R' UNION ALL SELECT 'amber', series_id, 'failed some of its last tests' FROM hx WHERE series_id = 'N'),
 ho AS (SELECT 'amber' AS level, 'portfolio' AS scope, 'off its weight: ' || series_id AS message FROM hg WHERE abs(w - CASE series_id WHEN 'A' THEN 0.25 WHEN 'N' THEN 0.35 ELSE 0.4 END) > 0.05 UNION ALL SELECT 'amber', 'portfolio', 'move together: ' || a || ' and ' || b FROM hp WHERE c > 0.1 AND n >= 40)
 SELECT * FROM hr UNION ALL SELECT 'green', series_id, 'as its history led to expect' FROM hx WHERE series_id NOT IN (SELECT scope FROM hr WHERE level IN ('red', 'amber')) UNION ALL SELECT * FROM ho UNION ALL SELECT 'green', 'portfolio', 'all weights within their bands' WHERE NOT EXISTS (SELECT * FROM ho)""")
def health_checks(spark, d):
    """The state of each live record and of the portfolio, by the full set of rules."""
    x, now, rf = expected(spark, d), live(spark, d), _rf(spark, d)
    days = now.groupBy("series_id").agg(F.count("*").alias("days"))
    vol = x.groupBy("series_id").agg((F.stddev_samp("ret") * 252**0.5).alias("volatility"))
    model = now.select("series_id", "date", F.avg("ret").over(Window.partitionBy("date")).alias("ret"))
    grown = now.groupBy("series_id").agg(F.product(1 + F.col("ret")).alias("g"))
    target = F.when(F.col("series_id") == "A", 0.25).when(F.col("series_id") == "N", 0.35).otherwise(0.4)
    held = grown.select("series_id", (F.col("g") / F.sum("g").over(Window.partitionBy(F.lit(0)))).alias("weight"), target.alias("target"))  # one row a series
    late = now.join(now.agg(F.max("date").alias("_end"))).where(F.col("date") > F.date_sub("_end", 63)).drop("_end")  # one row
    chosen = days.where("series_id <> 'R'").select("series_id", F.lit(True).alias("chosen"), (F.col("series_id") == "N").cast("int").alias("failed"))
    return ex.health_checks(ex.compare(now, x, COMPARE_PATHS, BLOCK, rf), days, vol, sim.tracking(now, model), held, al.correlations(late), LIMITS, chosen)
