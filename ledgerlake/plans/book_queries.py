"""Registered queries: the book as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expectations as ex
from ..operators import portfolio as po
from ..operators import simulation as sim
from ..sources import testdata as v
from .expectation_queries import BLOCK, COMPARE_PATHS, COMPARED, ONE_SIDE, SPLIT, TEST_PATHS, expected, live
from .metric_queries import CUM, _rf
from .portfolio_queries import AL, aligned
from .registry import query, r, rounded, u

RET = v.with_views("returns")


@query("""WITH s AS (SELECT s_nationkey AS sleeve, count(*) AS n, any_value(s_nationkey % 4 > 0) AS active, CASE WHEN s_nationkey % 3 = 0 THEN count(*) END AS b FROM supplier GROUP BY 1), a AS (SELECT * FROM s WHERE active)
 SELECT sleeve, round(n / sum(n) OVER (), 9) + 0.0 AS target, round(b / sum(b) OVER (), 9) + 0.0 AS budget FROM a""")
def target_weights(spark, d):
    """Shares of active sleeves, of weights and of risk budgets where they have one."""
    s = v.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("sleeve")).agg(F.count("*").cast("double").alias("target_weight"))
    s = s.withColumns({"risk_budget": F.when(F.col("sleeve") % 3 == 0, F.col("target_weight")), "active": F.col("sleeve") % 4 > 0})
    return rounded(po.target_weights(s), 9)


MIX = f"""{SPLIT}, tg AS (SELECT * FROM (VALUES ('A', 0.5e0), ('N', 0.3e0), ('R', 0.0e0)) t(series_id, target)), me AS (SELECT series_id, target / sum(target) OVER () AS weight FROM tg WHERE target > 0), xx AS (SELECT series_id, date, ret, weight FROM eb JOIN me USING (series_id) WHERE date IN (SELECT date FROM eb JOIN me USING (series_id) GROUP BY 1 HAVING count(*) = 2)),
 hh AS (SELECT *, weight * product(1 + ret) OVER (PARTITION BY series_id, date_trunc('month', date) ORDER BY date {CUM}) AS h FROM xx), bb AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY series_id, date_trunc('month', date) ORDER BY date), weight) AS b FROM hh)"""


@query(f"{MIX} SELECT date, {r('sum(h) / sum(b) - 1', 8)} AS ret FROM bb GROUP BY 1")
def expected_portfolio(spark, d):
    """The mix of two expectations at their targets; the third has none."""
    targets = spark.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.0)], "series_id string, target double")
    return rounded(po.expected_portfolio(expected(spark, d), targets), 8)


@query(f"{RET}, x AS (SELECT series_id, ret, pow(0.5, (row_number() OVER (PARTITION BY series_id ORDER BY date DESC) - 1) / 63.0) AS w FROM returns), s AS (SELECT series_id, sqrt(sum(w * ret * ret) / sum(w) * 252) AS vol FROM x GROUP BY 1) SELECT series_id, {r('vol')} AS volatility, {r('least(1.0, 0.03 / vol)')} AS fraction FROM s")
def invest_fraction(spark, d):
    return rounded(po.invest_fraction(v.returns(spark, d), 0.03))


#: bk: returns of the portfolio (k = '') and of the portfolios without each strategy.
BOOKS = f"""{AL}, tw AS (SELECT * FROM (VALUES ('A', 0.6e0), ('N', 0.4e0), ('R', 0e0)) t(s, w)), cf AS (SELECT '' AS k, s, w / (SELECT sum(w) FROM tw) AS w FROM tw UNION ALL SELECT a.s, b.s, b.w / sum(b.w) OVER (PARTITION BY a.s) FROM tw a JOIN tw b ON a.s <> b.s),
 hl AS (SELECT k, s, date, w, date_trunc('month', date) AS p, w * product(1 + ret) OVER (PARTITION BY k, s, date_trunc('month', date) ORDER BY date {CUM}) AS h FROM al JOIN cf ON s = series_id), hb AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY k, s, p ORDER BY date), w) AS b FROM hl), bk AS (SELECT k, date, sum(h) / sum(b) - 1 AS ret FROM hb GROUP BY 1, 2)"""


def _figures(source: str, key: str) -> str:
    return f"SELECT {key}, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, pow(product(1 + ret), 252.0 / count(*)) - 1 AS cagr, min(dd) AS mdd FROM (SELECT *, w / greatest(max(w) OVER (PARTITION BY {key} ORDER BY date {CUM}), 1) - 1 AS dd FROM (SELECT {key}, date, ret, product(1 + ret) OVER (PARTITION BY {key} ORDER BY date {CUM}) AS w FROM {source})) GROUP BY 1"


@query(f"""{BOOKS}, fa AS ({_figures('al', 'series_id')}), fb AS ({_figures('bk', 'k')}), co AS (SELECT series_id, corr(al.ret, bk.ret) AS c FROM al JOIN bk ON bk.k = al.series_id AND bk.date = al.date GROUP BY 1), pr AS (SELECT y.k, x.ret AS x, y.ret AS y, row_number() OVER (PARTITION BY y.k ORDER BY y.date) - 1 AS i FROM bk y JOIN bk x ON x.k = '' AND x.date = y.date WHERE y.k <> ''), sz AS (SELECT count(*) AS n FROM bk WHERE k = ''),
 bs AS (SELECT n, p.range AS path, g.range AS g, CAST(floor({u('p.range', 'g.range', 3)} * n) AS BIGINT) AS st FROM sz, range({TEST_PATHS}) p, range(1000) g WHERE g.range * {BLOCK} < n), ix AS (SELECT path, (st + j.range) % n AS i FROM bs, range({BLOCK}) j WHERE g * {BLOCK} + j.range < n),
 dr AS (SELECT k, path, avg(x) / stddev_samp(x) - avg(y) / stddev_samp(y) AS df FROM ix JOIN pr USING (i) GROUP BY 1, 2), pp AS (SELECT k, avg(CASE WHEN df < 0 THEN 1.0 WHEN df = 0 THEN 0.5 ELSE 0.0 END) AS p FROM dr GROUP BY 1),
 z AS (SELECT s, w, fa.sharpe, fa.cagr, fa.mdd, c, c * b.sharpe AS hurdle, fa.sharpe > c * b.sharpe AS passes, b.sharpe AS ws, t.sharpe AS ts, t.sharpe - b.sharpe AS ds, t.cagr - b.cagr AS dc, t.mdd - b.mdd AS dm, p FROM cf JOIN fa ON fa.series_id = s JOIN fb b ON b.k = s JOIN fb t ON t.k = '' JOIN co ON co.series_id = s JOIN pp ON pp.k = s WHERE cf.k = ''),
 v AS (SELECT *, CASE WHEN w <= 1e-6 AND passes THEN 'add' WHEN w <= 1e-6 THEN 'leave out' WHEN ds > 0 THEN 'keep' WHEN passes THEN 'trim' ELSE 'drop' END AS verdict FROM z)
 SELECT s AS series_id, {r('w')} AS weight, {r('sharpe')} AS sharpe, {r('cagr')} AS cagr, {r('mdd')} AS max_drawdown, {r('c')} AS correlation, {r('hurdle')} AS hurdle, passes, {r('ws')} AS without_sharpe, {r('ts')} AS with_sharpe, {r('CASE WHEN w > 1e-6 THEN ds END')} AS d_sharpe, {r('CASE WHEN w > 1e-6 THEN dc END')} AS d_cagr, {r('CASE WHEN w > 1e-6 THEN dm END')} AS d_max_drawdown,
 {r('CASE WHEN w > 1e-6 THEN p END')} AS p, verdict, CASE verdict WHEN 'keep' THEN p < 0.1 WHEN 'drop' THEN p > 0.9 END AS clear FROM v""")
def add_or_remove(spark, d):
    """Two held strategies and one that is not."""
    weights = spark.createDataFrame([("A", 0.6), ("N", 0.4), ("R", 0.0)], "series_id string, weight double")
    return rounded(po.add_or_remove(aligned(spark, d), weights, draws=TEST_PATHS))


@query(f"""{COMPARED}, nv AS (SELECT series_id, 1000 * product(1 + ret) AS nav FROM lv GROUP BY 1), hm AS (SELECT series_id, ret, avg(ret) OVER (PARTITION BY date) AS mo FROM lv), ht AS (SELECT series_id, product(1 + ret) - product(1 + mo) AS shortfall FROM hm GROUP BY 1), sl AS (SELECT series_id, avg(ret - (pow(1.0, 1.0 / 252) - 1)) / stddev_samp(ret) * sqrt(252) AS sharpe FROM lv GROUP BY 1),
 op AS (SELECT l_returnflag AS series_id, count(DISTINCT l_suppkey % 7) AS n FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) SELECT series_id, {r('nav', 4)} AS nav, {r('nav / sum(nav) OVER ()')} AS weight, CASE series_id WHEN 'A' THEN 0.5e0 WHEN 'N' THEN 0.3e0 END AS target, {r('la.total')} AS live_return, {r('la.volatility')} AS volatility, {r('sl.sharpe')} AS sharpe, {r('la.max_drawdown')} AS max_drawdown, n AS open_positions,
 {r('pc')} AS percentile, {ONE_SIDE} AS status, {r('shortfall')} AS shortfall, CASE WHEN series_id <> 'R' THEN 4 END AS passed, CASE WHEN series_id <> 'R' THEN 5 END AS evaluated FROM nv JOIN la USING (series_id) JOIN sl USING (series_id) JOIN cm USING (series_id) JOIN ht USING (series_id) JOIN op USING (series_id) WHERE metric = 'total'""")
def scoreboard(spark, d):
    """A row a strategy: state, expectation, model and tests."""
    now, rf = live(spark, d), _rf(spark, d)
    nav = now.groupBy("series_id").agg((1000 * F.product(1 + F.col("ret"))).alias("nav"))
    model = now.groupBy("date").agg(F.avg("ret").alias("ret")).join(now.select("series_id").distinct()).select("series_id", "date", "ret")  # a few strategies
    targets = spark.createDataFrame([("A", 0.5), ("N", 0.3)], "series_id string, target double")
    tests = spark.createDataFrame([("A", 4, 5), ("N", 4, 5)], "series_id string, passed int, evaluated int")
    held = v.read(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_returnflag").alias("series_id"), (F.col("l_suppkey") % 7).alias("symbol")).distinct()
    return rounded(po.scoreboard(nav, targets, now, ex.compare(now, expected(spark, d), COMPARE_PATHS, BLOCK, rf), sim.tracking(now, model), held, tests)).withColumn("nav", F.round("nav", 4) + F.lit(0.0))
