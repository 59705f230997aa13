"""Registered queries: portfolio diagnostics, spells and health rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation as al
from ..operators import metrics as m
from ..sources import testdata as v
from .metric_queries import DRAWDOWN
from .portfolio_queries import AL, RISK, WT, aligned, weights
from .registry import query, r, rounded

RET = v.with_views("returns")
CUM = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query(f"""{AL}, {WT}, x AS (SELECT series_id, date, weight, date_trunc('month', date) AS p, weight * product(1 + ret) OVER (PARTITION BY series_id, date_trunc('month', date) ORDER BY date {CUM}) AS h FROM al JOIN wt USING (series_id)), y AS (SELECT *, coalesce(lag(h) OVER (PARTITION BY series_id, p ORDER BY date), weight) AS b FROM x),
 cm AS (SELECT date, (sum(h) + 0.1) / (sum(b) + 0.1) - 1 AS ret, sum(b) + 0.1 AS base FROM y GROUP BY 1), a AS (SELECT *, product(1 + ret) OVER (ORDER BY date {CUM}) AS wealth FROM cm), b AS (SELECT *, greatest(max(wealth) OVER (ORDER BY date {CUM}), 1) AS peak, coalesce(lag(wealth) OVER (ORDER BY date), 1) AS before FROM a),
 t AS (SELECT date AS trough, peak AS top FROM b ORDER BY wealth / peak, date LIMIT 1), s AS (SELECT max(date) AS pk FROM b, t WHERE date <= trough AND wealth >= top), c AS (SELECT series_id, sum((h - y.b) / base * before / top) AS c FROM y JOIN b USING (date), t, s WHERE date <= trough AND (pk IS NULL OR date > pk) GROUP BY 1) SELECT series_id, {r('c')} AS contribution, {r('c / sum(c) OVER ()')} AS share FROM c""")
def drawdown_contributions(spark, d):
    return rounded(al.drawdown_contributions(aligned(spark, d), weights(spark)))


@query(f"""{v.with_views("returns", "bench")}{AL[len(RET):]}, {WT}, {RISK}, mx AS (SELECT date, sum(weight * ret) AS x FROM al JOIN wt USING (series_id) GROUP BY 1), mb AS (SELECT covar_samp(x, ret) / var_samp(ret) AS beta, var_samp(ret) AS vb, var_samp(x) AS vp FROM mx JOIN bench USING (date)), ow AS (SELECT sum(weight * volatility) / sum(contribution) AS ratio, 1 / sum(share * share) AS contributors FROM rc)
 SELECT {r('ratio')} AS ratio, {r('contributors')} AS contributors, {r('beta')} AS beta, {r('least(1, beta * beta * vb / vp)')} AS beta_share FROM ow, mb""")
def diversification(spark, d):
    return rounded(al.diversification(aligned(spark, d), weights(spark), v.bench(spark, d)))


@query()
def effective_bets(spark, d):
    return rounded(al.effective_bets(aligned(spark, d), weights(spark)))


@query(f"{AL}, {WT}, x AS (SELECT series_id, date, ret, weight, (sum(weight * ret) OVER (PARTITION BY date) - weight * ret) / (sum(weight) OVER (PARTITION BY date) - weight) AS rest FROM al JOIN wt USING (series_id)), s AS (SELECT series_id, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe, corr(ret, rest) * avg(rest) / stddev_samp(rest) * sqrt(252) AS hurdle FROM x GROUP BY 1) SELECT series_id, {r('sharpe')} AS sharpe, {r('hurdle')} AS hurdle, sharpe > hurdle AS adds FROM s")
def marginal(spark, d):
    return rounded(al.marginal(aligned(spark, d), weights(spark)))


@query(f"""{AL}, me AS (SELECT series_id, avg(ret) * 252 AS m, row_number() OVER (ORDER BY series_id) AS k FROM al GROUP BY 1), ra AS (SELECT series_id, m, range AS mix, -ln(((k * 7919 + (range + 1) * 104729 + k * (range + 1) % 65521 * 31) % 9973 + 1) / 9974.0) AS u FROM me, range(1500)), w AS (SELECT *, u / sum(u) OVER (PARTITION BY mix) AS w FROM ra),
 cv AS (SELECT a.series_id AS a, b.series_id AS b, covar_samp(a.ret, b.ret) * 252 AS c FROM al a JOIN al b USING (date) GROUP BY 1, 2), vr AS (SELECT x.mix, sqrt(sum(x.w * y.w * c)) AS vol FROM w x JOIN w y USING (mix) JOIN cv ON a = x.series_id AND b = y.series_id GROUP BY 1), mn AS (SELECT mix, sum(w * m) AS mean FROM w GROUP BY 1) SELECT CAST(mix AS INTEGER) AS mix, {r('mean')} AS mean, {r('vol')} AS vol FROM mn JOIN vr USING (mix)""")
def frontier_cloud(spark, d):
    return rounded(al.random_mixes(aligned(spark, d), 1500))


@query()
def weight_uncertainty(spark, d):
    """Spread of three methods' weights over 200 resamples as long as the record."""
    return rounded(al.weight_uncertainty(aligned(spark, d), ["risk_parity", "min_variance", "max_sharpe"], cap=0.6))


@query()
def opt_resampled(spark, d):
    """Mean weights of the best Sharpe ratio over 200 resamples."""
    return rounded(al.weight_uncertainty(aligned(spark, d), ["max_sharpe"], cap=0.6).drop("method"))


@query(f"{RET}, f AS (SELECT *, ret > 0.0002 AS p FROM returns), g AS (SELECT *, CASE WHEN p AND NOT coalesce(lag(p) OVER (PARTITION BY series_id ORDER BY date), false) THEN 1 ELSE 0 END AS st FROM f), h AS (SELECT *, sum(st) OVER (PARTITION BY series_id ORDER BY date {CUM}) AS k FROM g) SELECT series_id, min(date) AS first, max(date) AS last, count(*) AS length, {r('product(1 + ret) - 1')} AS ret, {r('product(1 + ret) - pow(1.0001, count(*))')} AS excess FROM h WHERE p GROUP BY series_id, k")
def spell_stats(spark, d):
    x = v.returns(spark, d).select("series_id", "date", "ret", (F.col("ret") > 0.0002).cast("int").alias("position"), F.lit(0.0001).alias("cash"))
    return rounded(m.spell_stats(x).drop("island"))


@query(f"{RET}, {DRAWDOWN}, s AS (SELECT series_id, min(drawdown) AS dd, stddev_samp(ret) * sqrt(252) AS vol, avg(ret) / stddev_samp(ret) * sqrt(252) AS sr FROM d GROUP BY 1) SELECT 'alert' AS level, series_id AS scope, 'drawdown beyond the limit' AS message FROM s WHERE dd < -0.02 UNION ALL SELECT 'warning', series_id, 'volatility over the limit' FROM s WHERE vol > 0.03 UNION ALL SELECT 'warning', series_id, 'Sharpe ratio under the limit' FROM s WHERE sr < 1")
def limit_checks(spark, d):
    return m.limit_checks(m.stats_row(v.returns(spark, d)), {"drawdown": 0.02, "volatility": 0.03, "sharpe": 1.0})
