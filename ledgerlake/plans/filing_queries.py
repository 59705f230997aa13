"""Registered queries: company filings, scores and what was known when."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamentals as fu
from ..sources import testdata as v
from .registry import query, r, rounded

INPUTS = [f for f in (*fu.STOCKS, *fu.FLOWS) if f != "total_assets"]
#: dr: first-filed durations; qt: quarters; yr: years; tt: sums of a year.
FLOW = f"""{v.with_views('facts')}, fl AS (SELECT *, date_diff('day', st, fin) AS days, row_number() OVER (PARTITION BY cik, field, st, fin ORDER BY filed, tag_rank, value) AS z FROM facts WHERE st IS NOT NULL AND field <> 'diluted_shares'), dr AS (SELECT * FROM fl WHERE z = 1),
 ls AS (SELECT *, lag(fin) OVER w AS pf, lag(value) OVER w AS pv, lag(filed) OVER w AS pd FROM dr WHERE days BETWEEN 75 AND 380 WINDOW w AS (PARTITION BY cik, field, st ORDER BY fin)),
 qa AS (SELECT cik, field, fin, value, filed, 0 AS src FROM dr WHERE days BETWEEN 75 AND 105 UNION ALL SELECT cik, field, fin, value - pv, greatest(filed, pd), 1 FROM ls WHERE date_diff('day', pf, fin) BETWEEN 75 AND 105),
 qt AS (SELECT cik, field, fin, value, filed FROM qa QUALIFY row_number() OVER (PARTITION BY cik, field, fin ORDER BY filed, src, value) = 1),
 yr AS (SELECT cik, field, fin, value, filed FROM dr WHERE days BETWEEN 350 AND 380 QUALIFY row_number() OVER (PARTITION BY cik, field, fin ORDER BY filed, value) = 1),
 st AS (SELECT *, date_diff('day', lag(fin) OVER w, fin) BETWEEN 75 AND 105 AS ok FROM qt WINDOW w AS (PARTITION BY cik, field ORDER BY fin)),
 rl AS (SELECT cik, field, fin, sum(value) OVER w AS value, max(filed) OVER w AS filed, count(*) OVER w AS n, date_diff('day', first_value(fin) OVER w, fin) AS span, ok AND coalesce(lag(ok) OVER (PARTITION BY cik, field ORDER BY fin), false) AND coalesce(lag(ok, 2) OVER (PARTITION BY cik, field ORDER BY fin), false) AS steady FROM st WINDOW w AS (PARTITION BY cik, field ORDER BY fin ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
 ta AS (SELECT *, 0 AS src FROM yr UNION ALL SELECT cik, field, fin, value, filed, 1 FROM rl WHERE n = 4 AND span BETWEEN 250 AND 300 AND steady), tt AS (SELECT cik, field, fin, value, filed FROM ta QUALIFY row_number() OVER (PARTITION BY cik, field, fin ORDER BY filed, src, value) = 1)"""
#: en: the balance sheets; al: every other field at them; sp: the shares.
SHEETS = f"""{FLOW}, sk AS (SELECT cik, field, fin, value, filed FROM facts WHERE st IS NULL QUALIFY row_number() OVER (PARTITION BY cik, field, fin ORDER BY filed, tag_rank, value) = 1), en AS (SELECT cik, fin, filed AS known, value AS assets FROM sk WHERE field = 'total_assets'),
 fg AS (SELECT * FROM sk WHERE field <> 'total_assets' UNION ALL SELECT * FROM tt), nr AS (SELECT e.cik, e.fin, e.known, g.field, g.value, g.filed FROM en e JOIN fg g ON g.cik = e.cik AND abs(date_diff('day', g.fin, e.fin)) <= 7 QUALIFY row_number() OVER (PARTITION BY e.cik, e.fin, g.field ORDER BY abs(date_diff('day', g.fin, e.fin)), g.fin) = 1),
 sh AS (SELECT *, date_diff('day', st, fin) AS days FROM facts WHERE field = 'diluted_shares' AND date_diff('day', st, fin) BETWEEN 75 AND 380),
 sc AS (SELECT e.cik, e.fin, e.known, s.value AS shares, s.days FROM en e JOIN sh s ON s.cik = e.cik AND s.filed <= e.known AND abs(date_diff('day', s.fin, e.fin)) <= 7 QUALIFY row_number() OVER (PARTITION BY e.cik, e.fin ORDER BY s.days, s.filed, s.tag_rank DESC, s.value) = 1),
 sb AS (SELECT c.cik, c.fin, s.value AS prior_shares FROM sc c JOIN sh s ON s.cik = c.cik AND s.filed <= c.known AND abs(date_diff('day', s.fin, c.fin - 364)) <= 20 AND abs(s.days - c.days) <= 20 QUALIFY row_number() OVER (PARTITION BY c.cik, c.fin ORDER BY s.filed DESC, s.tag_rank, s.value DESC) = 1)"""


@query(f"""{FLOW} SELECT cik, field, fin AS "end", filed, {r('value', 2)} AS value FROM tt""")
def ttm(spark, d):
    """Sums of a year of every flow, from quarters or from a year's own figure."""
    keys = ["cik", "field"]
    flows = fu.first_facts(v.facts(spark, d).where(F.col("field").isin(*fu.FLOWS)), [*keys, "start", "end"])
    return rounded(fu.trailing_year(fu.discrete_quarters(flows, keys), fu.annual_values(flows, keys), keys), 2)


@query(f"""{SHEETS} SELECT cik, fin AS "end", known, {r('shares', 2)} AS shares, {r('prior_shares', 2)} AS prior_shares FROM en LEFT JOIN sc USING (cik, fin, known) LEFT JOIN sb USING (cik, fin)""")
def shares_pair(spark, d):
    x = v.facts(spark, d)
    ends = fu.first_facts(x.where("field = 'total_assets'"), ["cik", "end"]).select("cik", "end", F.col("filed").alias("known"))
    return rounded(fu.shares_pair(ends, x.where("field = 'diluted_shares'").drop("field"), ["cik"]), 2)


_NEEDS = {
    "roa": ("net_income / assets > 0", ["net_income"]), "cfo": ("ocf / assets > 0", ["ocf"]), "d_roa": ("net_income / assets > p_net_income / p_assets", ["net_income", "p_net_income"]),
    "accrual": ("ocf > net_income", ["ocf", "net_income"]), "d_lever": ("lt_debt / assets < p_lt_debt / p_assets", ["lt_debt", "p_lt_debt"]),
    "d_liquid": ("current_assets / current_liabilities > p_current_assets / p_current_liabilities", ["current_assets", "current_liabilities", "p_current_assets", "p_current_liabilities"]), "eq_offer": ("shares <= prior_shares", ["shares", "prior_shares"]),
    "d_margin": ("gross / revenue > p_gross / p_revenue", ["gross", "revenue", "p_gross", "p_revenue"]), "d_turn": ("revenue / assets > p_revenue / p_assets", ["revenue", "p_revenue"]),
}
_KEPT = ["assets", "known", "net_income", "lt_debt", "current_assets", "current_liabilities", "gross", "revenue"]
SCORE = f"""{SHEETS}, wd AS (SELECT cik, fin, known, {', '.join(f"max(value) FILTER (WHERE field = '{f}' AND filed <= known + 3) AS {f}" for f in INPUTS)} FROM nr GROUP BY 1, 2, 3),
 vl AS (SELECT e.cik, e.fin, e.known, e.assets, shares, prior_shares, coalesce(lt_debt, 0) AS lt_debt, {', '.join(f for f in INPUTS if f not in ('lt_debt', 'cogs', 'gross_profit'))}, coalesce(revenue - cogs, gross_profit) AS gross FROM en e LEFT JOIN wd USING (cik, fin, known) LEFT JOIN sc USING (cik, fin, known) LEFT JOIN sb USING (cik, fin)),
 pr AS (SELECT x.*, {', '.join(f'p.{c} AS p_{c}' for c in _KEPT)} FROM vl x JOIN vl p ON p.cik = x.cik AND abs(date_diff('day', p.fin, x.fin - 364)) <= 20 QUALIFY row_number() OVER (PARTITION BY x.cik, x.fin ORDER BY abs(date_diff('day', p.fin, x.fin - 364)), p.fin) = 1),
 ts AS (SELECT cik, fin, greatest(known, p_known) AS known, {', '.join(f'CASE WHEN {t} THEN 1 ELSE 0 END AS {n}' for n, (t, _) in _NEEDS.items())}, {' + '.join(f"CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in cols)} THEN 1 ELSE 0 END" for _, cols in _NEEDS.values())} AS n_scored FROM pr)"""


@query(f"""{SCORE} SELECT cik, fin AS "end", known, {', '.join(_NEEDS)}, {' + '.join(_NEEDS)} AS score, n_scored FROM ts""")
def piotroski_f_score(spark, d):
    return fu.score_history(v.facts(spark, d))
