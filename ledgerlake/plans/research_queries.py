"""Registered queries: sources and validation, filings, significance, engines and the book façade."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import engines as en
from ..operators import fundamentals as fu
from ..operators import metrics as m
from ..operators import significance as si
from ..operators.allocation import METHODS
from ..operators.timeseries import inner_align
from ..sources import journal as jn
from ..sources import testdata as v
from . import ledger_queries as lq
from .book import Book
from .metric_queries import MOMENTS, phi_sql
from .portfolio_queries import EXTRA
from .registry import f, fine, query, r, rounded

RET, BOTH, PX = v.with_views("returns"), v.with_views("returns", "bench"), v.with_views("prices")
RAW = f"{v.with_views('fills')}, raw AS (SELECT sleeve, symbol, seq, date, CASE WHEN seq % 11 = 0 THEN 'HOLD' ELSE lower(side) END AS side, CASE WHEN seq % 13 = 0 THEN NULL ELSE abs(qty) END AS quantity, CASE WHEN seq % 17 = 0 THEN -price ELSE price END AS price FROM fills)"


def _raw(spark, d):
    f = v.fills(spark, d)
    return f.select(
        (F.col("seq") + F.col("sleeve") * 10_000_000 + F.crc32("symbol") * 100_000_000).alias("seq"), F.col("date").cast("string").alias("date"), F.col("sleeve").cast("string").alias("strategy"), F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"),
        F.when(F.col("seq") % 11 == 0, "HOLD").otherwise(F.lower("side")).alias("side"), F.when(F.col("seq") % 13 == 0, "many").otherwise(F.abs("qty").cast("string")).alias("quantity"),
        F.when(F.col("seq") % 17 == 0, -F.col("price")).otherwise(F.col("price")).cast("string").alias("price"), F.col("fees").cast("string").alias("fees"), F.lit(None).cast("string").alias("note"),
    )


@query(f"{RAW} SELECT CAST(sleeve AS VARCHAR) AS strategy, upper(symbol) AS symbol, count(*) AS n, {r('sum(CASE WHEN side = chr(98) || chr(117) || chr(121) THEN quantity ELSE -quantity END)')} AS qty FROM raw WHERE side <> 'HOLD' AND quantity IS NOT NULL AND price > 0 GROUP BY 1, 2".replace("chr(98) || chr(117) || chr(121)", "'buy'"))
def validate_trades(spark, d):
    good, _ = jn.validate_trades(_raw(spark, d), [str(i) for i in range(5)])
    return rounded(good.groupBy("strategy", "symbol").agg(F.count("*").alias("n"), F.sum("qty").alias("qty")))


@query(f"{RAW} SELECT 'unknown side' AS problem, count(*) AS n FROM raw WHERE side = 'HOLD' UNION ALL SELECT 'quantity is not a number', count(*) FROM raw WHERE quantity IS NULL UNION ALL SELECT 'price must be positive', count(*) FROM raw WHERE price <= 0 UNION ALL SELECT 'unknown strategy', count(*) FROM raw WHERE sleeve = 4")
def trade_violations(spark, d):
    _, bad = jn.validate_trades(_raw(spark, d), [str(i) for i in range(4)])
    return bad.groupBy("problem").agg(F.count("*").alias("n"))


@query("SELECT substr(o_orderpriority, 3) AS kind, round(sum(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN o_totalprice WHEN '2' THEN -o_totalprice WHEN '5' THEN -o_totalprice ELSE o_totalprice END), 2) + 0.0 AS value FROM orders GROUP BY 1")
def validate_cashflows(spark, d):
    o = v.read(spark, d, "orders")
    k = F.substring("o_orderpriority", 1, 1)
    kind = F.element_at(F.create_map(*(F.lit(x) for p in (("1", "Deposit"), ("2", " withdrawal"), ("3", "transfer"), ("4", "dividend"), ("5", "FEE")) for x in p)), k)
    raw = o.select(F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").cast("string").alias("date"), F.lit("a").alias("strategy"), kind.alias("type"), F.col("o_totalprice").cast("string").alias("amount"), F.col("o_orderpriority").alias("note"))
    good, _ = jn.validate_cashflows(raw, ["a"])
    return rounded(good.groupBy(F.expr("substr(note, 3)").alias("kind")).agg(F.sum("value").alias("value")), 2)


MARKS = "mk AS (SELECT symbol, date, floor(close) + CASE WHEN month(date) % 2 = 0 THEN 1.25 ELSE 0.25 END AS price FROM prices WHERE day(date) = 9 UNION ALL SELECT DISTINCT symbol, DATE '2030-01-01', 7.0 FROM prices)"


@query(f"{PX}, {MARKS} SELECT coalesce(p.symbol, m.symbol) AS symbol, coalesce(p.date, m.date) AS date, {f('coalesce(m.price, p.close)')} AS close FROM prices p FULL JOIN mk m ON p.symbol = m.symbol AND p.date = m.date")
def apply_marks(spark, d):
    """Marks of the ninth; in even months two on one day, the later of which counts."""
    p = v.prices(spark, d)
    ninth = p.where("day(date) = 9")
    mark = lambda x, add, seq: x.select("symbol", "date", (F.floor("close") + F.lit(add)).cast("double").alias("price"), F.lit(seq).alias("seq"))
    marks = mark(ninth.where("month(date) % 2 = 0"), 1.25, 2).union(mark(ninth, 0.25, 1)).union(p.select("symbol").distinct().selectExpr("symbol", "date'2030-01-01'", "7.0D", "1"))
    return fine(jn.apply_marks(p, marks))


@query(f"{PX} SELECT symbol, CASE WHEN symbol < 'Brand#3' THEN 'marks' ELSE 'local' END AS source, count(*) AS n FROM prices GROUP BY 1, 2")
def price_source_priority(spark, d):
    p = v.prices(spark, d)
    return jn.by_priority([("marks", p.where("symbol < 'Brand#3'")), ("local", p)]).groupBy("symbol", "source").agg(F.count("*").alias("n"))


@query(f"{RET}, e AS (SELECT series_id, date, 100 * product(1 + ret) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM returns), x AS (SELECT series_id, date, q / lag(q) OVER (PARTITION BY series_id ORDER BY date) - 1 AS ret FROM e) SELECT series_id, date, {r('ret', 7)} AS ret FROM x WHERE ret IS NOT NULL")
def scan_backtest(spark, d):
    eq = m.wealth(v.returns(spark, d), 100.0).select("series_id", "date", F.col("wealth").alias("equity"))
    good, _ = jn.split_percent_files(jn.equity_to_returns(eq))
    return rounded(good.select("series_id", "date", "ret"), 7)


@query("SELECT user_id AS series_id, count(*) FILTER (WHERE k % 3 = 0) AS passed, count(*) FILTER (WHERE k % 3 < 2) AS evaluated FROM (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1")
def tests_summary(spark, d):
    e = v.ticks(spark, d).select("user_id", F.col("event_id").cast("string").alias("name"), F.when(F.col("k") % 3 == 0, True).when(F.col("k") % 3 == 1, False).alias("ok"))
    meta = e.groupBy(F.col("user_id").alias("series_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "ok"))), {"ignoreNullFields": "false"}).alias("final_tests"))
    return jn.tests_summary(meta).drop("failed")


@query("""SELECT user_id AS series_id, 'cfg' || any_value(user_id % 7) AS selected, any_value(user_id % 3 = 0 OR user_id % 5 <> 0) AS chosen, count(*) FILTER (WHERE k % 3 = 0) AS passed, count(*) FILTER (WHERE k % 3 < 2) AS evaluated, count(*) FILTER (WHERE k % 3 = 1) AS failed
 FROM (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""")
def scan_meta(spark, d):
    """Records of exported backtests, one a user: the choice is missing in a third of them, and so a yes."""
    e = v.ticks(spark, d)
    ok = F.when(F.col("k") % 3 < 2, F.col("k") % 3 == 0)
    tests = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), ok))).alias("final_tests"))
    said = F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 5 != 0)
    raw = tests.select(F.col("user_id").alias("series_id"), F.to_json(F.struct(F.concat(F.lit("cfg"), (F.col("user_id") % 7).cast("string")).alias("selected"), said.alias("passed_selection"), "final_tests")).alias("json"))
    return jn.scan_meta(raw).withColumn("failed", F.size("failed").cast("long"))


@query("SELECT 's' || CAST(n_nationkey AS VARCHAR) AS strategy, x AS symbol, round(n_nationkey / 100.0 * CASE x WHEN 'A' THEN 1 ELSE 2 END, 6) + 0.0 AS weight FROM nation, (VALUES ('A'), ('B')) t(x)")
def scan_signals(spark, d):
    n = v.read(spark, d, "nation")
    js = F.format_string('{"kind": "weights", "as_of": "2024-01-31", "weights": {"A": %s, "B": %s}}', (F.col("n_nationkey") / 100).cast("string"), (F.col("n_nationkey") / 50).cast("string"))
    bad = spark.createDataFrame([("x", "{"), ("y", '{"kind": "weights", "weights": {"A": -1}}'), ("z", '{"kind": "weights", "weights": {"A": 1.5}}')], "strategy string, json string")
    good, _ = jn.read_signals(n.select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("strategy"), js.alias("json")).union(bad))
    return rounded(good.select("strategy", "symbol", "weight"))


@query(f"{PX} SELECT symbol, date_trunc('month', date)::DATE AS month, {r('max_by(close, date)')} AS close FROM prices GROUP BY 1, 2")
def dedup_keep_last(spark, d):
    p = v.prices(spark, d).withColumn("month", F.trunc("date", "month"))
    return rounded(jn.keep_last(p, ["symbol", "month"], "date").select("symbol", "month", "close"))


FACTS = "fa AS (SELECT o_custkey % 50 AS cik, year(o_orderdate) AS y, quarter(o_orderdate) AS q, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3)"


def _quarters(spark, d):
    o = v.read(spark, d, "orders")
    x = o.groupBy((F.col("o_custkey") % 50).alias("cik"), F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("q")).agg(F.sum("o_totalprice").alias("value"))
    return x.select("cik", F.date_sub(F.add_months("q", 3), 1).alias("end"), "value", F.date_add(F.add_months("q", 3), 40).alias("filed"), F.col("q").alias("start"))


@query(f"""WITH {FACTS}, e AS (SELECT cik, (make_date(CAST(y AS BIGINT), CAST(q * 3 AS BIGINT), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS fin, value FROM fa) SELECT cik, fin AS "end", {r('value', 2)} AS value FROM e""")
def discrete_quarters(spark, d):
    q = _quarters(spark, d)
    w = Window.partitionBy("cik", F.year("end")).orderBy("end").rowsBetween(Window.unboundedPreceding, 0)
    ytd = q.select("cik", F.trunc("end", "year").alias("start"), "end", F.sum("value").over(w).alias("value"), "filed")
    single = q.where("month(end) = 3").select("cik", "start", "end", "value", "filed")
    have = ytd.where("month(end) > 3").union(single)
    return rounded(fu.discrete_quarters(have.union(q.where("month(end) > 3").select("cik", "start", "end", "value", "filed")), ["cik"]).select("cik", "end", "value"), 2)


@query(f"""WITH {FACTS}, e AS (SELECT cik, (make_date(CAST(y AS BIGINT), CAST(q * 3 AS BIGINT), 1) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS fin, (make_date(CAST(y AS BIGINT), CAST(q * 3 AS BIGINT), 1) + INTERVAL 1 MONTH + INTERVAL 40 DAY)::DATE AS filed, value FROM fa), c AS (SELECT DISTINCT cik, DATE '1995-01-15' + CAST(x * 30 AS INTEGER) AS date FROM e, range(85) t(x))
 SELECT c.cik, c.date, {r("CASE WHEN date_diff('day', fin, c.date) <= 150 THEN value END", 2)} AS value FROM c ASOF LEFT JOIN e ON c.cik = e.cik AND c.date > e.filed""")
def point_in_time_facts(spark, d):
    q = _quarters(spark, d)
    cal = q.select("cik").distinct().join(F.broadcast(spark.range(85))).selectExpr("cik", "date_add(date'1995-01-15', cast(id * 30 as int)) as date")
    return rounded(fu.known_values(cal, q, ["cik"], "value", 150).select("cik", "date", "value"), 2)


@query(f"{RET}, {MOMENTS}, sp AS (SELECT stddev_samp(sr) AS spread FROM s), h AS (SELECT series_id, sr, se, spread * 2.5306028932016846 AS k FROM s, sp) SELECT series_id, {r(phi_sql('((sr - k) / se)'), 4)} AS dsr FROM h")
def deflated_sharpe(spark, d):
    return rounded(si.deflated_sharpe(v.returns(spark, d), 100).select("series_id", "dsr"), 4)


def _lagged(c: str) -> str:
    return " + ".join(f"coalesce({c} * lag({c}, {k}) OVER (PARTITION BY series_id ORDER BY date) * {1.0 if k == 0 else 2 * (1 - k / 11)}, 0)" for k in range(11))


@query(f"""{BOTH}, j AS (SELECT series_id, date, r.ret AS y, b.ret AS x FROM returns r JOIN bench b USING (date)), f AS (SELECT series_id, count(*) AS n, avg(x) AS mx, var_pop(x) AS vx, covar_pop(y, x) / var_pop(x) AS beta, avg(y) - covar_pop(y, x) / var_pop(x) * avg(x) AS alpha FROM j GROUP BY 1),
 e AS (SELECT series_id, date, (y - alpha - beta * x) * (x - mx) / (n * vx) AS v, (y - alpha - beta * x) * (1 - mx * (x - mx) / vx) / n AS u FROM j JOIN f USING (series_id)), l AS (SELECT series_id, {_lagged('v')} AS s, {_lagged('u')} AS q FROM e), t AS (SELECT series_id, sum(s) AS sv, sum(q) AS su FROM l GROUP BY 1)
 SELECT series_id, {r('alpha * 252')} AS alpha, {r('alpha / sqrt(su)', 4)} AS alpha_t, {r('beta')} AS beta, {r('beta / sqrt(sv)', 4)} AS beta_t FROM f JOIN t USING (series_id)""")
def capm_hac(spark, d):
    x = si.capm_hac(v.returns(spark, d), v.bench(spark, d))
    return rounded(x).select("series_id", "alpha", (F.round("alpha_t", 4) + F.lit(0.0)).alias("alpha_t"), "beta", (F.round("beta_t", 4) + F.lit(0.0)).alias("beta_t"))


GATES = f"""{v.with_views("returns", "bench")}, w AS (SELECT r.series_id, r.date, r.ret, b.ret AS b, r.ret - CASE WHEN day(r.date) = 1 THEN 0.0005 ELSE 0 END AS twice FROM returns r JOIN bench b USING (date) WHERE r.date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'),
 c AS (SELECT *, product(1 + ret) OVER v AS wr, product(1 + b) OVER v AS wb FROM w WINDOW v AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), e AS (SELECT *, wr / greatest(max(wr) OVER v, 1) - 1 AS dr, wb / greatest(max(wb) OVER v, 1) - 1 AS db, DATE '1996-01-01' + CAST(date_diff('day', DATE '1996-01-01', DATE '2000-12-31') // 2 AS INTEGER) AS mid FROM c WINDOW v AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 s AS (SELECT series_id, avg(ret) / stddev_samp(ret) * sqrt(252) AS sr, avg(b) / stddev_samp(b) * sqrt(252) AS sb, min(dr) AS dr, min(db) AS db, avg(ret) FILTER (WHERE date <= mid) / stddev_samp(ret) FILTER (WHERE date <= mid) * sqrt(252) AS h1, avg(ret) FILTER (WHERE date > mid) / stddev_samp(ret) FILTER (WHERE date > mid) * sqrt(252) AS h2, avg(twice) / stddev_samp(twice) * sqrt(252) AS s2 FROM e GROUP BY 1)"""


@query(f"{GATES} SELECT series_id, {r('sr')} AS sharpe, {r('dr')} AS max_drawdown, {r('h1')} AS first_half, {r('h2')} AS second_half, {r('s2')} AS twice_cost, sr >= sb AS g1, dr > db AS g2, h1 > 0 AND h2 > 0 AS g3, s2 >= sb AS g4, sr >= sb AND dr > db AND h1 > 0 AND h2 > 0 AND s2 >= sb AS survives FROM s")
def survival_gates(spark, d):
    x, b = v.returns(spark, d), v.bench(spark, d)
    x = x.join(b.select("date"), "date", "left_semi")
    twice = x.withColumn("ret", F.col("ret") - F.when(F.dayofmonth("date") == 1, 0.0005).otherwise(0.0))
    return rounded(si.survival_gates(x, twice, b, "1996-01-01", "2000-12-31"))


@query(f"{RET}, f AS (SELECT series_id AS config, year(date) AS fold, avg(ret) FILTER (WHERE month(date) <= 6) / stddev_samp(ret) FILTER (WHERE month(date) <= 6) AS a, avg(ret) FILTER (WHERE month(date) > 6) / stddev_samp(ret) FILTER (WHERE month(date) > 6) AS b FROM returns GROUP BY 1, 2) SELECT config, CAST(fold AS INTEGER) AS fold, CAST(rank() OVER (PARTITION BY fold ORDER BY a DESC) AS INTEGER) AS is_rank, CAST(rank() OVER (PARTITION BY fold ORDER BY b DESC) AS INTEGER) AS oos_rank FROM f")
def degradation_table(spark, d):
    half = lambda c: F.avg(F.when(c, F.col("ret"))) / F.stddev_samp(F.when(c, F.col("ret")))
    f = v.returns(spark, d).groupBy(F.col("series_id").alias("config"), F.year("date").alias("fold")).agg(half(F.month("date") <= 6).alias("is_sr"), half(F.month("date") > 6).alias("oos_sr"))
    return si.rank_table(f)


def audited(data: str, cut: str, where: str = "<=") -> str:
    """The oracle of an audit: the rows it looks at, and that only the leaking rule's results change."""
    return f"{v.with_views(data)}, n AS (SELECT count(*) AS rows FROM {data} WHERE date {where} DATE '{cut}') SELECT unnest(['honest', 'leaking']) AS rule, rows, unnest([false, true]) AS leaks FROM n"


def audit(rules: dict, test, data, seen):
    """(rule, rows, leaks) of ``test(rule)``, the rows that an audit finds changed; ``seen``: the rows of the data that it looks at."""
    out = None
    for name, rule in rules.items():
        one = test(rule).agg((F.count("*") > 0).alias("leaks")).join(data.where(seen).agg(F.count("*").alias("rows"))).select(F.lit(name).alias("rule"), "rows", "leaks")  # one row
        out = one if out is None else out.union(one)
    return out


@query(audited("returns", "1999-06-30"))
def truncation_audit(spark, d):
    """A rolling figure does not change without the days after; a centred one does."""
    x, cut = v.returns(spark, d), "1999-06-30"
    rolling = lambda y: m.rolling(y, 63).select("series_id", "date", F.round("rolling_vol", 9).alias("v"))
    centred = lambda y: y.select("series_id", "date", F.round(F.avg("ret").over(Window.partitionBy("series_id").orderBy("date").rowsBetween(-10, 10)), 9).alias("v"))
    return audit({"honest": rolling, "leaking": centred}, lambda rule: si.truncation_audit(rule, x, cut), x, F.col("date") <= cut)


@query(f"""{BOTH}, days AS (SELECT date, ret, 0.0001 AS cash FROM bench), dc AS (SELECT date AS fill, CASE WHEN month(date) % 2 = 0 THEN 0.8 ELSE 0.3 END AS weight FROM bench WHERE day(date) = 3), x AS (SELECT date, ret, cash, fill, weight FROM days ASOF JOIN dc ON days.date > dc.fill),
 y AS (SELECT *, weight * product(1 + ret) OVER w AS risky, (1 - weight) * product(1 + cash) OVER w AS safe, row_number() OVER w AS k FROM x WINDOW w AS (PARTITION BY fill ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 z AS (SELECT *, (risky + safe) / coalesce(lag(risky + safe) OVER (PARTITION BY fill ORDER BY date), 1) - 1 AS gross, risky / (risky + safe) AS drifted FROM y), t AS (SELECT *, CASE WHEN k = 1 THEN abs(weight - coalesce(lag(drifted) OVER (ORDER BY date), 0)) ELSE 0 END AS turnover FROM z) SELECT date, {r('drifted')} AS weight, {r('turnover')} AS turnover, {r('gross - turnover * 5 / 1e4', 8)} AS ret FROM t""")
def regime_engine(spark, d):
    b = v.bench(spark, d)
    dec = b.where("day(date) = 3").select(F.lit("c").alias("config"), "date", F.when(F.month("date") % 2 == 0, 0.8).otherwise(0.3).alias("weight"))
    x = en.regime_engine(b.withColumn("cash", F.lit(0.0001)), dec, 5)
    return x.select("date", (F.round("weight", 6) + 0.0).alias("weight"), (F.round("turnover", 6) + 0.0).alias("turnover"), (F.round("ret", 8) + 0.0).alias("ret"))


@query()
def cpcv_compare(spark, d):
    """Nine histories of every method over 45 splits, and how often it beats the target weights."""
    x = en.cpcv(inner_align(v.returns(spark, d), 3), list(METHODS), cap=0.6, extra=EXTRA | {"resamples": 10})
    return rounded(en.cpcv_summary(x))


def _book(spark, d):
    return Book(v.fills(spark, d), v.cashflows(spark, d), v.prices(spark, d), v.returns(spark, d), v.dividends(spark, d), v.instruments(spark, d))


@query(f"{lq.FP}, {lq.POS} SELECT sleeve, symbol, {r('sum(pnl)', 2)} AS pnl FROM val GROUP BY ROLLUP (sleeve, symbol)")
def attribution(spark, d):
    return rounded(_book(spark, d).attribution(), 2)


@query(f"{lq.TWR} SELECT CAST(sleeve AS VARCHAR) AS series_id, min(date) AS start FROM tw WHERE ret IS NOT NULL GROUP BY 1")
def live_start(spark, d):
    return _book(spark, d).live_start()
