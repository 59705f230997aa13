"""Domain tables as views of the star schema: strategies' returns, a benchmark, prices, fills and cash flows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Flow types by order priority, and the share of the order's price that flows.
FLOWS = {"1": ("deposit", 1.0), "2": ("withdrawal", 0.1), "3": ("transfer", 0.1), "4": ("dividend", 0.01), "5": ("fee", 0.001)}
#: Fills that one task sorts, about 240 bytes each.
TASK_ROWS = 200_000
#: What orders the fills of a sleeve and symbol.
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the days of fills: ``TASK_ROWS`` each, one a core at least. The count is that of the files' footers.

    For over 200 partitions (spark.shuffle.sort.bypassMergeThreshold) the tasks that deal rows hold and sort them, so there are no more of
    them until each would get ten times ``TASK_ROWS``."""
    rows = read(spark, sf_dir, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, min(200, math.ceil(rows / TASK_ROWS)), math.ceil(rows / (10 * TASK_ROWS)))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, ret): three strategies, one a return flag."""
    day = F.to_date("l_shipdate").alias("date")
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("series_id"), day).agg(((F.avg("l_discount") - 0.05) * 0.2 + 0.0003).alias("ret"))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(((F.avg("o_totalprice") / 250000 - 1) * 0.02).alias("ret"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close): a brand's mean unit price of the day."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    rows = read(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return rows.groupBy("symbol", F.to_date("l_shipdate").alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def _sign() -> Column:
    return F.when(F.col("l_linestatus") == "F", -1).otherwise(1)


def _when_whose() -> tuple[Column, ...]:
    return (F.col("l_suppkey") % 5).cast("int").alias("sleeve"), F.to_date("l_shipdate").alias("date")


def traded(sign: Column | None = None) -> dict[str, Column]:
    """Signed quantity, price and fees of a line."""
    q, paid = F.col("l_quantity"), F.col("l_extendedprice")
    return {"qty": q * (_sign() if sign is None else sign), "price": paid / q, "fees": F.col("l_tax") * 0.01 * paid}


def fills(spark: SparkSession, sf_dir: str, numbered: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(seq, date, sleeve, symbol, side, qty, price, fees): qty is signed; seq orders the whole row. Without ``numbered`` there is no seq,
    but columns of the table to ``keep``, as ``ORDER``.

    Rows are numbered within their day and moved up by the count of the days before, so no task sorts a symbol's whole history. Days are
    dealt to as many partitions as their rows need: merged by compressed size, or in a fixed count, a task's rows would grow."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    rows = read(spark, sf_dir, "lineitem").join(part, "l_partkey")
    rows = rows.select("*", *_when_whose())
    row = ["date", "sleeve", "symbol", F.when(F.col("l_linestatus") == "F", "SELL").otherwise("BUY").alias("side"), *(c.alias(k) for k, c in traded().items())]
    if not numbered:
        return rows.select(*row, *keep)
    days = rows.groupBy("sleeve", "symbol", "date").count()  # a day without a date comes first
    before = F.sum("count").over(Window.partitionBy("sleeve", "symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("sleeve", "symbol", "date", before.alias("_before"))
    order = Window.partitionBy("sleeve", "symbol", "date").orderBy(*ORDER)
    rows = rows.repartition(fill_parts(spark, sf_dir), "sleeve", "symbol", "date").withColumn("_i", F.row_number().over(order)).join(days, ["sleeve", "symbol", "date"], "left")
    return rows.select((F.col("_i") + F.coalesce("_before", F.lit(0))).cast("long").alias("seq"), *row)


def fill_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sleeve, symbol, date, qty, notional, fees, price, paid, shares): fills summed by sleeve, symbol and day, as many rows whatever the
    journal holds. ``price`` is that of some fill; ``paid`` over ``shares``, summed over sleeves, is the close of ``prices``.

    Columns are narrowed before ``part`` is joined, which exchanges every row where it is too large to broadcast."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", *_when_whose(), _sign().alias("sign"), "l_quantity", "l_extendedprice", "l_tax").join(part, "l_partkey")
    qty, price, fees = traded(F.col("sign")).values()
    return rows.groupBy("sleeve", "symbol", "date").agg(
        F.sum(qty).alias("qty"), F.sum(qty * price).alias("notional"), F.sum(fees).alias("fees"), F.max(price).alias("price"),
        F.sum("l_extendedprice").alias("paid"), F.sum("l_quantity").alias("shares"),
    )


def cashflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, sleeve, type, value, external): signed by type; transfers alternate in sign."""
    kind = F.substring("o_orderpriority", 1, 1)
    row = lambda i: F.coalesce(*(F.when(kind == k, F.lit(v[i])) for k, v in FLOWS.items()))
    sign = F.when(kind.isin("2", "5"), -1).when((kind == "3") & (F.col("o_orderkey") % 2 == 1), -1).otherwise(1)
    return read(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"), (F.col("o_custkey") % 5).cast("int").alias("sleeve"), row(0).alias("type"),
        (F.col("o_totalprice") * row(1) * sign).alias("value"), kind.isin("1", "2", "3").alias("external"),
    )


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, dividend): a quarter a share on the 15th of each quarter's last month, a trading day or not."""
    days = F.explode(F.expr("sequence(date'1995-03-15', date'2001-12-15', interval 3 months)"))
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct().select("symbol", days.alias("date"), F.lit(0.25).alias("dividend"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, multiplier, kind): the brands from 5 on are futures of ten units."""
    future = F.col("p_brand").startswith("Brand#5")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"), F.when(future, 10.0).otherwise(1.0).alias("multiplier"), F.when(future, "future").otherwise("stock").alias("kind")).distinct()


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, yield): a bill's yearly yield in percent, every fifth day of the month; some lie outside 0 to 25."""
    o = read(spark, sf_dir, "orders").where(F.dayofmonth("o_orderdate") % 5 == 0)
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 20000 - 3).alias("yield"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, ur, ff, usrec): an unemployment and a policy rate in percent and a recession flag, one row a month."""
    month = F.trunc("o_orderdate", "month")
    x = read(spark, sf_dir, "orders").groupBy(month.alias("month")).agg((5 + (F.avg("o_totalprice") / 250000 - 1) * 60).alias("ur"), F.greatest(F.lit(0.0), 4 + (F.avg(F.col("o_custkey") % 100) - 49.5) / 2).alias("ff"))
    return x.withColumn("usrec", ((F.year("month") * 12 + F.month("month")) % 40 < 9).cast("int"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", F.from_json("props", "k int")["k"].alias("k"))


#: The same views as SQL for the oracle.
SQL = {
    "returns": "SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date, (avg(l_discount) - 0.05) * 0.2 + 0.0003 AS ret FROM lineitem GROUP BY 1, 2",
    "bench": "SELECT CAST(o_orderdate AS DATE) AS date, (avg(o_totalprice) / 250000 - 1) * 0.02 AS ret FROM orders GROUP BY 1",
    "prices": "SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "fills": """SELECT row_number() OVER (PARTITION BY l_suppkey % 5, p_brand ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
        CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey % 5 AS INTEGER) AS sleeve, p_brand AS symbol, CASE WHEN l_linestatus = 'F' THEN 'SELL' ELSE 'BUY' END AS side,
        l_quantity * CASE WHEN l_linestatus = 'F' THEN -1 ELSE 1 END AS qty, l_extendedprice / l_quantity AS price, l_tax * 0.01 * l_extendedprice AS fees
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "cashflows": """SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 5 AS INTEGER) AS sleeve,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'deposit' WHEN '2' THEN 'withdrawal' WHEN '3' THEN 'transfer' WHEN '4' THEN 'dividend' WHEN '5' THEN 'fee' END AS type,
        o_totalprice * CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN -0.1 WHEN '3' THEN (CASE WHEN o_orderkey % 2 = 1 THEN -0.1 ELSE 0.1 END) WHEN '4' THEN 0.01 WHEN '5' THEN -0.001 END AS value,
        substr(o_orderpriority, 1, 1) IN ('1', '2', '3') AS external FROM orders""",
    "yields": "SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 20000 - 3 AS yield FROM orders WHERE day(o_orderdate) % 5 = 0 GROUP BY 1",
    "macro": "SELECT month, ur, ff, CAST((year(month) * 12 + month(month)) % 40 < 9 AS INTEGER) AS usrec FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, 5 + (avg(o_totalprice) / 250000 - 1) * 60 AS ur, greatest(0.0, 4 + (avg(o_custkey % 100) - 49.5) / 2) AS ff FROM orders GROUP BY 1)",
    "dividends": "SELECT symbol, unnest(generate_series(DATE '1995-03-15', DATE '2001-12-15', INTERVAL 3 MONTH))::DATE AS date, 0.25 AS dividend FROM (SELECT DISTINCT p_brand AS symbol FROM part)",
    "instruments": "SELECT DISTINCT p_brand AS symbol, CASE WHEN starts_with(p_brand, 'Brand#5') THEN 10.0 ELSE 1.0 END AS multiplier, starts_with(p_brand, 'Brand#5') AS future FROM part",
}


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)


#: Figures of a company and quarter, from what its orders sum up to: (field, from the first of the year on, value). rev: order prices, k and n: sums of customer numbers and orders.
FIGURES = (
    ("total_assets", False, "1e6 + 3 * rev"), ("current_assets", False, "1.2 * rev + 1000 * n"), ("current_liabilities", False, "0.7 * rev + 500 * k"), ("lt_debt", False, "CASE WHEN n % 5 > 0 THEN 2000.0 * k END"),
    ("revenue", True, "rev"), ("cogs", True, "rev * (0.55 + (k % 10) / 100)"), ("gross_profit", True, "CASE WHEN n % 3 = 0 THEN 0.4 * rev END"), ("net_income", True, "0.1 * rev - 900.0 * k"), ("ocf", True, "0.12 * rev - 2500.0 * n"),
)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cik, field, tag_rank, start, end, value, filed): filings of fifty companies. Flows are sums from the first of the year; some come
    late; revenue has a second tag; shares come with those of the year before, restated by half the companies."""
    o = read(spark, sf_dir, "orders").withColumn("q", F.trunc(F.col("o_orderdate").cast("date"), "quarter"))
    q = o.groupBy((F.col("o_custkey") % 50).alias("cik"), "q").agg(F.sum("o_totalprice").alias("rev"), F.count("*").alias("n"), F.sum(F.col("o_custkey") % 13).alias("k"))
    w = Window.partitionBy("cik", F.year("q")).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    end = F.date_sub(F.add_months("q", 3), 1)
    no_start, zero = F.lit(None).cast("date"), F.lit(0.0)

    def fact(field: str, rank: int, start, fin, value, filed, own):
        names = ("field", "tag_rank", "start", "end", "value", "filed", "own")
        return F.struct(*(x.alias(n) for n, x in zip(names, (F.lit(field), F.lit(rank), start, fin, value.cast("double"), filed, own.cast("double")), strict=True)))

    found = []
    for field, flow, value in FIGURES:
        if flow:
            q = q.withColumn(f"ytd_{field}", F.sum(F.expr(value)).over(w))
        amount = F.col(f"ytd_{field}") if flow else F.expr(value)
        late = F.when(F.lit(field in ("cogs", "ocf")) & (F.col("k") % 4 == 0), 10).otherwise(0)
        found.append(fact(field, 0, F.trunc("q", "year") if flow else no_start, end, amount, F.date_add(end, 40 + late), F.expr(value)))
        if field == "revenue":
            found.append(fact(field, 1, F.trunc("q", "year"), end, amount * 1.01, F.date_add(end, 40), F.expr(value)))
    shares = 1000.0 + 10 * F.col("n")
    found.append(fact("diluted_shares", 0, F.col("q"), end, shares, F.date_add(end, 40), zero))
    found.append(fact("diluted_shares", 0, F.add_months("q", -12), F.date_sub(F.add_months("q", -9), 1), shares * F.when(F.col("cik") % 2 == 0, 2.0).otherwise(0.99), F.date_add(end, 40), zero))
    return q.select("cik", F.explode(F.array(*found)).alias("f")).select("cik", "f.*").where("own is not null").drop("own")


def _facts_sql() -> str:
    parts = []
    for field, flow, value in FIGURES:
        amount = f"sum({value}) OVER (PARTITION BY cik, year(q) ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" if flow else value
        late = "CASE WHEN k % 4 = 0 THEN 50 ELSE 40 END" if field in ("cogs", "ocf") else "40"
        start = "CAST(date_trunc('year', q) AS DATE)" if flow else "CAST(NULL AS DATE)"
        parts.append(f"SELECT cik, '{field}' AS field, 0 AS tag_rank, {start} AS st, fin, {amount} AS value, fin + {late} AS filed, {value} AS own FROM fq")
    parts.append(parts[4].replace("0 AS tag_rank", "1 AS tag_rank").replace(") AS value", ") AS value").replace("ROW) AS value", "ROW) * 1.01 AS value"))
    share = "SELECT cik, 'diluted_shares', 0, {st}, {fin}, (1000.0 + 10 * n){scale}, fin + 40, 0.0 FROM fq"
    parts.append(share.format(st="q", fin="fin", scale=""))
    parts.append(share.format(st="CAST(q - INTERVAL 12 MONTH AS DATE)", fin="CAST(q - INTERVAL 9 MONTH - INTERVAL 1 DAY AS DATE)", scale=" * CASE WHEN cik % 2 = 0 THEN 2.0 ELSE 0.99 END"))
    base = "SELECT o_custkey % 50 AS cik, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS fin, sum(o_totalprice) AS rev, count(*) AS n, sum(o_custkey % 13) AS k FROM orders GROUP BY 1, 2, 3"
    return f"SELECT cik, field, tag_rank, st, fin, value, filed FROM (WITH fq AS ({base}) {' UNION ALL '.join(parts)}) WHERE own IS NOT NULL"


SQL["facts"] = _facts_sql()
