"""Price, yield and macro series from files: cleaning with a quality report, macro panels, company facts and index membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.timeseries import by

#: Days between observations that count as a gap, and a move that counts as extreme.
GAP_DAYS, EXTREME = 5, 0.10


def clean_close(raw: DataFrame, positive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(series, report) of raw observations (symbol, date, close, seq).

    The last row of a date counts; missing and infinite values go, and those not over zero, of yields (``positive`` false) those under
    it. The report has one row a symbol: what was dropped, gaps of more than GAP_DAYS, and the largest moves, relative or in points.
    """
    w = Window.partitionBy("symbol", "date").orderBy(F.desc("seq"))
    x = raw.withColumn("_k", F.row_number().over(w))
    value = F.when(~F.isnan("close") & (F.abs("close") < float("inf")), F.col("close"))
    bad = (value <= 0) if positive else (value < 0)
    marked = x.select("symbol", "date", "_k", value.alias("close"), F.coalesce(bad, F.lit(False)).alias("_bad"))
    good = marked.where("_k = 1 and close is not null and not _bad").select("symbol", "date", "close")
    o = by("symbol")
    move = F.col("close") / F.lag("close").over(o) - 1 if positive else F.col("close") - F.lag("close").over(o)
    moves = good.withColumn("move", move).withColumn("gap", F.datediff("date", F.lag("date").over(o)))
    clean = moves.groupBy("symbol").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("clean"), F.sum((F.col("gap") > GAP_DAYS).cast("long")).alias("gaps"), F.max("move").alias("rise"), F.min("move").alias("fall"),
        F.sum((F.abs("move") > EXTREME).cast("long")).alias("extreme"),
    )
    count = lambda when: F.sum(F.expr(when).cast("long"))
    seen = marked.groupBy("symbol").agg(F.count("*").alias("raw"), count("_k > 1").alias("duplicates"), count("_k = 1 and _bad").alias("invalid"), count("_k = 1 and close is null").alias("missing"))
    return good, seen.join(clean, "symbol", "left")


def read_fred(spark: SparkSession, pattern: str) -> DataFrame:
    """(series_id, date, value) of CSV files of a date and a value column, named by the value column; a dot or an empty cell is missing."""
    text = spark.read.text(pattern, wholetext=False).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"), F.split("value", ",").alias("c"))
    head = text.where(F.try_to_date(F.trim(F.get("c", F.lit(0)))).isNull()).groupBy("file").agg(F.min_by(F.trim(F.get("c", F.lit(1))), "n").alias("series_id"))
    body = text.select("file", F.try_to_date(F.trim(F.get("c", F.lit(0)))).alias("date"), F.trim(F.get("c", F.lit(1))).try_cast("double").alias("value")).where("date is not null and value is not null")
    return body.join(F.broadcast(head), "file").select("series_id", "date", "value")


def load_macro(series: DataFrame, names: list[str]) -> DataFrame:
    """One row a month with a column for each named series, the last value of the month; null where a series has none."""
    month = series.withColumn("month", F.trunc("date", "month")).groupBy("month").pivot("series_id", names).agg(F.max_by("value", "date"))
    return month


def adjusted_closes(prices: DataFrame) -> DataFrame:
    """``prices`` (symbol, date, close, dividends) with ``adjusted``: the close times the product of 1 - dividend / close before it, over
    all later dividends, so that its changes are total returns."""
    w = by("symbol")
    keep = 1 - F.when(F.col("dividends") > 0, F.col("dividends") / F.lag("close").over(w)).otherwise(0.0)
    x = prices.withColumn("_keep", F.coalesce(keep, F.lit(1.0)))
    after = F.product("_keep").over(w.rowsBetween(1, Window.unboundedFollowing))
    return x.withColumn("adjusted", F.col("close") * F.coalesce(after, F.lit(1.0))).drop("_keep")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(date, members) of a CSV of dates and comma-separated members in quotes; symbols upper-cased, dots as dashes, the last row of a date."""
    raw = spark.read.csv(path, header=True).withColumn("_n", F.monotonically_increasing_id())
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(raw[raw.columns[1]], ","), lambda x: F.regexp_replace(F.upper(F.trim(x)), r"\.", "-")), lambda x: x != "")))
    return raw.select(F.try_to_date(raw[raw.columns[0]]).alias("date"), names.alias("members"), "_n").where("date is not null").groupBy("date").agg(F.max_by("members", "_n").alias("members"))


FACT = "map<string,map<string,struct<units:map<string,array<struct<start:date,end:date,val:double,filed:date,accn:string,form:string>>>>>>"


def read_facts(raw: DataFrame, forms: list[str]) -> DataFrame:
    """(cik, taxonomy, tag, unit, start, end, value, filed, accn) of company-facts documents (cik, json), of the given forms alone."""
    x = raw.select("cik", F.from_json("json", f"facts {FACT}")["facts"].alias("f")).select("cik", F.explode("f").alias("taxonomy", "tags")).select("cik", "taxonomy", F.explode("tags").alias("tag", "t"))
    rows = x.select("cik", "taxonomy", "tag", F.explode("t.units").alias("unit", "r")).select("cik", "taxonomy", "tag", "unit", F.explode("r").alias("r"))
    return rows.where(F.col("r.form").isin(*forms)).select("cik", "taxonomy", "tag", "unit", "r.start", "r.end", F.col("r.val").alias("value"), "r.filed", "r.accn")


def one_line_per_company(members: DataFrame, volumes: DataFrame) -> DataFrame:
    """(cik, symbol): of a company's share lines (cik, symbol) the one of the largest mean volume (symbol, volume); ties by name."""
    x = members.join(volumes.groupBy("symbol").agg(F.avg("volume").alias("v")), "symbol", "left")
    w = Window.partitionBy("cik").orderBy(F.desc_nulls_last("v"), "symbol")
    return x.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("cik", "symbol")


def export_returns(returns: DataFrame, folder: str) -> None:
    """One folder of CSV files (date, ret) for each series, in date order, as backtests are read."""
    rows = returns.select("series_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "ret")
    rows.repartition("series_id").sortWithinPartitions("series_id", "date").write.mode("overwrite").partitionBy("series_id").csv(folder, header=True)


def read_backtests(spark: SparkSession, folder: str) -> DataFrame:
    """(series_id, date, ret) of all series below a folder that ``export_returns`` wrote, or of files ``<series>.csv`` in it."""
    raw = spark.read.option("basePath", folder).csv(folder, header=True, recursiveFileLookup=False)
    if "series_id" not in raw.columns:
        raw = raw.withColumn("series_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(?:\.gz)?$", 1))
    return raw.select(F.col("series_id").cast("string").alias("series_id"), F.try_to_date("date").alias("date"), F.col("ret").try_cast("double").alias("ret")).where("date is not null and ret is not null")


def demo_book(spark: SparkSession, days: int = 500, sleeves: int = 3, seed: int = 1) -> dict[str, DataFrame]:
    """A seeded demonstration book: prices of a symbol a sleeve, a deposit for each, and monthly fills that take turns buying and selling."""
    day = spark.range(days * 7 // 5).select(F.date_add(F.lit("2022-01-03").cast("date"), F.col("id").cast("int")).alias("date")).where("dayofweek(date) between 2 and 6")
    keys = spark.range(sleeves).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sleeve"), F.concat(F.lit("DEMO"), F.col("id").cast("string")).alias("symbol"))
    u = (F.pmod(F.xxhash64("symbol", "date", F.lit(seed)), F.lit(1_000_003)) + 0.5) / 1_000_003
    w = by("symbol").rowsBetween(Window.unboundedPreceding, 0)
    prices = keys.join(F.broadcast(day)).withColumn("close", 100 * F.product(1 + (u - 0.49) * 0.03).over(w))
    month = prices.groupBy("sleeve", "symbol", F.trunc("date", "month").alias("m")).agg(F.min_by("close", "date").alias("price"), F.min("date").alias("date"))
    order = by("sleeve", "symbol")
    fills = month.withColumn("seq", F.row_number().over(order).cast("long")).select("seq", "date", "sleeve", "symbol", F.when(F.col("seq") % 2 == 1, 200.0).otherwise(-200.0).alias("qty"), "price", F.lit(1.0).alias("fees"))
    flows = keys.select(F.lit("2022-01-03").cast("date").alias("date"), "sleeve", F.lit("deposit").alias("type"), F.lit(100_000.0).alias("value"), F.lit(True).alias("external"))
    return {"prices": prices.select("symbol", "date", "close"), "fills": fills, "cashflows": flows}
