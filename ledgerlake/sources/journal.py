"""Journals, prices, backtests and signals: readers with explicit schemas, and validation that returns every violation as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of each journal file (fixed format).
TRADES = ["date", "strategy", "symbol", "side", "quantity", "price", "fees", "note"]
CASHFLOWS = ["date", "strategy", "type", "amount", "note"]
MARKS = ["date", "symbol", "price"]
#: Signs of sides; flow types, of which the first three move external money.
SIDES = {"BUY": 1, "COVER": 1, "SELL": -1, "SHORT": -1}
FLOW_TYPES = ("deposit", "withdrawal", "transfer", "dividend", "interest", "fee")
EXTERNAL = FLOW_TYPES[:3]
#: Daily returns beyond this are taken for percentages or errors. Weights may exceed 1 in sum by this much.
MAX_RETURN, WEIGHT_SLACK = 1.5, 1e-6


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of strings with ``#`` comments: headers trimmed and lower-cased, missing optional columns null, lines numbered in ``seq``."""
    raw = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    named = raw.toDF(*(c.strip().lower() for c in raw.columns))
    return named.select(*(F.col(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in columns), F.monotonically_increasing_id().alias("seq"))


def checks(*rules: tuple[str, Column]) -> Column:
    """The messages of all rules that a row breaks."""
    return F.filter(F.array(*(F.when(broken, F.lit(text)) for text, broken in rules)), lambda x: x.isNotNull())


def split_valid(df: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without problems, (seq, problem) of the others)."""
    checked = df.withColumn("problems", problems)
    return checked.where(F.size("problems") == 0).drop("problems"), checked.select("seq", F.explode("problems").alias("problem"))


def validate_trades(raw: DataFrame, strategies: list[str]) -> tuple[DataFrame, DataFrame]:
    """Typed fills with signed quantities, and all violations. Zero quantities are left out; order within a day is the file's. Empty fees
    are none; fees that are not a number are a violation."""
    text = lambda c: F.upper(F.trim(F.col(c)))
    typed = raw.select(
        "seq", F.try_to_date("date").alias("date"), F.trim("strategy").alias("strategy"), text("symbol").alias("symbol"), text("side").alias("side"),
        F.abs(F.col("quantity").try_cast("double")).alias("quantity"), F.col("price").try_cast("double").alias("price"), F.abs(F.when(F.trim(F.coalesce("fees", F.lit(""))) == "", F.lit(0.0)).otherwise(F.col("fees").try_cast("double"))).alias("fees"), "note",
    )
    problems = checks(
        ("date is not a date", F.col("date").isNull()), ("unknown strategy", ~F.coalesce(F.col("strategy").isin(*strategies, "cash"), F.lit(False))), ("unknown side", ~F.coalesce(F.col("side").isin(*SIDES), F.lit(False))),
        ("symbol is missing", F.coalesce(F.col("symbol"), F.lit("")).isin("", "NAN", "NONE")), ("quantity is not a number", F.col("quantity").isNull()), ("price must be positive", ~F.coalesce(F.col("price") > 0, F.lit(False))),
        ("fees are not a number", F.col("fees").isNull()),
    )
    good, bad = split_valid(typed, problems)
    sign = F.create_map(*(F.lit(x) for p in SIDES.items() for x in p))[F.col("side")]
    return good.where("quantity <> 0").withColumn("qty", F.col("quantity") * sign), bad


def validate_cashflows(raw: DataFrame, strategies: list[str]) -> tuple[DataFrame, DataFrame]:
    """Typed flows: deposits positive, withdrawals and fees negative, others as they are; and all violations."""
    typed = raw.select("seq", F.try_to_date("date").alias("date"), F.trim("strategy").alias("strategy"), F.lower(F.trim("type")).alias("type"), F.col("amount").try_cast("double").alias("amount"), "note")
    problems = checks(
        ("date is not a date", F.col("date").isNull()), ("unknown strategy", ~F.coalesce(F.col("strategy").isin(*strategies, "cash"), F.lit(False))), ("unknown type", ~F.coalesce(F.col("type").isin(*FLOW_TYPES), F.lit(False))), ("amount is not a number", F.col("amount").isNull()),
    )
    good, bad = split_valid(typed, problems)
    return good.select("*", signed_flow(F.col("type"), F.col("amount")).alias("value"), F.col("type").isin(*EXTERNAL).alias("external")), bad


def signed_flow(kind: Column, amount: Column) -> Column:
    return F.when(kind == "deposit", F.abs(amount)).when(kind.isin("withdrawal", "fee"), -F.abs(amount)).otherwise(amount)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def read_prices(spark: SparkSession, pattern: str) -> DataFrame:
    """(symbol, date, close, dividends, splits) of one CSV a symbol; rows without close go, the last of a date stays."""
    raw = spark.read.csv(pattern, header=True, comment="#", ignoreLeadingWhiteSpace=True)
    low = {c.strip().lower(): c for c in raw.columns}
    number = lambda *names: next((F.col(low[n]).try_cast("double") for n in names if n in low), F.lit(0.0))
    symbol = F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(?:\.gz)?$", 1))
    rows = raw.select(symbol.alias("symbol"), F.try_to_date(low.get("date", raw.columns[0])).alias("date"), number("close").alias("close"), F.coalesce(number("dividends"), F.lit(0.0)).alias("dividends"), F.coalesce(number("stock_splits", "splits"), F.lit(0.0)).alias("splits"), F.monotonically_increasing_id().alias("_i"))
    return keep_last(rows.where("close is not null and date is not null"), ["symbol", "date"], "_i").drop("_i")


def apply_marks(prices: DataFrame, marks: DataFrame, order: str = "seq") -> DataFrame:
    """Marks override closes and may add dates, on which there are no dividends or splits. Of marks of one symbol and date the last by
    ``order`` counts, where they have such a column; else the greatest."""
    last = F.max_by("price", order) if order in marks.columns else F.max("price")
    m = marks.groupBy("symbol", "date").agg(last.alias("_mark"))
    both = prices.join(m, ["symbol", "date"], "full_outer")
    return both.select("symbol", "date", F.coalesce("_mark", "close").alias("close"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("dividends", "splits") if c in prices.columns))


def by_priority(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(symbol, date, close, source): each symbol from the first source that has it."""
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.select("symbol", "date", "close", F.lit(name).alias("source"), F.lit(rank).alias("_rank"))
        rows = part if rows is None else rows.union(part)
    return rows.withColumn("_best", F.min("_rank").over(Window.partitionBy("symbol"))).where("_rank = _best").drop("_rank", "_best")


def equity_to_returns(equity: DataFrame) -> DataFrame:
    """(series_id, date, ret) of (series_id, date, equity); the last row of a date counts, the first date has no return."""
    return equity.withColumn("ret", F.col("equity") / F.lag("equity").over(Window.partitionBy("series_id").orderBy("date")) - 1).where("ret is not null").select("series_id", "date", "ret")


def split_percent_files(returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series whose returns are plausible, (series_id, message) of the others)."""
    worst = returns.groupBy("series_id").agg(F.max(F.abs("ret")).alias("_worst"))
    bad = worst.where(F.col("_worst") > MAX_RETURN)
    return returns.join(bad, "series_id", "left_anti"), bad.select("series_id", F.lit("daily returns beyond 150 %: percentages?").alias("message"))


def scan_meta(raw: DataFrame) -> DataFrame:
    """(series_id, selected, chosen, passed, evaluated, failed) of the records (series_id, json) that come with exported backtests: the name
    of the configuration, whether it is what the research settled on (yes, unless the record says otherwise), and its last tests. Unreadable records are left out."""
    s = F.from_json("json", "selected string, passed_selection boolean, final_tests map<string,boolean>")
    x = raw.select("series_id", s.alias("s")).where("s is not null and (s.selected is not null or s.final_tests is not null or s.passed_selection is not null)")
    x = x.select("series_id", "s.selected", F.coalesce("s.passed_selection", F.lit(True)).alias("chosen"), F.to_json("s.final_tests").alias("final_tests"))
    return x.drop("final_tests").join(tests_summary(x), "series_id", "left")


def tests_summary(meta: DataFrame) -> DataFrame:
    """(series_id, passed, evaluated, failed): of the JSON map ``final_tests`` of name to true, false or null."""
    tests = F.from_json("final_tests", "map<string,boolean>")
    each = meta.select("series_id", F.explode_outer(tests).alias("name", "ok"))
    return each.groupBy("series_id").agg(F.count(F.when(F.col("ok"), 1)).alias("passed"), F.count("ok").alias("evaluated"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name")))).alias("failed"))


def read_signals(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weight signals (strategy, json) to (strategy, as_of, symbol, weight), and (strategy, message) of unusable ones."""
    s = F.from_json("json", "kind string, as_of date, weights map<string,double>")
    parsed = raw.select("strategy", s.alias("s")).select("strategy", "s.*")
    total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x)
    message = F.when(F.col("kind").isNull(), "unreadable").when(~F.col("kind").isin("weights", "stock_picks"), "unknown kind").when(F.exists(F.map_values("weights"), lambda x: x < 0), "negative weight").when(total > 1 + WEIGHT_SLACK, "weights sum to more than 1")
    checked = parsed.withColumn("message", message)
    return checked.where("message is null and kind = 'weights'").select("strategy", "as_of", F.explode("weights").alias("symbol", "weight")), checked.where("message is not null").select("strategy", "message")


def transfer_rows(spark: SparkSession, date: str, source: str, target: str, amount: float, note: str = "") -> DataFrame:
    """The two journal rows of a transfer between sleeves, equal and opposite."""
    if source == target or not amount > 0:
        raise ValueError("a transfer moves a positive amount between two different sleeves")
    rows = [(date, source, "transfer", str(-amount), note or f"to {target}", 0), (date, target, "transfer", str(amount), note or f"from {source}", 1)]
    return spark.createDataFrame(rows, "date string, strategy string, type string, amount string, note string, seq long")


def append_valid(valid: DataFrame, violations: DataFrame, path: str) -> int:
    """Appends rows only if there is no violation; returns how many violations there are. Give both as ``validate_*`` returned them:
    they come from one checked table, which should be cached or written where reading it twice is dear."""
    broken = violations.count()
    if not broken:
        valid.write.mode("append").parquet(path)
    return broken


def save_journal(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Replaces a journal, a folder of CSV files with a header, and keeps the version before as ``path.bak``.

    The new version is written whole beside it before either is moved, so a lost executor leaves the old one in place."""
    spark, jvm = rows.sparkSession, rows.sparkSession._jvm
    here, new, old = (jvm.org.apache.hadoop.fs.Path(path + end) for end in ("", ".new", ".bak"))
    store = here.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.delete(new, True)
    rows.select(*(F.col(c).cast("string").alias(c) for c in columns)).write.csv(path + ".new", header=True)
    if store.exists(here):
        store.delete(old, True)
        store.rename(here, old)
    store.rename(new, here)
