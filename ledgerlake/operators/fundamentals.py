"""Company filings as known at the time: quarters, trailing sums, scores, and point-in-time joins."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import asof_backward, asof_nearest, by


#: Fields of a filing that add up over a year, and those of a balance sheet's day.
FLOWS = ("revenue", "cogs", "gross_profit", "net_income", "ocf")
STOCKS = ("total_assets", "current_assets", "current_liabilities", "lt_debt")
#: Days of a quarter, of a year, of any period up to a year, and of three quarters from end to end.
QUARTER, ANNUAL, PERIOD, THREE = (75, 105), (350, 380), (75, 380), (250, 300)
#: Days between a field's end and the balance sheet's, days that a field may be filed after it, days from a year before, and that year.
NEAR, LATE, PRIOR, YEAR_DAYS = 7, 3, 20, 364


def first_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, filed) of the first filing of each of ``keys``; of one day the fact of the best tag (least ``tag_rank``)."""
    return facts.groupBy(*keys).agg(F.min(F.struct("filed", "tag_rank", "value")).alias("f")).select(*keys, "f.value", "f.filed")


def discrete_quarters(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Quarter values: facts of a quarter's length as they are, and differences of facts of the same start whose ends are a quarter
    apart. Of several for one end, the first known counts, and of those the direct one."""
    days = F.datediff("end", "start")
    direct = facts.where(days.between(*QUARTER)).select(*keys, "end", "value", "filed", F.lit(0).alias("_rank"))
    w = by(*keys, "start", order="end")
    step = facts.where(days.between(*PERIOD)).withColumn("_prev", F.lag("end").over(w)).withColumn("_value", F.col("value") - F.lag("value").over(w)).withColumn("_filed", F.greatest("filed", F.lag("filed").over(w)))
    derived = step.where(F.datediff("end", "_prev").between(*QUARTER)).select(*keys, "end", F.col("_value").alias("value"), F.col("_filed").alias("filed"), F.lit(1).alias("_rank"))
    both = direct.union(derived)
    return both.groupBy(*keys, "end").agg(F.min(F.struct("filed", "_rank", "value")).alias("s")).select(*keys, "end", "s.value", "s.filed")


def annual_values(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Values of facts that cover a year, the first filed of each end."""
    year = facts.where(F.datediff("end", "start").between(*ANNUAL))
    return year.groupBy(*keys, "end").agg(F.min(F.struct("filed", "value")).alias("s")).select(*keys, "end", "s.value", "s.filed")


def trailing_year(quarters: DataFrame, annual: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of four quarters in a row, known with the last of them; where a year's own figure is known no later, that figure."""
    w = by(*keys, order="end")
    four, three = w.rowsBetween(-3, 0), w.rowsBetween(-2, 0)
    x = quarters.withColumn("_step", F.datediff("end", F.lag("end").over(w)).between(*QUARTER).cast("int"))
    x = x.withColumns({"_ok": F.sum("_step").over(three), "_n": F.count("*").over(four), "_span": F.datediff("end", F.first("end").over(four)), "_sum": F.sum("value").over(four), "_filed": F.max("filed").over(four)})
    sums = x.where((F.col("_ok") == 3) & (F.col("_n") == 4) & F.col("_span").between(*THREE)).select(*keys, "end", F.col("_sum").alias("value"), F.col("_filed").alias("filed"), F.lit(1).alias("_rank"))
    both = annual.select(*keys, "end", "value", "filed", F.lit(0).alias("_rank")).union(sums)
    return both.groupBy(*keys, "end").agg(F.min(F.struct("filed", "_rank", "value")).alias("s")).select(*keys, "end", "s.value", "s.filed")


def shares_pair(ends: DataFrame, shares: DataFrame, keys: list[str]) -> DataFrame:
    """``ends`` (keys, end, known) with ``shares`` and ``prior_shares``: diluted shares of the period and of the one a year before, both as
    public when the period was filed.

    The period's are those of the shortest period that ends within NEAR days, first filed; the year-before's are the latest filed up
    to then, of a period of like length (PRIOR days), so a split in between is restated in both. ``shares``: (keys, start, end, value,
    filed, tag_rank). Facts meet only ends of their own span of days.
    """
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    width = 64
    s = shares.withColumn("_days", F.datediff("end", "start")).where(F.col("_days").between(*PERIOD))
    s = s.select(*keys, F.col("end").alias("_end"), F.col("value").alias("_value"), F.col("filed").alias("_filed"), "tag_rank", "_days", F.floor(day("end") / width).alias("_bucket"))

    def near(x: DataFrame, center: Column, reach: int) -> DataFrame:
        spots = F.array_distinct(F.array(F.floor((day(center) - reach) / width), F.floor((day(center) + reach) / width)))
        met = x.withColumn("_bucket", F.explode(spots)).join(s, [*keys, "_bucket"])
        return met.where((F.col("_filed") <= F.col("known")) & (F.abs(F.datediff("_end", center)) <= reach))

    now = near(ends, F.col("end"), NEAR).groupBy(*keys, "end", "known").agg(F.min(F.struct("_days", "_filed", (-F.col("tag_rank")).alias("_r"), "_value")).alias("_c"))
    now = now.select(*keys, "end", "known", F.col("_c._value").alias("shares"), F.col("_c._days").alias("_len"))
    before = near(now, F.date_sub("end", YEAR_DAYS), PRIOR).where(F.abs(F.col("_days") - F.col("_len")) <= PRIOR)
    before = before.groupBy(*keys, "end").agg(F.max(F.struct("_filed", (-F.col("tag_rank")).alias("_r"), "_value")).alias("_p")).select(*keys, "end", F.col("_p._value").alias("prior_shares"))
    return ends.join(now.drop("known", "_len"), [*keys, "end"], "left").join(before, [*keys, "end"], "left")


def score_history(facts: DataFrame, key: str = "cik", basis: str = "ttm") -> DataFrame:
    """(key, end, known, the nine tests, score, n_scored): the nine-test score at every balance sheet that has one a year before it.

    ``facts``: (key, field, tag_rank, start, end, value, filed); start is null for a day's figures. First-filed figures count. A balance
    sheet is known when its total assets are filed; a figure filed over LATE days after that is unknown for it, and so is the
    test that needs it. Missing debt is none; a missing gross profit is revenue less its cost. Flows are sums of a year
    (``basis`` "ttm") or quarters. The score is known when both years are. ``n_scored``: tests whose figures are all there.
    """
    k = [key, "field"]
    stocks = first_facts(facts.where(F.col("field").isin(*STOCKS)), [*k, "end"])
    flows = facts.where(F.col("field").isin(*FLOWS) & F.col("start").isNotNull())
    flows = first_facts(flows, [*k, "start", "end"])
    quarters = discrete_quarters(flows, k)
    flow = trailing_year(quarters, annual_values(flows, k), k) if basis == "ttm" else quarters
    ends = stocks.where("field = 'total_assets'").select(key, "end", F.col("filed").alias("known"), F.col("value").alias("total_assets"))
    inputs = [f for f in (*STOCKS, *FLOWS) if f != "total_assets"]
    figures = stocks.where("field <> 'total_assets'").unionByName(flow).select(*k, "end", "value", "filed")
    # every balance sheet asks for every other field's figure nearest to its day
    asked = ends.select(key, "end", "known", F.explode(F.array(*map(F.lit, inputs))).alias("field"))
    found = asof_nearest(asked.select(*k, "end"), figures, k, ["value", "filed"], NEAR, order="end")
    timely = found.join(ends.select(key, "end", "known"), [key, "end"]).where(F.col("filed") <= F.date_add("known", LATE))
    wide = timely.groupBy(key, "end").pivot("field", inputs).agg(F.first("value"))
    x = ends.join(wide, [key, "end"], "left").withColumn("lt_debt", F.coalesce("lt_debt", F.lit(0.0))).withColumn("gross", F.coalesce(F.col("revenue") - F.col("cogs"), F.col("gross_profit")))
    x = shares_pair(x, facts.where("field = 'diluted_shares' and start is not null").drop("field"), [key])
    names = ["known", "total_assets", "net_income", "ocf", "lt_debt", "current_assets", "current_liabilities", "gross", "revenue"]
    prior = asof_nearest(x.select(key, F.date_sub("end", YEAR_DAYS).alias("end")), x.select(key, "end", *names), [key], names, PRIOR, order="end")
    prior = prior.select(key, F.date_add("end", YEAR_DAYS).alias("end"), *(F.col(n).alias(f"p_{n}") for n in names))
    x = x.join(prior, [key, "end"]).where("p_total_assets is not null and known is not null")
    tests, needs = piotroski_tests(x)
    score = sum((t for t in tests.values()), F.lit(0))
    scored = sum((n.cast("int") for n in needs.values()), F.lit(0))
    return x.select(key, "end", F.greatest("known", "p_known").alias("known"), *(t.alias(n) for n, t in tests.items()), score.alias("score"), scored.alias("n_scored"))


def piotroski_tests(x: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
    """Of rows with this year's figures and the prior year's (``p_``): each test as 1 or 0, and whether its figures are there."""
    c = {n: F.col(n) for n in ("total_assets", "net_income", "ocf", "lt_debt", "current_assets", "current_liabilities", "gross", "revenue", "shares")}
    p = {n: F.col("prior_shares" if n == "shares" else f"p_{n}") for n in c if n != "ocf"}
    ratio = lambda d, a, b: d[a] / F.nullif(d[b], F.lit(0.0))
    more = lambda a, b: ratio(c, a, b) > ratio(p, a, b)
    rules = {
        "roa": (ratio(c, "net_income", "total_assets") > 0, ["net_income"], False), "cfo": (ratio(c, "ocf", "total_assets") > 0, ["ocf"], False),
        "d_roa": (more("net_income", "total_assets"), ["net_income"], True), "accrual": (c["ocf"] > c["net_income"], ["ocf", "net_income"], False),
        "d_lever": (ratio(c, "lt_debt", "total_assets") < ratio(p, "lt_debt", "total_assets"), ["lt_debt"], True), "d_liquid": (more("current_assets", "current_liabilities"), ["current_assets", "current_liabilities"], True),
        "eq_offer": (c["shares"] <= p["shares"], ["shares"], True), "d_margin": (more("gross", "revenue"), ["gross", "revenue"], True), "d_turn": (more("revenue", "total_assets"), ["revenue"], True),
    }
    there = lambda names, both: reduce(and_, [d[n].isNotNull() for n in names for d in ((c, p) if both else (c,))])
    return {k: F.coalesce(t.cast("int"), F.lit(0)) for k, (t, _, _) in rules.items()}, {k: there(n, both) for k, (_, n, both) in rules.items()}


def known_values(calendar: DataFrame, facts: DataFrame, keys: list[str], value: str, max_age: int) -> DataFrame:
    """Each day's latest fact filed strictly before it; null once its period ended more than ``max_age`` days ago."""
    rows = facts.select(*keys, F.col("filed").alias("date"), F.col("end"), F.col(value))
    seen = asof_backward(calendar, rows, keys, ["end", value], strict=True)
    return seen.withColumn(value, F.when(F.datediff("date", "end") <= max_age, F.col(value)))
