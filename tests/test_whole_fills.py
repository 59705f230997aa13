"""Numbering and episodes of fills take no sort of a key's whole history more than once; prices are broadcast for one panel only."""

from pyspark.sql import functions as F

from ledgerlake.operators import ledger
from ledgerlake.plans import ledger_queries, stock_queries
from ledgerlake.sources import testdata as v

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fills_are_numbered_within_their_days(spark):
    fills = v.fills(spark, SF)
    assert fills.groupBy("sleeve", "symbol").agg(F.min("seq").alias("a"), F.max("seq").alias("z"), F.count_distinct("seq").alias("n"), F.count("*").alias("m")).where("a <> 1 or z <> n or n <> m").count() == 0
    sorts = [x for x in plan_of(fills).splitlines() if " Sort [" in x]
    assert sorts and not any("l_orderkey" in x and "date#" not in x.split("l_orderkey")[0] for x in sorts)


def test_trips_sort_a_history_once(spark):
    cut = spark.createDataFrame([("s", "a", i, 5.0, 0.5, q) for i, q in enumerate((2.0, -2.0, 3.0, -5.0, 1.0, 1.0))], "sleeve string, symbol string, seq long, price double, fees double, qty double").withColumn("date", F.lit("2020-01-01").cast("date"))
    plan = plan_of(ledger.round_trips(cut))
    assert plan.count(" Sort [") == 1 and "SortAggregate" not in plan
    got = {r.episode: (r.direction, r.closed, r.quantity, r.fills) for r in ledger.round_trips(cut).collect()}
    assert got == {1: ("long", True, 2.0, 2), 2: ("long", True, 3.0, 2), 3: ("short", True, 2.0, 3)}


def test_trips_of_days_are_those_of_the_history(spark):
    """Flips, days that begin flat or held, parts of shares, a key that is null and one that stays open."""
    qty = [2.0, -3.0, 1.0, 1.0, -1.0, 0.1, 0.2, -0.3, 5.0, -2.0, -4.0, -1.0, 3.0, -3.0, 7.0, 1.0, 1.0, -20.0, 11.0, 4.0]
    rows = [(s, "a", i, 5.0 + i % 3, 0.5, q * (k + 1), 1 + i // (k + 1)) for k, s in enumerate(("s", None, "t")) for i, q in enumerate(qty)]
    fills = spark.createDataFrame(rows, "sleeve string, symbol string, seq long, price double, fees double, qty double, d int").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    number = lambda x: round(x, 9) if isinstance(x, float) else x
    rows_of = lambda x: sorted([tuple(number(v) for v in r) for r in x.select(sorted(x.columns)).collect()], key=str)
    want, got = ledger.round_trips(fills), ledger.round_trips(fills, unordered=fills.drop("seq"))
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and len(rows_of(got)) > 20


def test_trips_sort_days_and_no_history(spark):
    windows = [x for x in plan_of(ledger_queries._trips(spark, SF)).splitlines() if " Sort [" in x and "seq#" in x]
    assert windows and all("day#" in x.split("seq#")[0] for x in windows)


def test_tasks_grow_in_number_with_the_fills(spark, monkeypatch):
    """Days of fills are dealt by the count of rows, whatever the session's partitions (4 here) and however small they compress."""
    monkeypatch.setattr(v, "TASK_ROWS", 250)
    rows = v.read(spark, SF, "lineitem").count()
    assert v.fill_parts(spark, SF) == -(-rows // 250) > 20
    most = v.fills(spark, SF).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 4 * 250
    for key in ("date", "day"):
        dealt = [x for x in plan_of(ledger_queries._trips(spark, SF)).splitlines() if "REPARTITION_BY_NUM" in x and f", {key}#" in x]
        assert dealt and all(f", {v.fill_parts(spark, SF)})" in x for x in dealt)


def test_dealt_fills_are_not_held_to_be_sorted(spark, monkeypatch):
    """200 partitions are written as they come; more of them only where a partition would be large."""
    rows = v.read(spark, SF, "lineitem").count()
    for task, parts in ((rows // 600, 200), (rows // 6000, -(-rows // (10 * (rows // 6000))))):
        monkeypatch.setattr(v, "TASK_ROWS", task)
        assert v.fill_parts(spark, SF) == parts


def test_dates_alone_need_no_numbers(spark):
    assert "REPARTITION_BY_NUM" not in plan_of(ledger_queries.calendar(spark, SF))


def test_a_panel_reads_its_tables_once(spark):
    plan = plan_of(stock_queries.panel(spark, SF))
    assert "lineitem" not in plan and "l_partkey" not in plan


def test_open_positions_share_a_calendar(spark, monkeypatch):
    made, make = [], ledger_queries.known_calendar
    monkeypatch.setattr(ledger_queries, "known_calendar", lambda *a: made.append(1) or make(*a))
    assert ledger_queries.open_positions(spark, SF).count() > 0 and len(made) == 1
