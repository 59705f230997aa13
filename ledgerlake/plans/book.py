"""The book façade: one object that binds the tables of a book and derives its accounts once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger, metrics, orders, simulation


class Book:
    """Lazy accounts of fills, flows and prices. Each property is a DataFrame; nothing runs until a caller asks for rows."""

    def __init__(self, fills: DataFrame, cashflows: DataFrame, prices: DataFrame, backtests: DataFrame | None = None, dividends: DataFrame | None = None, instruments: DataFrame | None = None):
        self.fills, self.cashflows, self.prices, self.backtests = fills, cashflows, prices, backtests
        self.dividends, self.instruments = dividends, instruments
        self.calendar = ledger.build_calendar(prices.select("date"), fills, cashflows)

    @cached_property
    def positions(self) -> DataFrame:
        return ledger.positions_daily(self.fills, self.prices, self.calendar, self.dividends, self.instruments)

    @cached_property
    def daily(self) -> DataFrame:
        return ledger.twr_returns(ledger.sleeve_daily(self.positions, self.cashflows, self.calendar))

    @cached_property
    def total(self) -> DataFrame:
        return ledger.twr_returns(ledger.book_total(self.daily, self.cashflows, self.calendar).withColumn("sleeve", F.lit("__total__")))

    @cached_property
    def round_trips(self) -> DataFrame:
        return ledger.round_trips(self.fills, self.calendar, self.instruments)

    def live_returns(self) -> DataFrame:
        """(series_id, date, ret) of each sleeve, funded days only."""
        return self.daily.where("ret is not null").select(F.col("sleeve").cast("string").alias("series_id"), "date", "ret")

    def live_start(self) -> DataFrame:
        return self.live_returns().groupBy("series_id").agg(F.min("date").alias("start"))

    def backtest_then_live(self) -> DataFrame:
        """Backtest returns before a series' live start, live returns from then on."""
        live = self.live_returns()
        before = self.backtests.join(F.broadcast(self.live_start()), "series_id", "left").where("start is null or date < start").select("series_id", "date", "ret")
        return before.unionByName(live)

    def live_summary(self, rf: float = 0.0) -> DataFrame:
        return metrics.perf_summary(self.live_returns(), rf)

    def trade_summary(self) -> DataFrame:
        """Of each sleeve's closed trips."""
        return metrics.trade_summary(self.round_trips.where("closed"), "sleeve")

    def attribution(self) -> DataFrame:
        """Profit, dividends included, of each symbol in each sleeve, in each sleeve, and in all."""
        return self.positions.rollup("sleeve", "symbol").agg(F.sum("pnl").alias("pnl"))

    def tracking(self) -> DataFrame:
        return simulation.tracking(self.live_returns(), self.backtests)

    def money_weighted(self) -> DataFrame:
        """Of each sleeve: external flows against the last NAV."""
        out = self.cashflows.where("external").select("sleeve", "date", (-F.col("value")).alias("amount"))
        end = self.daily.groupBy("sleeve").agg(F.max("date").alias("date"), F.max_by("nav", "date").alias("amount"))
        return orders.money_weighted(out.unionByName(end), "sleeve")

    def capital_summary(self) -> DataFrame:
        """Money in and out, NAV, profit, and money- and time-weighted returns of each sleeve."""
        return ledger.capital_summary(self.daily, self.cashflows, self.calendar).join(self.money_weighted().select("sleeve", "annual", "period"), "sleeve", "left")

    def kpis(self) -> DataFrame:
        return ledger.kpis(self.daily)

    def warnings(self) -> DataFrame:
        return ledger.ledger_warnings(self.daily, self.fills, self.prices, self.cashflows).union(
            ledger.unbalanced_transfers(self.cashflows).select(F.col("date").cast("string"), F.lit("transfers do not balance"))
        ).distinct()
