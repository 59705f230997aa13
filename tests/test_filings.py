"""Quarters, sums of a year, shares and scores from hand-made filings, against the rules one by one."""

import datetime as dt

import pytest

from ledgerlake.operators import fundamentals as fu

D = dt.date.fromisoformat
SCHEMA = "cik int, field string, tag_rank int, start date, end date, value double, filed date"
QUARTERS = [("2019-01-01", "2019-03-31"), ("2019-04-01", "2019-06-30"), ("2019-07-01", "2019-09-30"), ("2019-10-01", "2019-12-31"), ("2020-01-01", "2020-03-31"), ("2020-04-01", "2020-06-30"), ("2020-07-01", "2020-09-30"), ("2020-10-01", "2020-12-31")]


def company(cik=1, late=(), grow=1.1):
    """Two years of quarters, each filed 30 days after its end; the second year is better in all. ``late``: fields of the last quarter that come 40 days later."""
    rows = []
    for i, (start, end) in enumerate(QUARTERS):
        g = grow if i >= 4 else 1.0
        day = D(end) + dt.timedelta(30)
        for field, value in (("total_assets", 1000.0), ("current_assets", 300.0 * g), ("current_liabilities", 100.0), ("lt_debt", 200.0 / g)):
            rows.append((cik, field, 0, None, D(end), value, day))
        for field, value in (("revenue", 100.0 * g), ("cogs", 60.0), ("net_income", 10.0 * g), ("ocf", 12.0 * g)):
            rows.append((cik, field, 0, D(start), D(end), value, day + dt.timedelta(40 if field in late and i == 7 else 0)))
        rows.append((cik, "diluted_shares", 0, D(start), D(end), 50.0, day))
    return rows


def score(spark, rows, **options):
    return {(r.cik, r.end.isoformat()): r for r in fu.score_history(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_a_better_year_scores_nine_and_late_figures_void_their_tests(spark):
    rows = company() + company(2, late=("net_income", "cogs")) + company(3, grow=0.9)
    got = score(spark, rows)
    end = "2020-12-31"
    assert got[1, end].score == 9 and got[1, end].n_scored == 9 and got[1, end].known == D("2021-01-30")
    late = got[2, end]
    # no income: three tests void; no cost and no gross profit: the margin too
    assert (late.roa, late.d_roa, late.accrual, late.d_margin, late.cfo) == (0, 0, 0, 0, 1) and late.score == 5 and late.n_scored == 5
    assert late.known == D("2021-01-30")
    worse = got[3, end]
    assert (worse.d_roa, worse.d_lever, worse.d_liquid, worse.d_margin, worse.d_turn) == (0, 0, 0, 0, 0) and worse.score == 4
    # quarters a year apart are compared; the first year has none before it
    assert {e for c, e in got if c == 1} == {"2020-03-31", "2020-06-30", "2020-09-30", "2020-12-31"}
    # of sums of a year only the last quarter of the first year has one, so flows are known for 2020-12-31 alone on both sides
    assert got[1, "2020-03-31"].n_scored == 6 and score(spark, company(), basis="quarter")[1, "2020-03-31"].n_scored == 9


def test_restatements_are_ignored_and_best_tags_win(spark):
    later = [(1, "total_assets", 0, None, D("2020-12-31"), 1.0, D("2021-06-01")), (1, "net_income", 1, D("2020-10-01"), D("2020-12-31"), -500.0, D("2021-01-30"))]
    assert score(spark, company() + later)[1, "2020-12-31"].score == 9


def test_quarters_from_sums_since_the_first_of_the_year(spark):
    ytd = [(1, "x", D("2020-01-01"), D(e), v, D(f)) for e, v, f in (("2020-03-31", 10.0, "2020-05-01"), ("2020-06-30", 25.0, "2020-08-01"), ("2020-09-30", 45.0, "2020-11-01"), ("2020-12-31", 70.0, "2021-02-01"))]
    ytd += [(1, "x", D("2020-07-01"), D("2020-09-30"), 21.0, D("2020-11-01")), (1, "x", D("2021-01-01"), D("2021-03-31"), 30.0, D("2021-05-01"))]
    flows = spark.createDataFrame(ytd, "cik int, field string, start date, end date, value double, filed date")
    q = fu.discrete_quarters(flows, ["cik", "field"])
    assert {r.end.isoformat(): (r.value, r.filed.isoformat()) for r in q.collect()} == {
        "2020-03-31": (10.0, "2020-05-01"), "2020-06-30": (15.0, "2020-08-01"), "2020-09-30": (21.0, "2020-11-01"), "2020-12-31": (25.0, "2021-02-01"), "2021-03-31": (30.0, "2021-05-01"),
    }
    year = fu.trailing_year(q, fu.annual_values(flows, ["cik", "field"]), ["cik", "field"])
    # the year's own 70 stands before the sum of quarters (71); no sum without four quarters in a row
    assert {r.end.isoformat(): r.value for r in year.collect()} == {"2020-12-31": 70.0, "2021-03-31": pytest.approx(15 + 21 + 25 + 30)}


def test_shares_are_those_public_on_the_day_of_filing(spark):
    ends = spark.createDataFrame([(1, D("2020-12-31"), D("2021-02-01")), (2, D("2020-12-31"), D("2021-02-01"))], "cik int, end date, known date")
    rows = [
        (1, D("2020-10-01"), D("2020-12-31"), 200.0, D("2021-02-01"), 0), (1, D("2020-01-01"), D("2020-12-31"), 190.0, D("2021-01-01"), 0), (1, D("2020-10-01"), D("2020-12-31"), 999.0, D("2021-03-01"), 0),
        (1, D("2019-10-01"), D("2019-12-31"), 100.0, D("2020-02-01"), 0), (1, D("2019-10-01"), D("2019-12-31"), 210.0, D("2021-02-01"), 0), (1, D("2019-10-01"), D("2019-12-31"), 1.0, D("2021-02-02"), 0),
        (1, D("2019-01-01"), D("2019-12-31"), 150.0, D("2021-02-01"), 0), (2, D("2020-10-01"), D("2020-12-31"), 5.0, D("2021-02-05"), 0),
    ]
    shares = spark.createDataFrame(rows, "cik int, start date, end date, value double, filed date, tag_rank int")
    assert {r.cik: (r.shares, r.prior_shares) for r in fu.shares_pair(ends, shares, ["cik"]).collect()} == {1: (200.0, 210.0), 2: (None, None)}
