"""Health rules of live records, folds and parameter grids."""

import datetime as dt

from ledgerlake.operators import expectations as ex
from ledgerlake.operators import studies as st

LIMITS = {"drawdown_percentile": 0.95, "return_percentile": 0.05, "vol_ratio": 1.5, "tracking_error": 0.05, "weight_drift": 0.05, "correlation": 0.8}


def test_health_rules(spark):
    rows = [(s, m, p, a) for s, parts in {"bad": (0.01, 0.02, 0.4), "low": (0.5, 0.1, 0.1), "good": (0.5, 0.5, 0.1), "young": (0.5, 0.5, 0.9)}.items() for (m, p, a) in (("max_drawdown", parts[0], -0.1), ("total", parts[1], 0.0), ("volatility", 0.5, parts[2]))]
    compared = spark.createDataFrame(rows, "series_id string, metric string, percentile double, actual double")
    live = spark.createDataFrame([("bad", 100), ("low", 100), ("good", 100), ("young", 10), ("none", 1), ("alone", 50)], "series_id string, days long")
    vol = spark.createDataFrame([(s, 0.1) for s in ("bad", "low", "good", "young")], "series_id string, volatility double")
    tracked = spark.createDataFrame([("good", 20, 0.01), ("low", 20, 0.2), ("bad", 5, 0.9)], "series_id string, n long, tracking_error double")
    weights = spark.createDataFrame([("bad", 0.5, 0.4), ("good", 0.3, 0.28)], "series_id string, weight double, target double")
    close = spark.createDataFrame([("bad", "good", 0.9, 50), ("bad", "low", 0.95, 10), ("good", "low", 0.2, 50)], "a string, b string, corr double, n long")
    found = {(r.level, r.scope, r.message) for r in ex.health_checks(compared, live, vol, tracked, weights, close, LIMITS).collect()}
    assert found == {
        ("red", "bad", "fell further than nearly all paths"), ("red", "bad", "earned less than nearly all paths"), ("amber", "bad", "swings more than its history"),
        ("amber", "low", "earned less than most paths"), ("amber", "low", "strays from its model"), ("green", "good", "as its history led to expect"),
        ("info", "young", "short record: ranks mean little"), ("green", "young", "as its history led to expect"), ("info", "none", "nothing traded so far"), ("info", "alone", "no history to expect from"),
        ("amber", "portfolio", "off its weight: bad"), ("amber", "portfolio", "move together: bad and good"),
    }
    calm = ex.health_checks(compared.where("series_id = 'good'"), live.where("series_id = 'good'"), vol, tracked, weights.where("series_id = 'good'"), close.where("corr < 0.5"), LIMITS).collect()
    assert {(r.level, r.scope) for r in calm} == {("green", "good"), ("green", "portfolio")}


def test_how_a_strategy_was_chosen_is_looked_at(spark):
    compared = spark.createDataFrame([(s, m, 0.5, 0.1) for s in "abcd" for m in ("max_drawdown", "total", "volatility")], "series_id string, metric string, percentile double, actual double")
    live = spark.createDataFrame([(s, 100) for s in "abcd"], "series_id string, days long")
    none = lambda schema: spark.createDataFrame([], schema)
    chosen = spark.createDataFrame([("a", True, 0), ("b", False, 0), ("c", True, 2)], "series_id string, chosen boolean, failed int")
    found = ex.health_checks(compared, live, none("series_id string, volatility double"), none("series_id string, n long, tracking_error double"), none("series_id string, weight double, target double"), none("a string, b string, corr double, n long"), LIMITS, chosen)
    assert {(r.level, r.scope, r.message) for r in found.collect()} == {
        ("green", "a", "as its history led to expect"), ("amber", "b", "not what the research chose"), ("amber", "c", "failed some of its last tests"), ("info", "d", "no record of how it was chosen"),
        ("green", "d", "as its history led to expect"), ("green", "portfolio", "all weights within their bands"),
    }


def test_folds_and_grids(spark):
    d = dt.date.fromisoformat
    assert st.make_folds("2010-03-01", "2015-04-15") == [
        (d("2010-03-01"), d("2013-02-28"), d("2013-03-01"), d("2014-02-28")), (d("2011-03-01"), d("2014-02-28"), d("2014-03-01"), d("2015-04-15")),
    ]
    assert st.make_folds("2010-03-01", "2015-06-15")[-1] == (d("2012-03-01"), d("2015-02-28"), d("2015-03-01"), d("2015-06-15"))
    assert st.make_folds("2010-01-01", "2012-06-01") == [] and st.make_folds("2010-01-01", "2014-12-31", anchored=True)[1][0] == d("2010-01-01")
    assert st.param_product(spark, {"a": [1, 2, 3], "b": [2, 3]}, "b >= a").count() == 5
