"""positions_daily covers every sleeve, symbol and day since the first fill."""

import __spark_entry__
from ledgerlake.sources import testdata
from tests.test_oracle import SF


def test_positions_of_all_years(spark):
    found = __spark_entry__.queries()["positions_daily"](spark, SF).select("sleeve", "symbol", "date").collect()
    days, first = {r.date for r in testdata.returns(spark, SF).select("date").distinct().collect()}, {}
    for r in testdata.fills(spark, SF).select("sleeve", "symbol", "date").collect():
        first[r.sleeve, r.symbol] = min(r.date, first.get((r.sleeve, r.symbol), r.date))
    assert {tuple(r) for r in found} == {(*k, d) for k, a in first.items() for d in days if d >= a} and len(found) == len(set(map(tuple, found)))
