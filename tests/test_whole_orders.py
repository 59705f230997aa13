"""net_orders nets all fills, not the first of each sleeve and symbol."""

from collections import Counter, defaultdict

import __spark_entry__
from ledgerlake.sources import testdata
from tests.test_oracle import SF


def test_all_fills_are_netted(spark):
    net, sleeves, want, n = Counter(), defaultdict(set), [], 0
    for r in testdata.fills(spark, SF).collect():
        n += 1
        timing, quantity = "close" if r.seq % 2 else "open", abs(r.qty)
        if r.seq % 7 == 0:
            want.append((r.symbol, timing, r.side, quantity, "limit", str(r.sleeve)))
        else:
            net[r.symbol, timing] += quantity if r.side == "BUY" else -quantity
            sleeves[r.symbol, timing].add(str(r.sleeve))
    want += [(*k, "BUY" if q > 0 else "SELL", abs(q), "market", ", ".join(sorted(sleeves[k]))) for k, q in net.items() if q]
    columns = ["symbol", "timing", "side", "quantity", "kind", "strategies"]
    found = __spark_entry__.queries()["net_orders"](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert n > 40 * testdata.fills(spark, SF).select("sleeve", "symbol").distinct().count()  # more than the first 40 of each
