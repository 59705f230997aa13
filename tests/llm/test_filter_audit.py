"""The audit of filters against a loop over all orders, and by hand."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from ledgerlake.llm import filter_audit as fa


def fails(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append("".join(c for c, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)),
            doc_id is not None and doc_id > least[t],
        )) if bad))
    return out


def brute(rows, labels):
    good, bad = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    parts, shapley, out = defaultdict(list), Counter(), {}
    for (doc_id, _, part), f in zip(rows, fails(rows)):
        parts[part or ""].append((doc_id, f))
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            left = docs
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                failing = [x for x in docs if c in x[1]]
                left = [x for x in left if c not in x[1]]
                shapley[part, c] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(x[1] == c for x in docs), sum(x[0] in good for x in gone), sum(x[0] in bad for x in gone), c]
    return sorted((*k, *v[:-1], shapley[k[0], v[-1]]) for k, v in out.items())


def check(docs, labels):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in labels.select("doc_id", "quality", "toxic").collect() if r.doc_id is not None]
    found = sorted(map(tuple, fa.audit(docs, labels).collect()))
    assert found == brute(rows, marks)
    return found


def test_documents(documents, labels):
    check(documents, labels)


def test_odd_rows_and_labels(spark, odd_documents, no_documents, labels):
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, None, 1), (None, 1, 1), (9, 1, 1), (404, 1, 1)], "doc_id long, quality int, toxic int")
    check(odd_documents, some.selectExpr("*", "'x' as part", "1 as n", "2 as good"))
    assert fa.audit(no_documents, labels).collect() == []
    check(odd_documents, some.where("false"))


def test_overall_rows_and_a_hand_made_part(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, "p"), (2, long, "p"), (3, long, "q"), (4, "#", "q"), (5, "A " * 300, "q"), (6, None, None), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 0), (5, 0, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in fa.audit(docs, labels, overall=True).collect()}
    assert len(got) == 600 * 4
    assert got["p", "EABCD", 1].removed == 1 and got["p", "EABCD", 1].good_lost == 1 and got["p", "EABCD", 1].shapley == 120
    assert got["q", "BACDE", 1].toxic_lost == 1 and got["q", "CABDE", 1].removed == 1 and got["q", "BCADE", 2].redundant == 1
    assert got["", "ABCDE", 1].kept == 0 and got["", "EABCD", 1].removed == 1
    assert got[None, "ABCDE", 1].kept == 4 and got[None, "EABCD", 1].removed == 3


def test_copies_of_one_text_without_limit(spark, monkeypatch):
    from ledgerlake.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"text {i // 9}", "s") for i in range(300)], "doc_id long, text string, source string")
    check(docs, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"))
