import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import common, decontam, simhash

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_roots(prints):
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                root[find(p)] = find(q)
    return {p: find(p) for p in prints}


def check(df):
    rows = df.select("doc_id", "text").collect()
    prints = [brute_print(r.text) for r in rows]
    root, least = brute_roots(prints), defaultdict(list)
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[root[p]].append(r.doc_id)
    want = sorted(((r.doc_id, f"{p:016x}", min(least[root[p]], default=None)) for r, p in zip(rows, prints)), key=str)
    found = simhash.near_duplicates(df)
    assert sorted(map(tuple, found.select("doc_id", simhash.hex16("fingerprint"), "component_id").collect()), key=str) == want


def test_components_of_real_documents(documents):
    check(documents)


def test_components_of_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    check(no_documents)


def test_large_cells_and_hot_keys_are_cut(spark, monkeypatch):
    """Two thousand fingerprints about one centre, in cells cut into many blocks, and keys that count as hot."""
    monkeypatch.setattr(simhash, "CELL_ROWS", 64)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = np.random.default_rng(1)
    centre, prints = int(rng.integers(2**63)), set()
    while len(prints) < 2000:
        prints.add(centre ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 7)))))
    u = np.array(sorted(prints), np.uint64)
    found = simhash.components(simhash.links(spark.createDataFrame([(int(x),) for x in u.view(np.int64)], "fingerprint long").repartition(4)))
    root = {np.uint64(r.node % 2**64): r.root % 2**64 for r in found.collect()}
    want = brute_roots(u.tolist())
    classes = {(root.get(np.uint64(p), p), want[p]) for p in u.tolist()}
    assert len(classes) == len({a for a, _ in classes}) == len({b for _, b in classes})
    texts = ["same text again and again"] * 9 + ["another text of its own"] * 2 + ["", None]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 63), max_size=5)), max_size=60))
def test_grid_loses_no_link(bases, changes):
    prints = set(bases)
    for base, bits in changes:
        p = bases[base % len(bases)]
        for b in bits:
            p ^= 1 << b
        prints.add(p)
    u = np.array(sorted(prints), np.uint64)
    cell, row, native = simhash.grid_cells(u)
    a, b = simhash.link_cells(cell, u[row], native)
    labels = np.arange(len(u))
    simhash.join_labels(labels, np.searchsorted(u, a), np.searchsorted(u, b))
    root = brute_roots(u.tolist())
    assert len(set(zip(labels.tolist(), (root[p] for p in u.tolist())))) == len(set(labels.tolist())) == len(set(root.values()))


def test_components_of_long_chains(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(links).collect()}
    assert found == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_one_document_of_each_component_stays(documents, odd_documents, no_documents):
    found = simhash.near_duplicates(documents)
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found.collect()}
    odd = simhash.keep_one(odd_documents)
    assert odd.columns == odd_documents.columns and odd.where("doc_id = 8").count() == 1
    assert simhash.keep_one(no_documents).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, windows):
    w = WORD.findall((text or "").translate(LOW))
    hit, items = [False] * len(w), set()
    for n in {len(k) for k in windows}:
        for q in range(len(w) - n + 1):
            if tuple(w[q : q + n]) in windows:
                items |= windows[tuple(w[q : q + n])]
                hit[q : q + n] = [True] * n
    return len(w), sum(hit), sorted(items, key=lambda x: (x is None, x))


def windows_of(benchmark):
    out = defaultdict(set)
    for r in benchmark.collect():
        w = WORD.findall((r.text or "").translate(LOW))
        n = min(10, len(w))
        for q in range(len(w) - n + 1 if n else 0):
            out[tuple(w[q : q + n])].add(None if r.item_id is None else str(r.item_id))
    return out


@pytest.mark.parametrize(("bits", "batch", "hot"), [(28, 20_000, 64), (6, 7, 64), (28, 20_000, 0), (28, 20_000, 1)])
def test_passages_match_brute_force(spark, documents, benchmark, odd_documents, no_documents, bits, batch, hot, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BITS", bits)  # a map that is full lets all fingerprints through to the join
    monkeypatch.setattr(decontam, "BATCH_WINDOWS", batch)
    monkeypatch.setattr(decontam, "HOT_PLACES", hot)  # 0: every fingerprint is joined with its windows; 1: all but those of one place
    extra = spark.createDataFrame([(None, "no id at ALL"), (900, "word1"), (901, None), (902, ""), (903, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15"), (903, "same row"), (904, "same row")], "item_id long, text string")
    bench = benchmark.select("item_id", "text").union(extra)
    windows = windows_of(bench)
    for df in (documents, odd_documents, no_documents):
        found = decontam.find_passages(df, bench).collect()
        want = sorted(((r.doc_id, *brute_hits(r.text, windows)) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in found), key=str) == want
        assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_hit for r in found)
    kept = decontam.drop_contaminated(documents, bench)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in documents.collect() if not brute_hits(r.text, windows)[1]}


CONTEXT = "print long, n int, left array<string>, gram array<string>, right array<string>, window string"


@pytest.mark.parametrize("hot", [64, 0])
def test_equal_fingerprints_are_told_apart_and_extended(spark, hot, monkeypatch):
    """Where all fingerprints collide, the join still compares words; hits reach as far as the words agree."""
    monkeypatch.setattr(decontam, "HOT_PLACES", hot)
    w = [f"w{i}" for i in range(30)]
    item = lambda p, name: (7, 10, w[max(0, p - 5) : p][::-1], w[p : p + 5], w[p + 5 : p + 10], None, name)
    items = [item(10, "i"), item(3, None), (7, 2, None, None, None, "a b", "s"), (7, 3, None, None, None, "a b", "k")]
    prints = spark.createDataFrame(items, f"{CONTEXT}, item string")
    other = ["x1", "x2", "x3"]
    rows = [
        ("whole", 7, 10, 40, w[5:10][::-1], w[10:15], w[15:20], None), ("edge", 7, 10, 2, w[8:10][::-1], w[10:15], [*w[15:18], *other[:2]], None), ("short", 7, 10, 2, w[8:10][::-1], w[10:15], [*w[15:17], *other], None),
        ("gram", 7, 10, 2, w[8:10][::-1], [*w[10:14], "z"], w[15:20], None), ("pair", 7, 2, 6, None, None, None, "a b"), ("pair", 7, 3, 1, None, None, None, "b a"), ("none", None, None, None, None, None, None, None),
    ]
    found = spark.createDataFrame(rows, f"_key string, print long, n int, place long, {CONTEXT.split(', ', 2)[2]}")
    hits = {}
    for r in decontam.join_prints(found, prints).collect():
        hits.setdefault((r._key, r.item), set()).update(range(r.place, r.place + r.n))
    assert hits == {("whole", "i"): set(range(35, 50)), ("edge", "i"): set(range(0, 10)), ("pair", "s"): {6, 7}}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=10, max_size=40), st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_equal_windows_choose_the_same_place(words, before, after):
    """A text inside another: every window of it chooses the same k-gram there, and few are chosen."""
    codes = lambda x: np.array([ord(c) for c in x], np.uint64)
    alone, inside = codes(words), codes([*before, *words, *after])
    a, prints = decontam.selected(alone, np.array([0, len(alone)]))
    b, others = decontam.selected(inside, np.array([0, len(inside)]))
    assert set(zip((a + len(before)).tolist(), prints.tolist())) <= set(zip(b.tolist(), others.tolist()))
    for q in range(len(words) - 9):
        assert any(q <= p <= q + 5 for p in a.tolist())


def test_few_places_are_chosen():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    bounds = np.array([0, 2000, 2004, 5000])
    at, _ = decontam.selected(x, bounds)
    assert 0.24 < len(at) / len(x) < 0.34 and not set(range(1996, 2004)) & set(at.tolist())


def test_an_empty_benchmark_hits_nothing(documents, benchmark):
    found = decontam.contamination_digests(documents, benchmark.where("false"))
    assert found.where("contaminated").count() == 0 and found.count() == documents.count()
