"""The pipeline's near-duplicate stage finds every pair of five-word similarity 0.8 or more."""

import random
import re

import corpus_pipeline
from ledgerlake.llm import jaccard, simhash

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_least(texts):
    """The least id of each document's component, from all pairs."""
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in keys}


def edited():
    """Texts, copies with words changed here and there (about 0.7 to 1), chains, one line in all of a group, short texts."""
    rng, texts = random.Random(5), {}
    word = lambda: f"w{rng.randrange(5000)}"
    line = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([20, 60, 200]))]
        for _ in range(6):
            texts[len(texts)] = " ".join(base)
            for _ in range(rng.randrange(1, 1 + max(1, len(base) // 60))):
                base[rng.randrange(len(base))] = word()
    for i in range(40):
        texts[len(texts)] = " ".join([*line, *(word() for _ in range(rng.randrange(1, 40)))])
    for t in (None, "", " ", "one two", "ONE  two", "one two three four five", "one two three four five six"):
        texts[len(texts)] = t
    return texts


def test_every_pair_is_found(spark):
    texts = edited()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute_least(texts)
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert found == want
    stage = corpus_pipeline.STAGES[2][1]
    assert {r.doc_id for r in stage(spark, df, "").collect()} == set(want.values())
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} != set(want.values())  # four of 64 bits miss pairs


def test_the_stage_asks_fingerprints_first(spark, monkeypatch):
    texts = {k: t for k, t in edited().items() if shingles(t)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    asked, ask = [], jaccard.by_fingerprint

    def seen(nodes):
        pairs = ask(nodes)
        asked.append([tuple(r) for r in pairs.collect()])
        return pairs

    monkeypatch.setattr(jaccard, "by_fingerprint", seen)
    stage = corpus_pipeline.STAGES[2][1]
    assert {r.doc_id for r in stage(spark, df, "").collect()} == set(brute_least(texts).values())
    # what the pairs connect is what operator 8 connects, but for documents of one shingle set
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in asked[0]:
        root[find(b)] = find(a)
    node = {r.doc_id: r.node for r in jaccard.near_duplicates(df).collect()}
    for r in simhash.near_duplicates(df).collect():
        assert find(node[r.doc_id]) == find(node[r.component_id])
    assert len(asked[0]) > 0
