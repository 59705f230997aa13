"""PartEnum: similar sets share a signature, and the join finds every pair, whatever the buckets."""

import random

import numpy as np
import pytest

from ledgerlake.llm import partenum
from tests.llm.test_jaccard import brute_least, edited, shingles



def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    texts = {k: t for k, t in rows if shingles(t)}
    least = brute_least(texts)
    want = sorted((k, len(shingles(t)), least[k] if shingles(t) else k) for k, t in rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_duplicates(df).collect()) == want
    return want


@pytest.mark.parametrize("common_share", [0, 0.3])
def test_sets_of_enough_similarity_share_a_signature(common_share):
    rng = np.random.default_rng(7)
    sets, pairs = [], []
    for size in [*range(4, 70), 100, 127, 128, 250, 255, 256, 260, 819, 820, 1000, 1023, 1024, 1025, 4090, 4100]:
        for other in {size, size + 1, 5 * size // 4, (size + 5 * size // 4) // 2}:
            if 5 * size < 4 * other:
                continue
            both = -(-4 * (size + other) // 9)
            for _ in range(3):
                values = rng.integers(0, 1 << 63, size + other - both, dtype=np.uint64)
                a, b = np.unique(values[:size]), np.unique(np.concatenate([values[:both], values[size:]]))
                if len(a) == size and len(b) == other:
                    pairs.append((len(sets), len(sets) + 1))
                    sets += [a, b]
    common = np.sort(np.concatenate([x[: int(common_share * len(x))] for x in sets]))
    made = partenum.signatures(sets, common)
    assert len(pairs) > 500
    for i, j in pairs:
        assert np.intersect1d(made[i], made[j]).size or np.array_equal(sets[i], sets[j])
    # far fewer than the shingles where sets are large, and none for unlike sets
    assert all(len(m) <= 0.55 * len(x) + 3 for m, x in zip(made, sets) if len(x) >= 100)
    far = partenum.signatures([np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64)) for _ in range(20)], common)
    assert len(np.unique(np.concatenate(far))) > 0.98 * sum(map(len, far))


def test_every_pair_is_found(spark):
    check(spark.createDataFrame(list(edited().items()), "doc_id long, text string").repartition(3))


def test_buckets_cut_into_blocks(spark, monkeypatch):
    """Near copies share their signatures; with few pairs at first and small blocks, all ways to pair them are used."""
    monkeypatch.setattr(partenum, "NEXT", 1)
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 4)
    monkeypatch.setattr(partenum, "PAIR_BLOCK", 16)
    monkeypatch.setattr(partenum, "MAX_BROADCAST_ROWS", 3)
    rng, texts = random.Random(3), {}
    for _ in range(4):
        base = [f"w{rng.randrange(9000)}" for _ in range(60)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(60)] = f"w{rng.randrange(9000)}"
            texts[len(texts)] = " ".join(text)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    check(df)
    monkeypatch.setattr(partenum, "first_pairs", lambda rows: _members_alone(rows))
    check(df)


def _members_alone(rows):
    return rows.selectExpr("node as a", "cast(null as long) as b", "s", "n")


def test_documents(documents):
    check(documents)


def test_odd_rows(spark, odd_documents, no_documents):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.near_duplicates(odd_documents).collect()), key=str)
    assert len(got) == odd_documents.count()
    assert (8, 1, 8) in got and got.count((8, 1, 8)) == 2
    assert {(2, 0, 2), (3, 0, 3), (7, 0, 7), (6, 1, 6), (None, 1, None), (None, 0, None)} <= set(got)
    assert partenum.near_duplicates(no_documents).collect() == []
    same = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (9, "A b  c d e f")], "doc_id long, text string")
    assert {r.component_id for r in partenum.near_duplicates(same).collect()} == {4}
