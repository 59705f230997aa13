import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import quality_knn, queries, toxicity
from ledgerlake.llm.common import id_crc, labelled_sample, mix

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    found = queries.QUERIES[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return found, found.join(labels, "doc_id").where("held_out").selectExpr("score", "predicted", f"{label} as y").toPandas()


def auc(x):
    p = x.y.sum()
    return (x.score.rank()[x.y == 1].sum() - p * (p + 1) / 2) / (p * (len(x) - p))


@pytest.mark.parametrize("name, label", [("op1_nb_ngrams", "toxic"), ("op6_knn_votes", "quality")])
def test_held_out_accuracy(spark, name, label):
    found, x = held_out(spark, name, label)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert auc(x) > 0.9 and (x.predicted == x.y).mean() > 0.9
    assert found.where("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").count() == 0


@pytest.mark.parametrize("module, drop", [(toxicity, "drop_toxic"), (quality_knn, "drop_poor")])
def test_odd_rows_and_empty_tables(spark, documents, labels, odd_documents, no_documents, module, drop):
    usable = id_crc("doc_id") % 5 != 0
    odd_labels = labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 0, 0), (8, 7, 7), (777777, 1, 1)], labels.schema))
    for model in (module.fit(documents, odd_labels, usable), module.fit(no_documents, labels, usable), module.fit(documents, labels.where("false"), usable)):
        scored = module.score_texts(odd_documents, model)
        assert scored.count() == odd_documents.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
        same = {r.score for r in scored.where("doc_id = 8").collect()}
        assert len(same) == 1
        assert module.score_texts(no_documents, model).count() == 0
        assert getattr(module, drop)(odd_documents, model).columns == odd_documents.columns


def test_log_count_ratio_weights_the_planted_word(spark):
    rows = [(i, f"some harmless words number {i % 7} " + ("zorgbad" if i % 4 == 0 else "flowers"), int(i % 4 == 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.selectExpr("doc_id", "1 as quality", "toxic"), id_crc("doc_id") % 5 != 0)
    scores = model.score(pa.array(["words zorgbad words", "words flowers words", ""], pa.large_string()))
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5


def test_the_sample_is_bounded_and_deterministic(documents, labels):
    a, b = (quality_knn.fit(documents, labels, id_crc("doc_id") % 3 != 1, sample=20) for _ in range(2))
    assert len(a.labels) == 20 and np.array_equal(a.labels, b.labels)


def test_voting_is_exact(documents, labels):
    model = quality_knn.fit(documents, labels, id_crc("doc_id") % 3 != 1)
    texts = pa.array([r.text for r in documents.limit(40).collect()], pa.large_string())
    cosine = model.embed(quality_knn.term_counts(texts)) @ model.vectors.T
    k = min(quality_knn.NEIGHBOURS, len(model.labels))
    for row, got in zip(cosine, model.score(texts)):
        near = np.argsort(-row, kind="stable")[:k]
        edge = row[near[-1]]
        if np.sum(np.abs(row - edge) < 1e-6) > 1:
            continue  # ties at the edge may fall either way
        v = np.maximum(row[near], 0) ** 4
        assert got == pytest.approx((v * model.labels[near]).sum() / v.sum(), abs=1e-5)


def brute_buckets(text):
    """The hash buckets of a text's character n-grams, one by one."""
    out, clean = set(), ""
    for c in f" {(text or '').lower()} ":
        clean += c if c.isalpha() else "" if clean.endswith(" ") else " "
    for n in toxicity.NGRAMS:
        for i in range(len(clean) - n + 1):
            h = n
            for c in clean[i : i + n]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            out.add(int(mix(np.array([h], np.uint64))[0]) % toxicity.BUCKETS)
    return out


def test_toxicity_matches_plain_counting(documents, labels):
    """Counts, ratios and chosen features of the fit, the fit's stationary point, and every score, from plain sets of n-grams."""
    model = toxicity.fit(documents, labels, id_crc("doc_id") % 5 != 0)
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = [(brute_buckets(texts[r.doc_id]), r.toxic) for r in labels.where(id_crc("doc_id") % 5 != 0).collect() if texts.get(r.doc_id) is not None and r.toxic in (0, 1)]
    n = [sum(1 for _, y in rows if y == c) for c in (0, 1)]
    count = [Counter(b for s, y in rows if y == c for b in s) for c in (0, 1)]
    ratio = {}
    for b in set(count[0]) | set(count[1]):
        r = math.log((count[1][b] + 1) / (n[1] + 2)) - math.log((count[0][b] + 1) / (n[0] + 2))
        if count[0][b] + count[1][b] >= toxicity.MIN_TEXTS and abs(r) >= toxicity.MIN_ERRORS * math.sqrt(1 / (count[1][b] + 1) + 1 / (count[0][b] + 1)):
            ratio[b] = r
    assert set(np.flatnonzero(model.feature >= 0).tolist()) == set(ratio)
    total = lambda s: model.bias + sum(model.weight[model.feature[b]] for b in s if b in ratio)
    error = [1 / (1 + math.exp(-total(s))) - y for s, y in rows]
    slope = {b: ratio[b] * sum(e for (s, _), e in zip(rows, error) if b in s) / len(rows) + toxicity.L2 * model.weight[model.feature[b]] / ratio[b] for b in ratio}
    assert abs(sum(error) / len(rows)) < 1e-3 and max(map(abs, slope.values()), default=0) < 1e-2
    found = {r.doc_id: r.score for r in toxicity.score_texts(documents, model).collect()}
    for k, t in texts.items():
        assert abs(found[k] - 1 / (1 + math.exp(-max(-30, min(30, total(brute_buckets(t))))))) < 1e-9


def test_ties_of_neighbours_go_to_smaller_ids(monkeypatch):
    """Six labelled texts at one similarity: the three of the smallest ids vote, whatever the block."""
    monkeypatch.setattr(quality_knn, "NEIGHBOURS", 3)
    texts = pa.array(["Alpha beta, gamma 12 delta!", "Alpha beta, gamma 99 omega!"] * 300, pa.large_string())
    counts = quality_knn.term_counts(texts.slice(0, 1))
    weight, projection = quality_knn.latent_space(np.vstack([counts, quality_knn.term_counts(pa.array(["x y z", "1 2 3"], pa.large_string()))]), 2)
    model = quality_knn.Model(weight, projection, np.zeros((0, 2)), np.array([1.0, 0, 0, 1, 1, 1]))
    model.vectors = np.repeat(model.embed(counts), 6, axis=0)
    assert np.allclose(model.score(texts), 1 / 3) and len(set(model.score(texts).tolist())) == 1


def test_repeated_ids_do_not_grow_the_sample(spark, documents, labels):
    some = documents.where("doc_id < 60").select("doc_id", "text")
    twice = some.union(some.selectExpr("doc_id", "concat(text, ' again')")).union(some)
    assert labelled_sample(twice, labels, "toxic", F.lit(True), 40).count() <= 40
