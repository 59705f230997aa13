import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from ledgerlake.llm import bpe, quality_knn, toxicity
from ledgerlake.llm.common import id_crc
from tests.llm.test_duplicates import brute_hits, windows_of
from tests.llm.test_jaccard import brute_least

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_versions(spark, documents, labels, benchmark):
    docs, kept = documents, {r.doc_id: r.text for r in documents.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns
        if name in ("toxicity", "quality"):
            module, label, usable, good = (toxicity, "toxic", id_crc("doc_id") % 5 != 0, lambda s: s < 0.5) if name == "toxicity" else (quality_knn, "quality", id_crc("doc_id") % 3 != 1, lambda s: s >= 0.5)
            scores = {r.doc_id: r.score for r in module.score_texts(docs, module.fit(docs, labels, usable)).collect()}
            kept = {k: t for k, t in kept.items() if good(scores[k])}
        elif name == "near_duplicates":
            kept = {k: kept[k] for k in set(brute_least(kept).values())}
        else:
            windows = windows_of(benchmark)
            kept = {k: t for k, t in kept.items() if not brute_hits(t, windows)[1]}
        assert {r.doc_id: r.text for r in out.collect()} == kept
        docs = spark.createDataFrame(out.collect(), documents.schema)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()}
    assert last == {k: (len(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for k, t in kept.items()}


def test_run_gives_what_the_stages_give(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 200


def test_stages_take_odd_and_empty_documents(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()
