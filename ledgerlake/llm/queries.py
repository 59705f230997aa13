"""The registered queries of this subpackage: thin calls of the operators with production parameters on whole tables."""

from __future__ import annotations

import public_tokenizers

from . import bpe, decontam, filter_audit, fim, html_text, oracles, partenum, quality_knn, quality_rules, simhash, token_counts, toxicity, url_filter, warc
from .common import id_crc, table, with_holdout


def op1_nb_ngrams(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, id_crc("doc_id") % 5 != 0)
    return with_holdout(toxicity.score_texts(docs, model), id_crc("doc_id") % 5 == 0)


#: Rules on hosts and paths, and domains blocked where no rule fits (a stated list, as a parameter).
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
BLOCKED_DOMAINS = [f"{name}.example.{end}" for name in ("adult-x", "casino-win", "spam-farm") for end in ("com", "net", "org")]


def op2_divergence_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op3_bloom_cascade(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES, BLOCKED_DOMAINS)


def op4_bpe_segment_tree(spark, sf_dir):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op5_token_counts(spark, sf_dir):
    vocabulary = token_counts.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary, limit=512)


def op6_knn_votes(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_knn.fit(docs, labels, id_crc("doc_id") % 3 != 1)
    return with_holdout(quality_knn.score_texts(docs, model), id_crc("doc_id") % 3 == 1)


def op7_winnowing(spark, sf_dir):
    return decontam.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash_components(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fingerprint").alias("fingerprint"), "component_id")


def op9_host_suffix_array(spark, sf_dir):
    return html_text.extract_main_text(table(spark, sf_dir, "pages"))


def op10_warc_zstd(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_checkpoint_fim(spark, sf_dir):
    return fim.round_trip(table(spark, sf_dir, "documents"))


def op12_partenum(spark, sf_dir):
    return partenum.near_duplicates(table(spark, sf_dir, "documents")).drop("node")


def op13_cube_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_nb_ngrams, op2_divergence_rules, op3_bloom_cascade, op4_bpe_segment_tree, op5_token_counts, op6_knn_votes, op7_winnowing, op8_simhash_components, op9_host_suffix_array, op10_warc_zstd, op11_checkpoint_fim, op12_partenum, op13_cube_audit)}

ORACLES: dict[str, str] = {
    "op2_divergence_rules": oracles.rules(),
    "op3_bloom_cascade": oracles.urls(RULES, BLOCKED_DOMAINS),
    "op7_winnowing": oracles.PASSAGES,
    "op10_warc_zstd": oracles.ARCHIVES,
    "op11_checkpoint_fim": oracles.MIDDLES,
    "op13_cube_audit": oracles.AUDIT,
}
