import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, token_counts

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
COUNTER = public_tokenizers.path("byte_bpe_50k.json")


def digest(ids):
    return hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def expected(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), digest(ids), hashlib.sha256((text or "").encode()).hexdigest()


def check(df):
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert found == {(r.doc_id, *expected(r.text)) for r in df.select("doc_id", "text").collect()}


def test_round_trip_of_real_documents(documents):
    check(documents)


def test_round_trip_of_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    check(no_documents)
    assert bpe.round_trip_digests(odd_documents, RANKS, public_tokenizers.PATTERN).count() == odd_documents.count()


PAIRS = bpe.Pairs.of_ranks(RANKS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abeinrst éß漢😀\x00", min_size=1, max_size=60), min_size=1, max_size=8))
def test_tree_merges_like_the_library(texts):
    ids = bpe.PieceIds(RANKS)
    import regex

    packed = ids.encode([regex.findall(public_tokenizers.PATTERN, t) for t in texts])
    assert [list(memoryview(p).cast("I")) for p in packed] == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_pre_tokens_take_the_same_ids():
    for piece in (b"ab" * 400, b"a" * 999, bytes(range(97, 123)) * 30):
        assert PAIRS.merge([piece])[0].tolist() == LIBRARY.encode_ordinary(piece.decode())


def test_counts_match_the_library(spark, documents, odd_documents, no_documents):
    vocabulary, library = token_counts.Vocabulary(COUNTER), Tokenizer.from_file(COUNTER)
    for df in (documents, odd_documents, no_documents):
        found = sorted(map(tuple, token_counts.count_tokens(df, vocabulary, 512).collect()), key=str)
        rows = df.select("doc_id", "text").collect()
        n = [len(e.ids) for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
        assert found == sorted(((r.doc_id, len((r.text or "").encode()), k, k > 512) for r, k in zip(rows, n)), key=str)


def test_proven_tokens_encode_alone():
    vocabulary, library = token_counts.Vocabulary(COUNTER), Tokenizer.from_file(COUNTER)
    some = sorted(vocabulary.whole)[::50]
    assert len(vocabulary.whole) > 45_000
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in some if t.strip() and len(token_counts.regex.findall(token_counts.BYTE_LEVEL, t)) == 1)
