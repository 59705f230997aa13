"""Fill-in-middle: cuts by the sparse index, outputs and restored texts, odd rows."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlake.llm import fim


def brute(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = text[:low], text[low:high], text[high:]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{c}<P>{a}<M>{b}"
    else:
        form, out = "psm", f"<P>{a}<S>{c}<M>{b}"
    plain = form == "plain"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, n, form, None if plain else low, None if plain else high - low, sha(out), sha(text)


def check(df):
    want = sorted((brute(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
    found = fim.round_trip(df)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == want


def test_documents(documents):
    check(documents)


def test_odd_rows(odd_documents, no_documents):
    check(odd_documents)
    check(no_documents)


def test_marks_inside_texts_and_near_marks(spark):
    texts = ["a <P> b", "<S>", "x<M", "<P" * 50, "<<S>>" * 9, "<" * 100, ">M<S" * 40, "é<P😀S>" * 30]
    rows = [(i, texts[i % len(texts)]) for i in range(200)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60), st.integers(1, 7))
def test_checkpoints_find_every_code_point(text, step):
    index = fim.Checkpoints(np.frombuffer(text.encode(), np.uint8), step)
    assert index.n == len(text)
    assert [index.byte_of(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert len(index.points) == -(-len(text.encode()) // step) + 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<PSM>a", max_size=30), st.data())
def test_outputs_give_the_text_back(text, data):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    low = data.draw(st.integers(0, len(text)))
    high = data.draw(st.integers(low, len(text)))
    for form in ("psm", "spm", "plain"):
        assert fim.restore(fim.arrange(text.encode(), low, high, form), form) == text.encode()
