"""Fill-in-middle: documents cut at two code points into prefix, middle and suffix, and put in another order between marks.

Cuts are in code points, texts in UTF-8. A sparse checkpoint index of a text holds, for every STEP bytes, how many code points start
before that byte; it is made while the code points are counted. A cut is found by binary search among the checkpoints and a scan of
the STEP bytes from there on, so no text is decoded and no offset is kept for each of its code points.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scan_text, text_bytes

#: Bytes from one checkpoint to the next.
STEP = 512
#: The marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts, how many stay plain, and how many of the others have the suffix first.
PLAIN, SPM = 10, 20


class Checkpoints:
    """Checkpoints of one UTF-8 text: ``points[i]`` code points start before byte ``i * step``; ``n`` do in all."""

    def __init__(self, data: np.ndarray, step: int = STEP):
        self.lead, self.step = (data & 0xC0) != 0x80, step
        counts = np.add.reduceat(self.lead, np.arange(0, len(data), step), dtype=np.int64) if len(data) else np.zeros(0, np.int64)
        self.points = np.concatenate([[0], np.cumsum(counts)])
        self.n = int(self.points[-1])

    def byte_of(self, point: int) -> int:
        """The byte at which code point ``point`` starts; the text's end for ``n``."""
        if point >= self.n:
            return len(self.lead)
        block = int(np.searchsorted(self.points, point, "right")) - 1
        at = block * self.step
        return at + int(np.flatnonzero(self.lead[at : at + self.step])[point - self.points[block]])


def arrange(text: bytes, low: int, high: int, form: str) -> bytes:
    """The text with its middle ``text[low:high]`` last; a plain text as it is."""
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    if form == "spm":
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return text


def restore(output: bytes, form: str) -> bytes:
    """The text of an ``arrange``d output. The first mark of each kind is the true one: texts that hold a mark stay plain, and no mark
    begins inside another, so none can arise where a part and a mark meet."""
    if form == "plain":
        return output
    inner, last = (SUFFIX, PREFIX) if form == "psm" else (PREFIX, SUFFIX)
    second = output.index(inner)
    third = output.index(MIDDLE, second)
    one, two, middle = output[len(last) : second], output[second + len(inner) : third], output[third + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def draws(id_col: str, seed: int = 1) -> list[Column]:
    """Four 32-bit numbers of an id: the first groups of eight digits of the sha256 of ``seed:id``. A null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text; ``output`` is binary UTF-8.

    Form is plain for empty texts, texts with a mark inside and ``plain`` of a hundred ids, else spm for ``spm`` of a hundred, else
    psm. Null texts are empty ones; a null id draws as an empty id. Each row is treated alone, so repeated rows give repeated
    results and an empty table an empty one. Other columns of any name are left out. Memory is that of a few copies of a text.
    """
    names = [f"h{i}" for i in range(1, 5)]
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(c.alias(n) for c, n in zip(draws(id_col, seed), names, strict=True)))

    def make(texts: pa.LargeStringArray, h1, h2, h3, h4) -> dict[str, pa.Array]:
        data, offsets = text_bytes(texts)
        n, forms, first, between, outputs = [], [], [], [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            index, text = Checkpoints(data[a:b]), data[a:b].tobytes()
            as_is = not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3[i] % 100 >= 100 - plain
            form = "plain" if as_is else "spm" if h4[i] % 100 < spm else "psm"
            low, high = (None, None) if as_is else sorted((int(h1[i]) % (index.n + 1), int(h2[i]) % (index.n + 1)))
            outputs.append(text if as_is else arrange(text, index.byte_of(low), index.byte_of(high), form))
            n.append(index.n)
            forms.append(form)
            first.append(low)
            between.append(None if as_is else high - low)
        return {"n": pa.array(n, pa.int64()), "form": pa.array(forms, pa.string()), "prefix_chars": pa.array(first, pa.int64()), "middle_chars": pa.array(between, pa.int64()), "output": pa.array(outputs, pa.binary())}

    made = scan_text(drawn, ["id"], "text", make, "n long, form string, prefix_chars long, middle_chars long, output binary", beside=names)
    return made.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``transform`` with the digests of outputs and of the texts rebuilt from output and form alone, in place of the outputs."""
    made = transform(docs, id_col, text_col, **options)
    kept = [c for c in made.columns if c != "output"]

    def digests(batches):
        for batch in batches:
            outputs, forms = batch.column("output"), batch.column("form")
            shas, back = [], []
            for x, form in zip(outputs, forms, strict=True):
                x = x.as_py()
                shas.append(hashlib.sha256(x).hexdigest())
                back.append(hashlib.sha256(restore(x, form.as_py())).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(shas, pa.string()), pa.array(back, pa.string())], [*kept, "output_sha256", "restored_sha256"])

    kinds = ", ".join(f"`{c}` {made.schema[c].dataType.simpleString()}" for c in kept)
    return made.mapInArrow(digests, f"{kinds}, output_sha256 string, restored_sha256 string")
