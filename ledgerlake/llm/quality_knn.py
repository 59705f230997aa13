"""Quality: nearest-neighbour voting among labelled texts in a latent semantic space of word shapes and repetition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import LOWER, NOT_SPACE, discard, filter_text, find_words, labelled_sample, materialise, mix, scan_text, text_bytes, word_hashes

#: Hashed terms, latent dimensions, neighbours that vote, labelled vectors that are broadcast at most (1 MB or so).
TERMS, RANK, NEIGHBOURS, SAMPLE = 2048, 24, 25, 4_000
#: Texts that one block of cosine products holds, and steps of a similarity (beyond the rounding of a product).
BLOCK, STEPS = 256, 10_000

#: The class of each byte in a word's shape: A upper, a lower case or beyond ASCII, 0 digit; others stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[48:58], SHAPE[128:] = 65, 97, 48, 97


def shape_words(data, starts, ends) -> np.ndarray:
    """A hash of each word's shape, in which a run of one class counts once: ``Don't!!`` becomes ``Aa'a!``."""
    shape = SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return word_hashes(shape[keep], place[starts], place[ends])


def term_counts(texts: pa.LargeStringArray) -> np.ndarray:
    """Square roots of the shares of each hashed term in each text (rows). Terms are word shapes, pairs of neighbouring shapes, and
    repetition: whether a word equals one of the three before it."""
    data, offsets = text_bytes(texts)
    starts, ends, bounds = find_words(data, offsets, NOT_SPACE)
    sizes = np.diff(bounds)
    out = np.zeros((len(texts), TERMS), np.float32)
    if not len(starts):
        return out
    owner = np.repeat(np.arange(len(texts)), sizes)
    shapes = shape_words(data, starts, ends)
    words = word_hashes(LOWER[data], starts, ends)
    pair = owner[1:] == owner[:-1]
    terms = [(owner, shapes), (owner[1:][pair], mix(shapes[1:] * np.uint64(3) + shapes[:-1])[pair])]
    for back in (1, 2, 3):
        near = owner[back:] == owner[:-back]
        same = (words[back:] == words[:-back]).astype(np.uint64)
        terms.append((owner[back:][near], mix(same + np.uint64(10 * back))[near]))
    flat = np.concatenate([o * TERMS + (t & np.uint64(TERMS - 1)).astype(np.int64) for o, t in terms])
    counts = np.bincount(flat, minlength=len(texts) * TERMS).reshape(len(texts), TERMS)
    np.sqrt(counts / np.maximum(1, sizes)[:, None], out=out, casting="unsafe")
    return out


class Model:
    """Term weights, the projection to the latent space, unit vectors of the labelled texts, and their labels."""

    def __init__(self, weight, projection, vectors, labels):
        self.weight, self.projection, self.vectors, self.labels = weight, projection, vectors, labels

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit((counts * self.weight) @ self.projection)

    def score(self, texts: pa.LargeStringArray) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest labelled texts; texts without words get the overall share.

        Similarities count in steps of 1 / STEPS; of equal ones the labelled text of the smaller id is nearer.
        """
        prior = float(self.labels.mean()) if len(self.labels) else 1.0
        out = np.full(len(texts), prior)
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts) if k else 0, BLOCK):
            cosine = self.embed(term_counts(texts.slice(at, BLOCK))) @ self.vectors.T
            steps, n = np.rint(cosine * STEPS).astype(np.int64), cosine.shape[1]
            near = np.argpartition(steps * n - np.arange(n), n - k, axis=1)[:, n - k :]
            near.sort(axis=1)
            votes = np.maximum(np.take_along_axis(steps, near, 1) / STEPS, 0) ** 4
            total = votes.sum(1)
            share = (votes * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            out[at : at + BLOCK] = np.clip(np.where(total > 1e-9, share, prior), 0, 1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def latent_space(counts: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Inverse-document-frequency weights of the terms and the leading right singular vectors of the weighted matrix."""
    weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    square = np.zeros((counts.shape[1],) * 2)
    for k in range(0, len(counts), BLOCK):
        x = (counts[k : k + BLOCK] * weight).astype(np.float64)
        square += x.T @ x
    values, vectors = np.linalg.eigh(square)
    return weight, vectors[:, ::-1][:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """The space and the voters, from at most ``sample`` labelled texts. Without labels every score is 1."""
    rows = materialise(labelled_sample(docs, labels, "quality", usable, sample).select("doc_id", "text", "y").repartition(8, "doc_id"), "quality")

    def make(texts):
        return {"counts": pa.array([x.tobytes() for k in range(0, len(texts), BLOCK) for x in term_counts(texts.slice(k, BLOCK)).astype(np.float16)], pa.binary())}

    got = scan_text(rows, ["doc_id", "y"], "text", make, "counts binary").toArrow().sort_by("doc_id")
    discard(rows)
    if not len(got):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    counts = np.frombuffer(b"".join(got.column("counts").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    weight, projection = latent_space(counts)
    model = Model(weight, projection, np.zeros((0, RANK)), np.asarray(got.column("y")).astype(np.float64))
    model.vectors = model.embed(counts)
    return model


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text: 0 to 1, higher is likelier good. Null texts score as empty ones: the overall share.

    Repeated rows give repeated scores, null ids stay, an empty table gives an empty result, and other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scan_text(docs, [id_col], text_col, lambda texts: {"score": shared.value.score(texts)}, "score double")


def drop_poor(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, with all columns. Null texts score as empty ones; repeated rows stay or go
    together; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_text(docs, text_col, lambda texts: shared.value.score(texts) >= threshold)
