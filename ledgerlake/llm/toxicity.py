"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import discard, filter_text, labelled_sample, materialise, mix, scan_text

#: Lengths of the character n-grams, and hash buckets.
NGRAMS = (3, 4, 5)
BUCKETS = 1 << 20
#: Labelled rows that the model is fitted on, at most.
SAMPLE = 8_000
#: A bucket needs so many labelled texts, and a log-count ratio so many standard errors from zero.
MIN_TEXTS, MIN_ERRORS = 3, 3.0
L2, STEPS = 1e-3, 400
#: Entries of the fitted matrix that one vectorised step takes.
ENTRIES = 1 << 18


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


_LETTER = None


def text_points(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of each text, each run of other characters as one blank, a blank first and last; and whose they are."""
    lowered = [f" {t.lower()} " for t in texts.to_pylist()]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered)), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & (letter[:-1] | (owner[1:] != owner[:-1]))
    keep[:1] = True
    points = np.where(letter, points, 32)
    return points[keep], owner[keep]


def buckets(texts: pa.LargeStringArray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) pairs without repeats. ``wanted`` maps a bucket to its feature; buckets with -1 are left out."""
    points, owner = text_points(texts)
    points = points.astype(np.uint64)
    pairs = []
    for n in NGRAMS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + points[j : count + j]
        b = (mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64)
        use = owner[:count] == owner[n - 1 :]
        if wanted is not None:
            b = wanted[b]
            use &= b >= 0
        pairs.append(owner[:count][use] * BUCKETS + b[use])
    found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return found // BUCKETS, found % BUCKETS


class Model:
    """``feature`` of each bucket (-1: none), a weight for each feature, a bias. Score: the logistic function of their sum."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, bias: float):
        self.feature, self.weight, self.bias = feature, weight, bias

    def score(self, texts: pa.LargeStringArray) -> np.ndarray:
        owner, feature = buckets(texts, self.feature)
        total = np.bincount(owner, self.weight[feature], len(texts)) if len(owner) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def fit_logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """L2 logistic regression on a sparse matrix by accelerated gradient steps; the bias is not penalised. ``values`` are those of the columns,
    ``rows`` ascend. Entries are taken in blocks, so only their two indices are held."""
    n = max(1, len(y))
    cuts = range(0, max(1, len(rows)), ENTRIES)

    def total(by: np.ndarray, weight, size: int) -> np.ndarray:
        out = np.zeros(size)
        for k in cuts:
            at = slice(k, k + ENTRIES)
            out += np.bincount(by[at], weight(at), size)
        return out

    norms = total(rows, lambda at: values[columns[at]] ** 2, n)
    step = 1 / (0.25 * (norms.max(initial=0) + 1) + L2)
    w, b = np.zeros(width), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        scaled = values * v
        p = 1 / (1 + np.exp(-np.clip(total(rows, lambda at: scaled[columns[at]], n) + c, -30, 30)))
        g = p - y
        new_w = v - step * (values * total(columns, lambda at: g[rows[at]], width) / n + L2 * v)
        new_b = c - step * g.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new_w + (t - 1) / t2 * (new_w - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new_w, new_b, t2
    return w, b


def log_count_ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of the smoothed shares of toxic and clean texts that have each bucket, and its standard error."""
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    return ratio, np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows. Without both classes the score is the share of toxic labels (0 without labels).

    Bucket counts are summed on the executors; the driver gets counts of BUCKETS buckets and the chosen features of the sample.
    """
    rows = materialise(labelled_sample(docs, labels, "toxic", usable, sample).select("text", "y").repartition(8), "toxic")

    def count(batches):
        totals = np.zeros((2, BUCKETS), np.int32)
        texts = np.zeros(2, np.int64)
        for batch in batches:
            y = np.asarray(batch.column(1)).astype(np.int64)
            for k in range(0, batch.num_rows, 64):
                part = batch.column(0).slice(k, 64).cast(pa.large_string())
                owner, bucket = buckets(part)
                np.add.at(totals, (y[k : k + 64][owner], bucket), 1)
            texts += np.bincount(y, minlength=2)
        for c in (0, 1):
            at = np.flatnonzero(totals[c])
            yield pa.RecordBatch.from_pydict({"y": [c], "n": [int(texts[c])], "at": [at.astype(np.int32).tobytes()], "count": [totals[c][at].tobytes()]})

    totals, n = np.zeros((2, BUCKETS)), np.zeros(2, np.int64)
    for r in rows.mapInArrow(count, "y long, n long, at binary, count binary").toLocalIterator():
        totals[r.y][np.frombuffer(r.at, np.int32)] += np.frombuffer(r["count"], np.int32)
        n[r.y] += r.n
    none = np.full(BUCKETS, -1, np.int32)
    if not n.all():
        share = n[1] / max(1, n.sum())
        return Model(none, np.zeros(1), float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    ratio, error = log_count_ratios(totals[1], totals[0], n[1], n[0])
    chosen = np.flatnonzero((totals.sum(0) >= MIN_TEXTS) & (np.abs(ratio) >= MIN_ERRORS * error))
    feature = none.copy()
    feature[chosen] = np.arange(len(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(feature)

    def choose(texts):
        owner, found = buckets(texts, shared.value)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        return {"features": pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(found.astype(np.int32)))}

    got = scan_text(rows, ["y"], "text", choose, "features array<int>").toArrow()
    discard(rows)
    lists = got.column("features").combine_chunks()
    row = np.repeat(np.arange(len(got), dtype=np.int32), np.asarray(lists.value_lengths()))
    w, b = fit_logistic(row, np.asarray(lists.flatten()), ratio[chosen], np.asarray(got.column("y")).astype(float), len(chosen))
    return Model(feature, np.append(w * ratio[chosen], 0.0), b)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text: 0 to 1, higher is likelier toxic. Null texts score as empty ones: the bias alone.

    Repeated rows give repeated scores, null ids stay, an empty table gives an empty result, and other columns do not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scan_text(docs, [id_col], text_col, lambda texts: {"score": shared.value.score(texts)}, "score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score under ``threshold``, with all columns. Null texts score as empty ones; repeated rows stay or go
    together; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_text(docs, text_col, lambda texts: shared.value.score(texts) < threshold)
