"""Benchmark decontamination by winnowing: which words of a document stand inside a passage of the benchmark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORDISH, find_words, gram_hashes, materialise, mix, new_key, small_batches, slices, text_bytes, word_hashes

#: Words in a window; every shared span of so many words is found.
SPAN = 10
#: Words in a k-gram. A fingerprint is the least of the SPAN - K + 1 k-gram hashes of a window.
K = 5
#: Bits (a power of two) of the map of benchmark fingerprints that all executors get, at most: 32 MB. A fuller map lets more document
#: windows through to the join, which decides alone.
MAX_BITS = 28
#: Fingerprints in one batch that goes to the join, and contaminated texts whose keys are sent to all executors.
BATCH_WINDOWS, MAX_BROADCAST_ROWS = 20_000, 500_000
#: Different surroundings of a fingerprint in the benchmark over which it is joined with whole windows, not alone.
HOT_PLACES = 64
#: Words on either side of a k-gram that a window around it can reach.
REACH = SPAN - K


def starts_of(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether n words of the same text follow from each position on."""
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes) - np.arange(bounds[-1])
    return left[: max(0, total)] >= n


def selected(hashes: np.ndarray, bounds: np.ndarray, n: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Where the chosen k-grams start, and their fingerprints: the least of each window of n words, the last of equal ones, once.

    Equal windows choose the same place in them, so every shared span of n words shares a chosen k-gram, whatever stands around it.
    """
    grams = gram_hashes(hashes, k)
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, place = grams[:count].copy(), np.arange(count)
    for j in range(1, n - k + 1):
        lower = grams[j : count + j] <= least
        place[lower] = np.flatnonzero(lower) + j
        np.minimum(least, grams[j : count + j], out=least)
    at = np.unique(place[starts_of(bounds, n, count)])
    return at, mix(grams[at] + np.uint64(n))


def normal_words(texts: pa.LargeStringArray):
    """Bytes with A-Z lowered, word starts and ends, bounds of each text, word hashes."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, bounds = find_words(data, offsets, WORDISH)
    return data, starts, ends, bounds, word_hashes(data, starts, ends)


def words_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: int, n: int) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist()))


def short_windows(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of n words, under SPAN, start, and the fingerprints of the whole windows."""
    prints = gram_hashes(hashes, n)
    at = np.flatnonzero(starts_of(bounds, n, len(prints)))
    return at, mix(prints[at] + np.uint64(n))


#: What a fingerprint goes to the join with: for a k-gram its words, those before it (nearest first) and after it; for a short window its words.
CONTEXT = "left array<string>, gram array<string>, right array<string>, window string"
_TEXTS = pa.list_(pa.string())


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, at: np.ndarray, owner: np.ndarray, n: int) -> list[pa.Array]:
    """The columns of CONTEXT of the places ``at`` in the texts ``owner``."""
    none = pa.nulls(len(at), _TEXTS)
    if n < SPAN:
        return [none, none, none, pa.array([words_at(data, starts, ends, x, n).decode() for x in at.tolist()], pa.string())]
    word = lambda i: data[starts[i] : ends[i]].tobytes().decode()
    first, last = bounds[owner].tolist(), bounds[owner + 1].tolist()
    left = [[word(i) for i in range(p - 1, max(a, p - REACH) - 1, -1)] for p, a in zip(at.tolist(), first, strict=True)]
    gram = [[word(i) for i in range(p, p + K)] for p in at.tolist()]
    right = [[word(i) for i in range(p + K, min(z, p + K + REACH))] for p, z in zip(at.tolist(), last, strict=True)]
    return [*(pa.array(x, _TEXTS) for x in (left, gram, right)), pa.nulls(len(at), pa.string())]


def benchmark_prints(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(print, n, CONTEXT, item) of the chosen k-grams of the items (n: SPAN), and of items of fewer words as a whole (n: their words)."""

    def make(batches):
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                data, starts, ends, bounds, hashes = normal_words(texts)
                sizes = np.diff(bounds)
                for n in sorted({min(SPAN, int(x)) for x in sizes if x}):
                    at, prints = selected(hashes, bounds) if n == SPAN else short_windows(hashes, bounds, n)
                    owner = np.searchsorted(bounds, at, "right") - 1
                    own = np.flatnonzero((sizes[owner] == n) | (n == SPAN))
                    for k in range(0, len(own), BATCH_WINDOWS):
                        i = own[k : k + BATCH_WINDOWS]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(prints[i].view(np.int64)), pa.array(np.full(len(i), n, np.int32)), *contexts(data, starts, ends, bounds, at[i], owner[i], n), part.column("_item").take(pa.array(owner[i]))],
                            ["print", "n", "left", "gram", "right", "window", "item"],
                        )

    rows = benchmark.select(F.col(id_col).cast("string").alias("_item"), F.col(text_col).alias("_text"))
    return small_batches(rows).mapInArrow(make, f"print long, n int, {CONTEXT}, item string").distinct()


class PrintMap:
    """A bit for each fingerprint of the benchmark, and the window lengths that occur. It has every fingerprint, and maybe others."""

    def __init__(self, windows: DataFrame):
        prints = windows.select("print").distinct()
        self.power = int(np.clip(np.ceil(np.log2(64 * max(1, prints.count()))), 6, MAX_BITS))
        place = F.shiftrightunsigned("print", 64 - self.power)
        rows = prints.groupBy(F.shiftright(place, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(print, {64 - self.power}) % 64 as int))")).alias("v")).toArrow()
        self.words = np.zeros(1 << (self.power - 6), np.uint64)
        self.words[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
        self.lengths = sorted(r.n for r in windows.select("n").distinct().collect())

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        place = prints >> np.uint64(64 - self.power)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def candidate_prints(docs: DataFrame, prints: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """A row of each document: ``keep``, _key (of texts with candidates, else null), n_words. And a row of each candidate: _key, print,
    n, place, CONTEXT. Documents are winnowed like the items; candidates are the chosen fingerprints that the map of the benchmark has.
    Equal texts of a task give them once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PrintMap(prints))
    rows = docs.select(*keep, F.col(text_col).alias("_text"), F.md5(text_col).alias("_key"))
    names = [*keep, "_key", "n_words", "print", "n", "place", "left", "gram", "right", "window"]

    def make(batches):
        known, seen = shared.value, set()
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                data, starts, ends, bounds, hashes = normal_words(texts)
                keys, fits = part.column("_key").to_pylist(), np.zeros(len(texts), bool)
                new = np.array([k not in seen for k in keys], bool)
                nulls = [pa.nulls(0, part.schema.field(c).type) for c in keep]
                for n in known.lengths:
                    at, prints_ = selected(hashes, bounds) if n == SPAN else short_windows(hashes, bounds, n)
                    hit = known(prints_)
                    at, prints_ = at[hit], prints_[hit]
                    owner = np.searchsorted(bounds, at, "right") - 1
                    fits[owner] = True
                    at, prints_, owner = at[new[owner]], prints_[new[owner]], owner[new[owner]]
                    for k in range(0, len(at), BATCH_WINDOWS):
                        a, p, o = (x[k : k + BATCH_WINDOWS] for x in (at, prints_, owner))
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.nulls(len(a), x.type) for x in nulls), part.column("_key").take(pa.array(o)), pa.nulls(len(a), pa.int64()), pa.array(p.view(np.int64)), pa.array(np.full(len(a), n, np.int32)),
                             pa.array(a - bounds[o]), *contexts(data, starts, ends, bounds, a, o, n)], names,
                        )
                seen.update(k for k, f in zip(keys, fits.tolist()) if f)
                if keep:
                    none = [pa.nulls(len(texts), t) for t in (pa.int64(), pa.int32(), pa.int64(), _TEXTS, _TEXTS, _TEXTS, pa.string())]
                    key = pa.array([k if f else None for k, f in zip(keys, fits.tolist())], pa.string())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), key, pa.array(np.diff(bounds)), *none], names)

    kept = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return small_batches(rows).mapInArrow(make, kept + f"_key string, n_words long, print long, n int, place long, {CONTEXT}")


def agreeing(a: str, b: str) -> Column:
    """How many words the arrays have in common from their starts on, REACH at most."""
    out, run = F.lit(0), F.lit(True)
    for i in range(REACH):
        run = run & F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False))
        out = out + run.cast("int")
    return out


def around(rows: DataFrame, *keep: str) -> DataFrame:
    """Each window of SPAN words around the k-grams of ``rows``: (print, window, keep), and the first word's distance before the k-gram as ``off``."""
    words = F.concat(F.reverse("left"), "gram", "right")
    starts = F.when(F.size(words) >= SPAN, F.sequence(F.lit(1), F.size(words) - SPAN + 1)).otherwise(F.array().cast("array<int>"))
    each = rows.select("print", *keep, F.size("left").alias("_l"), words.alias("_w"), F.explode(starts).alias("_s"))
    return each.select("print", F.concat_ws(" ", F.slice("_w", F.col("_s"), SPAN)).alias("window"), *keep, (F.col("_l") - F.col("_s") + 1).alias("off"))


def join_prints(found: DataFrame, prints: DataFrame) -> DataFrame:
    """(_key, place, n, item): words of documents, n from ``place`` on, that stand in the item too. Each is SPAN words long at least, or a whole short item.

    Fingerprints that both sides chose meet, and each meeting is extended to the left and right as far as the words agree. What stands
    around a fingerprint in the benchmark may be very various, a common phrase: such fingerprints meet with the whole windows around
    them as key instead, so no key is a product of many and many. Equal texts of several tasks are dropped first.
    """
    once = found.where("print is not null").select("_key", "print", "n", "place", "left", "gram", "right", "window").distinct()
    short = once.where(f"n < {SPAN}").select("_key", "print", "n", "place", "window").join(prints.where(f"n < {SPAN}").select("print", "n", "window", "item"), ["print", "n", "window"]).select("_key", "place", "n", "item")
    whole, mine = prints.where(f"n = {SPAN}"), once.where(f"n = {SPAN}").select("_key", "print", "place", "left", "gram", "right")
    many = materialise(whole.select("print", "left", "gram", "right").distinct().groupBy("print").count().where(F.col("count") > HOT_PLACES).select("print"), "hot-prints")
    few = whole.join(many, "print", "left_anti").select("print", F.col("left").alias("b_left"), F.col("gram").alias("b_gram"), F.col("right").alias("b_right"), "item")
    met = mine.join(few, "print").where("gram = b_gram").select("_key", "place", "item", agreeing("left", "b_left").alias("l"), agreeing("right", "b_right").alias("r"))
    grown = met.where(F.col("l") + F.col("r") >= REACH).select("_key", (F.col("place") - F.col("l")).alias("place"), (K + F.col("l") + F.col("r")).alias("n"), "item")
    if many.isEmpty():
        return short.union(grown)
    hot = around(mine.join(many, "print"), "_key", "place").join(around(whole.join(many, "print"), "item").drop("off").distinct(), ["print", "window"])
    return short.union(grown).union(hot.select("_key", (F.col("place") - F.col("off")).alias("place"), F.lit(SPAN).alias("n"), "item"))


def spans_of(places: DataFrame) -> DataFrame:
    """(_key, n_hit, spans) from (_key, at: array of places, n: array of lengths): hits extended to whole shared spans."""
    span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def merge(batches):
        for batch in batches:
            spans, hits = [], []
            for at, n in zip(batch.column("at"), batch.column("n"), strict=True):
                a, b = at.values.to_numpy(), at.values.to_numpy() + n.values.to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                begin, end = a[first], b[np.append(first[1:], len(a)) - 1]
                hits.append(int((end - begin).sum()))
                spans.append([{"from": x, "to": y} for x, y in zip(begin.tolist(), end.tolist())])
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(hits, pa.int64()), pa.array(spans, span)], ["_key", "n_hit", "spans"])

    return places.mapInArrow(merge, "_key string, n_hit long, spans array<struct<from: int, to: int>>")


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, spans, items): the hit words of every whole text, as spans [from, to) of word numbers, and the items.

    A window is SPAN consecutive words of an item, or a shorter item as a whole. Documents and items are winnowed, the chosen
    fingerprints joined and extended as far as the words agree, and the hits of a text merged to spans. Null and empty texts have no words; items without
    words have no window. Items of the same id are one item; a null id is an item of its own, null in ``items``. Repeated rows give
    repeated results; empty tables give empty results or no hits. Other columns of any name do not matter.
    """
    prints = materialise(benchmark_prints(benchmark), "prints")
    found = materialise(candidate_prints(docs, prints, [id_col], text_col), "candidates")
    hits = materialise(join_prints(found, prints), "hits")
    places = hits.select("_key", "place", "n").distinct().groupBy("_key").agg(F.collect_list(F.struct("place", "n")).alias("x"))
    items = hits.select("_key", "item").distinct().groupBy("_key").agg(F.array_sort(F.transform(F.collect_list(F.struct("item")), lambda x: x["item"])).alias("items"))
    marks = spans_of(places.select("_key", F.col("x.place").alias("at"), F.col("x.n").alias("n"))).join(items, "_key")
    rows = found.where("print is null").select(id_col, "_key", "n_words")
    clean = rows.where("_key is null").select(id_col, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<struct<from: int, to: int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    judged = rows.where("_key is not null").join(materialise(marks, "passages"), "_key", "left")
    empty = lambda c: F.coalesce(c, F.array()).alias(c)
    return clean.union(judged.select(id_col, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), empty("spans"), empty("items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without any hit word, with all columns, whatever their names. Null and empty texts stay, and rows with null ids are judged
    by their text; repeated rows stay or go together. An empty table gives an empty one, an empty benchmark drops nothing."""
    prints = materialise(benchmark_prints(benchmark), "prints")
    hits = join_prints(materialise(candidate_prints(docs, prints, [], text_col), "candidates"), prints)
    name = f"_key_{new_key()}"  # no column of the documents has this name
    keys = materialise(hits.select(F.col("_key").alias(name)).distinct(), "contaminated")
    keys_ = keys.hint("broadcast" if keys.count() <= MAX_BROADCAST_ROWS else "shuffle_hash")
    return docs.join(keys_, F.md5(F.col(text_col)) == F.col(name), "left_anti")


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's spans and items."""
    return find_passages(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
