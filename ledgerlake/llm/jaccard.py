"""Near-duplicates by SimHash with an exact check: fingerprints and their segment-popcount grid name pairs, the Jaccard similarity of word
shingles decides, a prefix filter adds every pair that fingerprints miss, and components follow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scan_text, word_hashes
from .simhash import components, links, shingle_bytes, simhash, with_components

SHINGLE = 5
#: Documents link at a similarity of 4/5 or more. The prefixes, the sizes and the distances below follow from it.
UP, DOWN = 4, 5
#: Documents of a bucket, in order of size, that each is paired with first; the rest of a larger bucket follows where it is not linked yet.
NEXT = 4
#: Documents whose common shingles go to the end of the order, and how many such shingles at most. They steer the cost, never the result.
SAMPLE, COMMON_SHARE, MAX_COMMON = 4000, 0.005, 50_000
#: Pairs that one vectorised step compares.
PAIR_BLOCK = 1 << 18
SKETCH = [f"b{i}" for i in range(4)]
#: Bits of the wide sketch, a multiple of the 256 of the columns above.
WIDE = 4096
#: Documents whose ids are sent to all executors to fetch their texts again; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 500_000


def shingle_sets(texts: pa.LargeStringArray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different 64-bit shingle hashes of each text; a shorter text is one shingle."""
    joined, starts, ends, bounds = shingle_bytes(texts, size)
    hashes = word_hashes(np.frombuffer(joined, np.uint8), starts, ends)
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def node_of(shingles: np.ndarray) -> int:
    """One number for equal sets; zero for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 5)).view(np.int64)) if len(shingles) else 0


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """WIDE parities: two sketches differ in no more bits than the sets differ in shingles."""
    odd = (np.bincount((shingles & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def prefix_of(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in one order of all shingles, so many that two sets of enough similarity share one of them."""
    last = np.isin(shingles, common, assume_unique=True)
    ordered = np.concatenate([shingles[~last], shingles[last]])
    return ordered[: len(shingles) - -(-UP * len(shingles) // DOWN) + 1]


def longs(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def common_shingles(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles that many documents of a sample have."""
    step = max(1, docs.count() // SAMPLE)
    part = docs.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0)
    seen = scan_text(part, [], text_col, lambda texts: {"shingles": longs(shingle_sets(texts))}, "shingles array<long>")
    counts = seen.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= max(5, COMMON_SHARE * SAMPLE))
    return np.sort(np.array([r.s for r in counts.orderBy(F.desc("count"), "s").limit(MAX_COMMON).collect()], np.int64).view(np.uint64))


def of_size(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return DOWN * np.minimum(m, n) >= UP * np.maximum(m, n)


def reachable(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough if their first common shingle stands at these places of their orders: what is
    common stands there or later. A similar pair passes in the bucket of its first common shingle, so nothing is lost."""
    return (UP + DOWN) * np.minimum(m - i, n - j) >= UP * (m + n)


def buckets(rows: DataFrame, pair_up) -> DataFrame:
    """(a, b, s, n, pos) of ``pair_up(columns)`` over whole buckets of equal s: pairs without s, and rows of large buckets with a alone.
    Rows have s, node, n and pos first."""
    names = rows.columns
    made = ["a", "b", "s", "n", "pos"]

    def meet(batches):
        held: list[list] = []
        n = 0

        def out(columns):
            for a, b in pair_up(*columns):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], made)
            if pair_up is neighbours:
                s, node, n, pos = columns
                large = np.searchsorted(s, s, "right") - np.searchsorted(s, s, "left") > NEXT + 1
                yield pa.RecordBatch.from_arrays([pa.array(node[large]), pa.nulls(int(large.sum()), pa.int64()), pa.array(s[large]), pa.array(n[large]), pa.array(pos[large])], made)

        for batch in batches:
            columns = [np.asarray(batch.column(c)) for c in names]
            if not len(columns[0]):
                continue
            held.append(columns)
            n += len(columns[0])
            if n < 1 << 17 or held[0][0][0] == columns[0][-1]:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            done = int(np.searchsorted(columns[0], columns[0][-1], "left"))  # the last bucket may go on
            yield from out([c[:done] for c in columns])
            held, n = [[c[done:] for c in columns]], len(columns[0]) - done
        if held:
            yield from out([np.concatenate(x) for x in zip(*held, strict=True)])

    return rows.repartition("s").sortWithinPartitions("s", "n", "node").mapInArrow(meet, "a long, b long, s long, n long, pos long")


def neighbours(s, node, n, pos):
    """Pairs of each document with the NEXT larger ones of its bucket."""
    for step in range(1, NEXT + 1):
        near = np.flatnonzero((s[:-step] == s[step:]) & of_size(n[:-step], n[step:]) & reachable(n[:-step], n[step:], pos[:-step], pos[step:])) if len(s) > step else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([node[near], node[near + step]]), axis=1) if len(near) else np.zeros((2, 0), np.int64)
        yield pairs[0], pairs[1]


def others(s, node, n, pos, root, *sketch):
    """The other pairs of each bucket that are not linked yet and that sizes and sketches do not rule out."""
    sketch = np.stack(sketch).view(np.uint64)
    order = np.lexsort((n, root, s))
    s, node, n, pos, root, sketch = s[order], node[order], n[order], pos[order], root[order], sketch[:, order]
    end = np.searchsorted(s, s, "right")
    new = np.flatnonzero(np.concatenate([(s[1:] != s[:-1]) | (root[1:] != root[:-1]), [True]])) + 1
    far = new[np.searchsorted(new, np.arange(len(s)), "right")] if len(s) else end  # past the rows of the same root
    total = np.cumsum(end - far)
    at = 0
    while at < len(s):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIR_BLOCK, "right")))
        k = (end - far)[at:to]
        left = np.repeat(np.arange(at, to), k)
        right = np.repeat(far[at:to], k) + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        fit = of_size(n[left], n[right]) & reachable(n[left], n[right], pos[left], pos[right])
        left, right = left[fit], right[fit]
        differ = np.bitwise_count(sketch[:, left] ^ sketch[:, right]).sum(axis=0, dtype=np.int64)
        fit = (UP + DOWN) * differ <= (DOWN - UP) * (n[left] + n[right])
        if fit.any():
            yield node[left[fit]], node[right[fit]]
        at = to


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs of enough similarity. Sketches rule most others out; the shingles of what is left are made from the texts again."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}"))
    differ = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    fit = (UP + DOWN) * differ <= (DOWN - UP) * (F.col("n_a") + F.col("n_b"))
    left = materialise(pairs.where("s is null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").where(fit).select("a", "b", "n_a", "n_b"), "pairs")
    wanted = left.select(F.col("a").alias("node")).distinct().union(left.select("b").distinct()).distinct()
    ids = nodes.join(wanted, "node").select(F.col("least").alias("_least"), "node")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    held = ids.select("_least").distinct()
    held = held.hint("broadcast" if wanted.count() <= MAX_BROADCAST_ROWS else "shuffle_hash")
    texts = texts.join(held, F.col("_id").eqNullSafe(F.col("_least")), "left_semi")

    def make(texts):
        sets = shingle_sets(texts)
        return {"node": pa.array([node_of(x) for x in sets], pa.int64()), "shingles": longs(sets)}

    sets = scan_text(texts, [], "_text", make, "node long, shingles array<long>").join(ids.select("node"), "node").dropDuplicates(["node"])
    sets = materialise(sets, "sets")
    both = left.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return materialise(both.where((UP + DOWN) * shared >= UP * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "similar")


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): candidate pairs of (node, n, fingerprint) that SimHash names: each node with the least of its fingerprint, and the least nodes of
    linked fingerprints (``simhash.links``, whose links connect all that differ in few bits). Nodes without shingles have no pairs."""
    first = materialise(nodes.where("n > 0").groupBy("fingerprint").agg(F.min("node").alias("first")), "fingerprints")
    of = lambda k, x: first.select(F.col("fingerprint").alias(k), F.col("first").alias(x))
    linked = links(first.select("fingerprint")).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    same = nodes.where("n > 0").join(first, "fingerprint").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    return linked.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, component_id) of every row: the least id among all documents reachable over pairs of similarity 4/5 or more.

    Similarity is that of the sets of SHINGLE words in a row; equal sets are one node. Pairs that SimHash fingerprints name are checked
    first, with those of next neighbours; what they link is not compared again. No pair is missed: two sets of that similarity share a shingle of their prefixes, and where the first of them stands leaves room for what they must have in common.
    Texts without words are alike. Repeated rows give repeated results, an empty table gives an empty one; other columns of any name do not
    matter. Null ids are never the least id; a component of null ids alone has none. Time is quadratic in
    what a bucket holds beside its components, in vectorised blocks.
    """
    common = common_shingles(docs, id_col, text_col)

    def make(texts):
        sets = shingle_sets(texts)
        wide = np.stack([sketch_of(x) for x in sets]) if sets else np.zeros((0, WIDE // 64), np.uint64)
        sketches = np.bitwise_xor.reduce(wide.reshape(len(sets), -1, 4), axis=1).view(np.int64)
        return {
            "node": pa.array([node_of(x) for x in sets], pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "fingerprint": simhash(texts).view(np.int64),
            **{c: pa.array(np.ascontiguousarray(sketches[:, i])) for i, c in enumerate(SKETCH)}, "wide": longs(list(wide)), "prefix": longs([prefix_of(x, common) for x in sets]),
        }

    schema = "node long, n long, fingerprint long, " + ", ".join(f"{c} long" for c in SKETCH) + ", wide array<long>, prefix array<long>"
    renamed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    prints = materialise(scan_text(renamed, ["_id"], "_text", make, schema), "prints")
    nodes = materialise(prints.groupBy("node", "n", *SKETCH).agg(F.min("_id").alias("least"), F.first("wide").alias("wide"), F.min("fingerprint").alias("fingerprint"), F.count("*").alias("_rows")), "nodes")
    once = prints.where("n > 0").select("node", "n", "prefix").dropDuplicates(["node"])
    rows = once.select(F.posexplode("prefix").alias("pos", "s"), "node", "n").select("s", "node", "n", F.col("pos").cast("long").alias("pos"))
    none = (F.lit(None).cast("long").alias(c) for c in ("s", "n", "pos"))
    pairs = materialise(buckets(rows, neighbours).union(by_fingerprint(nodes).select("a", "b", *none)), "candidates")
    found = similar(renamed, nodes, pairs, "_id", "_text")
    roots = components(found)
    large = pairs.where("s is not null").select("s", F.col("a").alias("node"), "n", "pos")
    linked = roots.union(roots.select("root", "root").distinct()).toDF("node", "root")
    known = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = large.join(known.select("node", "root", *SKETCH), "node").select("s", "node", "n", "pos", "root", *SKETCH)
    more = similar(renamed, nodes, materialise(buckets(rest, others), "candidates"), "_id", "_text")
    discard(pairs)
    out = with_components(prints.select("_id", "node"), nodes.select("node", "least", "_rows"), components(found.union(more)), "node")
    return out.select(F.col("_id").alias(id_col), "node", "component_id")
