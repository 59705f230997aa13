"""N-gram Jaccard join by PartEnum signatures: every pair of shingle sets with similarity 4/5 or more shares a signature.

Sets are compared within size bands that grow fourfold; a set near the end of its band also visits the next one, so sets of enough
similarity always meet in a band. Two such sets of m and n shingles differ in at most (m + n) / 9 shingles. A band divides the domain
of shingles by a hash into groups of ``n2`` partitions. A signature is what a set holds in a subset of ``n2 - 1`` partitions of a
group, and all such subsets are enumerated: a group in which the sets differ in one partition at most gives a signature that both have.
Bands have more groups than that needs. So several signatures are shared, and each set leaves out as many, less one, of its own that
come last in an order common to all sets: those of few shingles, and of shingles that many documents have. What stays is shared still.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few_parts, join_skewed, materialise, member, mix, scan_text, slices, small_batches, tidy
from .jaccard import DOWN, MAX_BROADCAST_ROWS, SHINGLE, UP, WIDE, common_shingles, longs, node_of, of_size, shingle_sets, sketch_of
from .simhash import components, with_components

#: Factor from one size band to the next.
BAND = 4
#: Partitions of a group, where sets of a band differ in few shingles (up to SMALL) and otherwise. Subsets leave one of them out.
SMALL, FEW, MANY = 14, 3, 2
#: Partitions for each one that may differ. More of them give more signatures to choose from, and shorter ones.
SLACK = 1.3
#: Members of a bucket that each is paired with first; larger buckets are paired in whole afterwards, where they are not linked yet.
NEXT = 4
#: Rows of a bucket that one task pairs; larger ones are cut into blocks, and each two blocks meet in a task of their own.
BLOCK_ROWS = 1 << 13
#: Pairs that one vectorised step compares, and longs of the sketches it compares.
PAIR_BLOCK, MIDDLE = 1 << 16, 16


def most_apart(m, n):
    """Shingles in which sets of m and n at most differ at a similarity of UP / DOWN."""
    return (DOWN - UP) * (m + n) // (UP + DOWN)


def band_of(sizes: np.ndarray) -> np.ndarray:
    """The band of each size from 1 on: band b holds the sizes from BAND ** b to BAND ** (b + 1) - 1."""
    ends = BAND ** np.arange(1, 31, dtype=np.int64)
    return np.searchsorted(ends, sizes, "right")


def partitions(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partitions, partitions of a group) of each band."""
    largest = BAND ** (band.astype(np.int64) + 1) - 1
    apart = most_apart(largest, largest)
    per_group = np.where(apart <= SMALL, FEW, MANY)
    groups = np.ceil(SLACK * (apart + 1) / 2).astype(np.int64)
    return groups * per_group, per_group


def least_shared(n: np.ndarray, per_group: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Signatures that two sets share at least if they differ in ``apart`` shingles, wherever those lie.

    Of a pair of partitions, a difference spoils one of two signatures. Of three, the first difference in a group spoils two of three signatures, the second the third.
    """
    groups = n // FEW
    return np.where(per_group == MANY, n - apart, np.where(apart <= groups, n - 2 * apart, 2 * groups - apart))


def signatures(sets: list[np.ndarray], common: np.ndarray) -> list[np.ndarray]:
    """The signatures of each set of different shingle hashes. ``common`` (sorted) are shingles that come last in the order."""
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    start = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.flatnonzero(sizes)
    band, larger = band_of(sizes[whole]), DOWN * sizes[whole] // UP
    end = BAND ** (band + 1) - 1
    beyond = larger > end
    of = np.concatenate([whole, whole[beyond]])
    bands = np.concatenate([band, band[beyond] + 1])
    apart = most_apart(sizes[of], np.concatenate([np.minimum(larger, end), larger[beyond]]))
    of, bands, apart = of[apart > 0], bands[apart > 0], apart[apart > 0]  # else only equal sets match, and those are one
    if not len(of):
        return [np.zeros(0, np.uint64) for _ in sets]
    n, per_group = partitions(bands)
    wanted = n - least_shared(n, per_group, apart) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    count = sizes[of]
    entry = np.repeat(np.arange(len(of)), count)
    held = flat[np.repeat(start[of], count) + np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)]
    salt = mix(bands.astype(np.uint64) + np.uint64(101))
    at = first[entry] + (mix(held ^ salt[entry]) % n[entry].astype(np.uint64)).astype(np.int64)
    sums = np.zeros(first[-1], np.uint64)
    np.add.at(sums, at, mix(held + np.uint64(1)))
    rare = np.bincount(at[~member(held, common)], minlength=first[-1])
    owner = np.repeat(np.arange(len(of)), n)
    place = mix((np.arange(first[-1]) - first[owner]).astype(np.uint64) ^ salt[owner])
    signed = mix(sums ^ place)  # of each partition
    threes = per_group[owner] == FEW
    three, rare3, owner3 = signed[threes].reshape(-1, FEW), rare[threes].reshape(-1, FEW), owner[threes].reshape(-1, FEW)[:, 0]
    pairs = [(0, 1), (0, 2), (1, 2)]
    sig = np.concatenate([signed[~threes], *(mix(three[:, i] + mix(three[:, j])) for i, j in pairs)])
    weight = np.concatenate([rare[~threes], *(rare3[:, i] + rare3[:, j] for i, j in pairs)])
    owner = np.concatenate([owner[~threes], *([owner3] * len(pairs))])
    order = np.lexsort((sig, -weight, owner))
    rank = np.arange(len(order)) - first[owner[order]]
    kept = order[rank < wanted[owner[order]]]
    text = of[owner[kept]]
    kept = kept[np.argsort(text, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(sets)))])
    sig = sig[kept]
    return [sig[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_MADE = ["a", "b", "s", "n"]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none], _MADE)


def first_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) pairs of each member (s, n, node) of a bucket with the NEXT ones that follow it by size; and, as (a, null, s, n), the
    members of buckets of more than NEXT + 1. A task holds a batch and the NEXT + 1 rows before it, whatever a bucket's size."""

    def meet(batches):
        back, done = [np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
        for batch in batches:
            s, n, node = (np.concatenate([x, np.asarray(batch.column(c))]) for x, c in zip(back, ("s", "n", "node"), strict=True))
            old = len(back[0])
            first = np.ones(len(s), bool)  # a set that several tasks have read stands here several times
            first[1:] = (s[1:] != s[:-1]) | (node[1:] != node[:-1])
            s, n, node = s[first], n[first], node[first]
            pairs = []
            for step in range(1, min(NEXT, len(s) - 1) + 1):
                near = np.flatnonzero((s[:-step] == s[step:]) & of_size(n[:-step], n[step:]))
                near = near[near + step >= old]
                pairs.append(np.stack([node[near], node[near + step]]))
            if pairs:
                a, b = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
                yield _pairs(a, b)
            # a row belongs to a large bucket if it is one of NEXT + 2 rows in a row
            large = np.zeros(len(s), bool)
            full = np.flatnonzero(s[: max(0, len(s) - NEXT - 1)] == s[NEXT + 1 :])
            for step in range(NEXT + 2):
                large[full + step] = True
            new = large.copy()
            new[:old] &= ~done
            yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.nulls(int(new.sum()), pa.int64()), pa.array(s[new]), pa.array(n[new])], _MADE)
            keep = slice(max(0, len(s) - NEXT - 1), None)
            back, done = [s[keep], n[keep], node[keep]], np.concatenate([done, np.zeros(len(s) - old, bool)])[keep] | large[keep]

    return rows.repartition("s").sortWithinPartitions("s", "n", "node").mapInArrow(meet, "a long, b long, s long, n long")


def later_pairs(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b) pairs of each bucket (s, node, n, root) that have different roots and that sizes and sketches do not rule out.

    ``rows`` are a written table. Buckets of one root fall away; the others are cut into blocks of BLOCK_ROWS rows.
    """
    stats = rows.groupBy("s").agg(F.count("*").alias("_rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s", "_rows")
    stats = materialise(few_parts(stats.withColumn("k", F.ceil(F.col("_rows") / BLOCK_ROWS))), "buckets")
    total = stats.agg(F.sum("_rows")).first()[0] or 0
    mixed = materialise(few_parts(join_skewed(rows, stats, "s", total)), "mixed")
    held = sketches.join(mixed.select("node").distinct(), "node").dropDuplicates(["node"])
    folds = WIDE // 64 // MIDDLE
    middle = F.transform(F.sequence(F.lit(0), F.lit(MIDDLE - 1)), lambda i: _xor([F.get("wide", i + MIDDLE * k) for k in range(folds)]))
    split = mixed.join(held.select("node", middle.alias("sketch")), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("k")))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    split = split.select("s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "root", "n", "node", "sketch")

    def ends(*keys) -> np.ndarray:
        """Where the run of equal keys of each row ends."""
        new = np.ones(len(keys[0]), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        at = np.append(np.flatnonzero(new), len(new))
        return np.repeat(at[1:], np.diff(at))

    def pair(s, i, j, right, root, n, node, sketch):
        # two blocks: a left row meets the right ones; one block: a row meets those of later roots
        end, begin = ends(s, i, j), np.where(i == j, ends(s, i, j, root), ends(s, i, j, right))
        k = end - begin
        total, at = np.cumsum(k), 0
        while at < len(s):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + PAIR_BLOCK, "right")))
            left = np.repeat(np.arange(at, to), k[at:to])
            other = np.repeat(begin[at:to], k[at:to]) + np.arange(len(left)) - np.repeat(np.cumsum(k[at:to]) - k[at:to], k[at:to])
            fit = of_size(n[left], n[other]) & (root[left] != root[other])
            left, other = left[fit], other[fit]
            fit = np.bitwise_count(sketch[left] ^ sketch[other]).sum(axis=1, dtype=np.int64) <= most_apart(n[left], n[other])
            if fit.any():
                a, b = node[left[fit]], node[other[fit]]
                a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            at = to

    names = split.columns

    def column(batch, name):
        x = batch.column(name)
        return x.values.to_numpy().view(np.uint64)[x.offset * MIDDLE :].reshape(-1, MIDDLE)[: len(x)] if name == "sketch" else x.to_numpy(zero_copy_only=False)

    def meet(batches):
        held, n = [], 0
        for batch in batches:
            columns = [column(batch, c) for c in names]
            if not len(columns[0]):
                continue
            held.append(columns)
            n += len(columns[0])
            last = [c[-1] for c in columns[:3]]
            if n < 1 << 14 or all(c[0] == x for c, x in zip(held[0][:3], last, strict=True)):
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            open_ = (columns[0] == last[0]) & (columns[1] == last[1]) & (columns[2] == last[2])
            done = len(open_) - int(open_.sum())  # the last pair of blocks may go on
            yield from pair(*(c[:done] for c in columns))
            held, n = [[c[done:] for c in columns]], len(open_) - done
        if held:
            yield from pair(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return split.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "right", "root", "n").mapInArrow(meet, "a long, b long")


def _xor(columns):
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def wanted_of(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """One row of ``table`` for each node of the pairs (a, b)."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return table.join(nodes, "node").dropDuplicates(["node"])


def near_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The different pairs (a, b) that the wide sketches (node, n, wide) do not rule out, as a written table."""
    pairs = materialise(few_parts(pairs.distinct()), "pairs")
    held = materialise(few_parts(wanted_of(pairs, sketches)), "sketches")
    side = lambda k: held.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}"))
    differ = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    fit = (UP + DOWN) * differ <= (DOWN - UP) * (F.col("n_a") + F.col("n_b"))
    out = materialise(few_parts(pairs.join(side("a"), "a").join(side("b"), "b").where(fit).select("a", "b")), "near")
    discard(pairs)
    discard(held)
    return out


def similar_pairs(docs: DataFrame, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """The pairs of the written table ``near`` that are similar enough. The sets are made from the texts (_id, _text) of the nodes' least ids again."""
    ids = materialise(few_parts(wanted_of(near, nodes).select("node", F.col("least").alias("_least"))), "wanted")
    held = ids.select("_least").hint("broadcast" if ids.count() <= MAX_BROADCAST_ROWS else "shuffle_hash")
    texts = docs.join(held, F.col("_id").eqNullSafe(F.col("_least")), "left_semi")

    def make(texts):
        sets = shingle_sets(texts, SHINGLE)
        return {"node": pa.array([node_of(x) for x in sets], pa.int64()), "shingles": longs(sets)}

    sets = materialise(few_parts(scan_text(texts, [], "_text", make, "node long, shingles array<long>").dropDuplicates(["node"])), "sets")
    both = near.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    enough = (UP + DOWN) * F.size(F.array_intersect("s_a", "s_b")) >= UP * (F.size("s_a") + F.size("s_b"))
    out = materialise(few_parts(both.where(enough).select("a", "b")), "similar")
    discard(ids)
    discard(sets)
    return out


def roots_of(pairs: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes of the pairs (a, b). ``before``: roots that other pairs have led to, which are joined further."""
    if before is not None:
        one = lambda k: before.toDF(k, f"root_{k}")
        pairs = pairs.join(one("a"), "a", "left").join(one("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    found = components(pairs)
    found = found.union(found.select("root", "root").distinct()).toDF("node", "root")
    if before is None:
        return found
    joined = before.join(found.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return joined.union(found.join(before, "node", "left_anti"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, node, component_id) of every row: the least id among all documents reachable over similar pairs.

    A document's set is that of its different SHINGLE-word windows (of the whole sequence, if shorter); equal sets are one node. Sets
    of similarity UP / DOWN or more are linked, and no such pair is missed. Texts that are null or have no word have no shingles and are
    linked with nothing: their component is their own id. Null ids are never the least id; a component of null ids alone has none.
    Repeated rows give repeated results, an empty table gives an empty one. Columns of other names do not matter.
    """
    renamed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    common = common_shingles(renamed, "_id", "_text")
    made = {"node": pa.int64(), "n": pa.int64(), "wide": pa.list_(pa.int64()), "signatures": pa.list_(pa.int64())}

    def find(batches):
        seen = set()  # of the task: copies are not sent again
        for batch in batches:
            for part, texts in slices(batch, "_text"):
                sets = shingle_sets(texts, SHINGLE)
                node = [node_of(x) for x in sets]
                new = [i for i, x in enumerate(node) if len(sets[i]) and x not in seen and not seen.add(x)]
                fresh = [sets[i] for i in new]
                at = np.full(len(sets), -1)
                at[new] = np.arange(len(new))
                at = pa.array(at, mask=at < 0)
                wide, signs = longs([sketch_of(x) for x in fresh]), longs(signatures(fresh, common))
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(node, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), wide.take(at), signs.take(at)], ["_id", *made])
            tidy()

    kind = renamed.schema["_id"].dataType.simpleString()
    prints = materialise(small_batches(renamed).mapInArrow(find, f"_id {kind}, node long, n long, wide array<long>, signatures array<long>"), "prints")
    full, fresh = prints.where("n > 0"), prints.where("wide is not null")
    nodes = materialise(full.groupBy("node").agg(F.min("_id").alias("least"), F.count("*").alias("_rows")), "nodes")
    sketches = fresh.select("node", "n", "wide")
    pairs = materialise(first_pairs(fresh.select(F.explode("signatures").alias("s"), "n", "node")), "candidates")
    roots = roots_of(similar_pairs(renamed, nodes, near_pairs(pairs.where("s is null").select("a", "b"), sketches)))
    members = pairs.where("s is not null").select("s", F.col("a").alias("node"), "n")
    rest = materialise(members.join(roots, "node", "left").select("s", "node", "n", F.coalesce("root", "node").alias("root")), "members")
    discard(pairs)
    more = similar_pairs(renamed, nodes, near_pairs(later_pairs(rest, sketches), sketches))
    discard(rest)
    if not more.isEmpty():
        roots = roots_of(more, roots)
    within = with_components(full.select("_id", "node", "n"), nodes, roots, "node", closed=True)
    alone = prints.where("n = 0").select("_id", "node", "n", F.col("_id").alias("component_id"))
    return within.select("_id", "node", "n", "component_id").union(alone).select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "node", "component_id")
