"""SimHash near-duplicates: fingerprints, a segment-popcount grid that finds every close pair, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, discard, few_parts, find_words, join_skewed, materialise, mix, new_key, scan_text, text_bytes

SHINGLE = 4
SEED = 42
#: Fingerprints link at so many differing bits or fewer.
BITS = 4
#: Bit ranges of the grid's three coordinate groups. At most BITS = 4 differences fall into three groups, so one has at most 1.
GROUPS = ((0, 21), (21, 21), (42, 22))
#: Pairs that one vectorised step compares.
PAIR_BLOCK = 1 << 21
#: Rows of a cell that one task compares; a larger cell is cut into blocks, and each two blocks meet in a task of their own.
CELL_ROWS = 1 << 15


def shingle_bytes(texts: pa.LargeStringArray, size: int):
    """All words joined by single spaces, where each shingle starts and ends in that, and the shingle bounds of each text."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, bounds = find_words(data, offsets, NOT_SPACE)
    if not len(starts):
        return b"", starts, ends, np.zeros(len(texts) + 1, np.int64)
    keep = NOT_SPACE[data]
    gap = ends[:-1][starts[1:] > ends[:-1]]  # the first blank after a word stands for all of them
    keep[gap] = True
    data[gap] = 32
    place = np.concatenate([[0], np.cumsum(keep)])
    joined, starts, ends = data[keep].tobytes(), place[starts], place[ends]
    sizes = np.diff(bounds)
    first = np.repeat(bounds[:-1], sizes)
    number = np.arange(bounds[-1]) - first
    n = np.repeat(sizes, sizes)
    at = np.flatnonzero((number + size <= n) | ((number == 0) & (n < size)))
    last = at + np.minimum(size, n[at]) - 1
    count = np.where(sizes == 0, 0, np.maximum(1, sizes - size + 1))
    return joined, starts[at], ends[last], np.concatenate([[0], np.cumsum(count)])


def simhash(texts: pa.LargeStringArray, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text: bit b is set if over half of the shingle hashes have it."""
    joined, starts, ends, bounds = shingle_bytes(texts, size)
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    out, counts = np.zeros(len(texts), np.uint64), np.diff(bounds)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return out
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    votes = np.add.reduceat(bits, bounds[:-1][rows], axis=0, dtype=np.int32)
    over = (2 * votes > counts[rows][:, None]).astype(np.uint8)
    out[rows] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as a signed long) of every whole text; null texts and texts without words have fingerprint zero."""
    return scan_text(docs, [id_col], text_col, lambda texts: {"fingerprint": simhash(texts).view(np.int64)}, "fingerprint long")


def grid_cells(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, row, native) of the grid over segment popcounts.

    The 64 bits are cut into segments of two bits (one where a group has an odd number). The bit counts of all segments are a
    vector whose Manhattan distance never exceeds the Hamming distance. A cell is one vector of a group's counts. Each
    fingerprint is native to its own cell in each group; if its count sum there is odd, it also visits the cells at Manhattan
    distance 1. Any two vectors at distance 0 or 1 meet in a cell, at least one of them as a native.
    """
    cells, rows, native = [], [], []
    for g, (low, width) in enumerate(GROUPS):
        bits = (prints >> np.uint64(low)) & np.uint64((1 << width) - 1)
        even = np.uint64(0x5555555555555555)
        counts = ((bits & even) + ((bits >> np.uint64(1)) & even)).astype(np.int64)
        at = np.arange(len(prints))
        cells.append(counts | g << 24)
        rows.append(at)
        native.append(np.ones(len(at), bool))
        odd = np.flatnonzero(np.bitwise_count(bits) & 1)
        for s in range(0, width, 2):
            field = counts[odd] >> s & 3
            for go, step in ((field < (2 if s + 1 < width else 1), 1), (field > 0, -1)):
                cells.append(counts[odd[go]] + (step << s) | g << 24)
                rows.append(odd[go])
                native.append(np.zeros(int(go.sum()), bool))
    return np.concatenate(cells), np.concatenate(rows), np.concatenate(native)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] in ``labels`` (each row's smallest known row)."""
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            return
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels[:] = up


def link_cells(cell: np.ndarray, print_: np.ndarray, native: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole cells, as a forest: (fingerprint, the first fingerprint of its class) where those differ.

    Each row is compared with the natives before it in its cell; the exact distance decides.
    """
    order = np.lexsort((~native, cell))
    cell, print_, native = cell[order], print_[order], native[order]
    start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(start, len(cell)))
    natives = np.add.reduceat(native.astype(np.int64), start)
    first = np.repeat(start, size)
    against = np.where(native, np.arange(len(cell)) - first, np.repeat(natives, size))
    _, node = np.unique(print_, return_inverse=True)
    labels = np.arange(node.max() + 1)
    values = np.zeros(len(labels), np.uint64)
    values[node] = print_
    total = np.cumsum(against)
    at = 0
    while at < len(cell):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PAIR_BLOCK, "right")))
        n = against[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = np.repeat(first[at:to], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(print_[left] ^ print_[right]) <= BITS
        join_labels(labels, node[left[near]], node[right[near]])
        at = to
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return values[moved], values[labels[moved]]


def cell_counts(prints: DataFrame) -> DataFrame:
    """(cell, rows). There are under 450,000 cells, three groups of 3**10 * 2 or 3**11 count vectors."""

    def count(batches):
        for batch in batches:
            cell, n = np.unique(grid_cells(np.asarray(batch.column(0)).view(np.uint64))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "rows"])

    return prints.mapInArrow(count, "cell long, rows long").groupBy("cell").agg(F.sum("rows").alias("rows"))


def deal(cell: np.ndarray, prints: np.ndarray, large: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, part): rows of a large cell go to a block by their hash, and with it to the part of each two blocks it is one of.

    ``blocks`` are the counts of blocks of the ``large`` cells, in order. Rows of other cells are part 0 alone."""
    at = np.searchsorted(large, cell)
    at[at == len(large)] = 0
    k = np.where(large[at] == cell, blocks[at], 1) if len(large) else np.ones(len(cell), np.int64)
    row = np.repeat(np.arange(len(cell)), k)
    other = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    own = (mix(prints[row] + np.uint64(7)) % k[row].astype(np.uint64)).astype(np.int64)
    return row, np.minimum(own, other) * k[row] + np.maximum(own, other)


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints that connect exactly what all links connect. ``prints`` are distinct longs.

    Cells of over CELL_ROWS rows are cut, so no task holds a whole large cell; rows of one block are compared in each part that the block is in, about twice the grid's comparisons.
    """
    sizes = cell_counts(prints).where(F.col("rows") > CELL_ROWS).orderBy("cell").toArrow()
    large = sizes.column("cell").to_numpy().astype(np.int64)
    blocks = -(-2 * sizes.column("rows").to_numpy().astype(np.int64) // CELL_ROWS)

    def spread(batches):
        for batch in batches:
            values = np.asarray(batch.column(0)).view(np.uint64)
            for k in range(0, len(values), 1 << 12):
                part = values[k : k + (1 << 12)]
                cell, of, native = grid_cells(part)
                row, piece = deal(cell, part[of], large, blocks)
                for i in range(0, len(row), 1 << 19):
                    r = row[i : i + (1 << 19)]
                    yield pa.RecordBatch.from_arrays([pa.array(cell[r] | piece[i : i + (1 << 19)] << 26), pa.array(part[of[r]].view(np.int64)), pa.array(native[r])], ["cell", "fingerprint", "native"])

    def meet(batches):
        held: list[tuple] = []
        rows = 0

        def out(cell, print_, native):
            a, b = link_cells(cell, print_, native)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cell, print_, native = (np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            if not len(cell):
                continue
            held.append((cell, print_, native))
            rows += len(cell)
            if rows < 1 << 18 or held[0][0][0] == cell[-1]:
                continue
            cell, print_, native = (np.concatenate(x) for x in zip(*held, strict=True))
            done = int(np.searchsorted(cell, cell[-1], "left"))  # the last cell may go on
            yield out(cell[:done], print_[:done], native[:done])
            held, rows = [(cell[done:], print_[done:], native[done:])], len(cell) - done
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    cells = prints.mapInArrow(spread, "cell long, fingerprint long, native boolean")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that is reachable, for each node that has a link. Alternates large and small star steps.

    Each step needs a minimum for each node (summed before the shuffle) and a join that adaptive execution may split. Every
    round is written to the shared folder.
    """
    order = lambda x, y: (F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    edges = materialise(few_parts(links.where("a <> b").select(*order("a", "b")).distinct()), "links")
    while True:
        ends = edges.select("u", F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
        degree = ends.groupBy("u").agg(F.sum("out").alias("out"), F.count("*").alias("all"))
        if degree.where("out > 1 or (out = 1 and all > 1)").isEmpty():  # stars whose centres are the least
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(few_parts(pairs.select("e.u", "e.v").where("u <> v").distinct()), "links")
        discard(edges)
        edges = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row: the least id among all documents reachable over links.

    Copies share a fingerprint, so only distinct fingerprints enter the grid. Null texts and texts without words have
    fingerprint zero and link like others. Null ids are never the least id; a component of null ids alone has none. Repeated
    rows give repeated results. An empty table gives an empty result. Other columns of any name do not matter.
    """
    prints = materialise(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text"), "prints")
    nodes = materialise(prints.groupBy("fingerprint").agg(F.min("_id").alias("least"), F.count("*").alias("_rows")), "nodes")
    out = with_components(prints, nodes, components(links(nodes.select("fingerprint"))), "fingerprint")
    return out.select(F.col("_id").alias(id_col), "fingerprint", "component_id")


def with_components(rows: DataFrame, nodes: DataFrame, roots: DataFrame, key: str, closed: bool = False) -> DataFrame:
    """``rows`` with the least id of their component. ``nodes`` has a row for each ``key``, its least id and how many rows have it in
    ``_rows``; ``roots`` has (node, root) of the linked ones, of the roots too if it is ``closed``. Rows and nodes are written tables."""
    linked = (roots if closed else roots.union(roots.select("root", "root").distinct())).toDF(key, "root")
    known = materialise(nodes.join(linked, key, "left").select(key, "least", "_rows", "root"), "known")
    of_root = known.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_root = materialise(of_root.withColumnRenamed("n", "_rows"), "roots")
    size = known.agg(F.count("*").alias("nodes"), F.sum("_rows").alias("rows")).first()
    within = join_skewed(known.where("root is not null").select(key, "root", F.col("_rows").alias("n")), of_root, "root", size.nodes)
    alone = known.where("root is null").select(key, F.col("least").alias("component_id"), F.col("_rows").alias("n"))
    of_key = materialise(within.select(key, "component_id", "n").union(alone).withColumnRenamed("n", "_rows"), "components")
    return join_skewed(rows, of_key, key, size.rows or 0)


def hex16(col: str) -> Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near=near_duplicates) -> DataFrame:
    """The documents without near-duplicates of smaller id: one document of each component of ``near`` stays, with all columns.

    Rows with a null id stay only where their component has no id at all. Ids should be unique; of rows that repeat both id and text, one stays. Columns may have any name; an empty table stays empty.
    """
    found = near(docs, id_col, text_col).select(id_col, "component_id")
    kept = materialise(found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(id_col).count(), "kept")
    name = f"_kept_{new_key()}"  # no column of the documents has this name
    # texts are dealt by id at every size of the kept ids, and never sorted: only the ids are held
    ids = kept.select(F.col(id_col).alias(name)).hint("shuffle_hash")
    out = docs.join(ids, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
    return out.dropDuplicates([id_col, text_col]) if kept.where("count > 1").limit(1).count() else out
