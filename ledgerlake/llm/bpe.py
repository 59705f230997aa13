"""Byte-level BPE: whole texts to token ids and back, with a segment tree over byte positions."""

from __future__ import annotations

import base64
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import once, row_slices, scan_text, small_batches, tidy

#: Pre-tokens remembered by a Python worker; at this many only those of the present texts stay.
CACHE_ENTRIES = 1 << 17
#: A leaf of the segment tree is a rank and, in its low bits, a byte position.
SHIFT = 32
MASK, NONE = (1 << SHIFT) - 1, np.int64(1 << 62)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Pairs:
    """Which two neighbouring token ids join, at which rank, and into which id; the id of each single byte."""

    def __init__(self, left, right, rank, merged, byte_ids):
        keys = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], np.asarray(rank, np.int64)[order]
        self.merged = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int32)
        self.merged[np.asarray(rank, np.int64)] = merged
        self.byte_ids = np.asarray(byte_ids, np.int32)
        self.index: dict[int, int] = {}

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> Pairs:
        """Rank files: two tokens join if their bytes together are a token; its rank is its id. Every byte must be a token."""
        rows = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = zip(*rows, strict=True) if rows else ((), (), ())
        return cls(left, right, rank, rank, [ranks[bytes([b])] for b in range(256)])

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NONE where they do not join."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], NONE) if len(self.keys) else np.full(len(keys), NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens end to end and the bounds of each: side by side in groups of like length, long ones alone."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        classes = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        counts, done = np.zeros(len(pieces), np.int64), []
        for size in np.unique(classes):
            rows = np.flatnonzero(classes == size)
            step = max(1, (1 << 18) // int(size)) if size < 256 else 1
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                if size < 256:
                    ids, counts[part] = self._merge([pieces[i] for i in part], lengths[part], int(size))
                else:
                    ids = self._merge_long(pieces[part[0]])
                    counts[part] = len(ids)
                done.append((part, ids))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(bounds[-1], np.int32)
        for part, ids in done:
            n = counts[part]
            flat[np.repeat(bounds[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, bounds

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same tree for one long pre-token, in plain Python."""
        if not self.index:
            self.index = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        n, none, get, merged = len(piece), int(NONE), self.index.get, self.merged.tolist()
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        size = 1 << (n - 1).bit_length()
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << SHIFT | i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        nxt, prv = list(range(1, n + 2)), list(range(-1, n))

        def put(leaf: int, rank: int | None) -> None:
            k = size + leaf
            tree[k] = none if rank is None else rank << SHIFT | leaf
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while (low := tree[1]) != none:
            i = low & MASK
            j = nxt[i]
            end = nxt[j]
            nxt[i], ids[i], ids[j] = end, merged[low >> SHIFT], -1
            prv[end] = i
            put(j, None)
            put(i, get(ids[i] << 32 | ids[end]) if end < n else None)
            if (before := prv[i]) >= 0:
                put(before, get(ids[before] << 32 | ids[i]))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _merge(self, pieces: list[bytes], n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A segment tree over byte positions for each piece; all ids and how many each piece has.

        Leaf i holds rank << SHIFT | i of the pair that starts at the live part at byte i, so the root is the leftmost pair of
        the lowest rank. A merge joins that part with its live right neighbour and updates three leaves, its own, its right
        neighbour's (dead now) and its left neighbour's, each in log2(size) steps.
        """
        count, levels = len(pieces), size.bit_length() - 1
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        ids = np.zeros((count, size + 1), np.int32)
        ids[:, :size] = self.byte_ids[raw]
        at = np.arange(size, dtype=np.int64)
        tree = np.full((count, 2 * size), NONE, np.int64)
        pair = at[None, :-1] + 1 < n[:, None]
        rank = self.find(ids[:, : size - 1][pair], ids[:, 1:size][pair])
        leaves = tree[:, size : 2 * size - 1]
        leaves[pair] = np.where(rank == NONE, NONE, rank << SHIFT | np.broadcast_to(at[:-1], pair.shape)[pair])
        width = size // 2
        while width:
            np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2], out=tree[:, width : 2 * width])
            width //= 2
        nxt = np.tile(np.arange(1, size + 2), (count, 1))
        prv = np.tile(np.arange(-1, size), (count, 1))
        live = at[None, :] < n[:, None]
        flat_tree, flat_ids, flat_nxt, flat_prv = tree.ravel(), ids.ravel(), nxt.ravel(), prv.ravel()
        rows = np.arange(count)
        while True:
            root = tree[rows, 1]
            rows = rows[root != NONE]
            if not len(rows):
                break
            root = root[root != NONE]
            base, trees, length = rows * (size + 1), rows * (2 * size), n[rows]
            i = root & MASK
            j = flat_nxt[base + i]
            end = flat_nxt[base + j]
            token = self.merged[root >> SHIFT]
            flat_ids[base + i] = token
            flat_nxt[base + i] = end
            flat_prv[base + end] = i
            live[rows, j] = False
            flat_tree[trees + size + j] = NONE
            right = np.full(len(rows), NONE)
            has = end < length
            right[has] = self.find(token[has], flat_ids[(base + end)[has]])
            flat_tree[trees + size + i] = np.where(right == NONE, NONE, right << SHIFT | i)
            before = flat_prv[base + i]
            has = before >= 0
            left = self.find(flat_ids[(base + before)[has]], token[has])
            flat_tree[(trees + size + before)[has]] = np.where(left == NONE, NONE, left << SHIFT | before[has])
            leaf = np.concatenate([size + i, size + j, size + before[has]])
            tree_of = np.concatenate([trees, trees, trees[has]])
            for _ in range(levels):
                leaf >>= 1
                k = tree_of + 2 * leaf
                flat_tree[tree_of + leaf] = np.minimum(flat_tree[k], flat_tree[k + 1])
        return ids[:, :size][live], live.sum(1)


class PieceIds(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, at most CACHE_ENTRIES of them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, Pairs.of_ranks(ranks)

    def add(self, pieces: set[str]) -> None:
        """A pre-token that is a token itself has its rank; the others are merged."""
        rest, raw = [], []
        for piece in pieces:
            r = self.ranks.get(b := piece.encode())
            if r is None:
                rest.append(piece)
                raw.append(b)
            else:
                self[piece] = r.to_bytes(4, "little")
        flat, bounds = self.pairs.merge(raw)
        packed, at = flat.astype("<u4").tobytes(), (4 * bounds).tolist()
        self.update({piece: packed[a:b] for piece, a, b in zip(rest, at, at[1:])})

    def encode(self, found: list[list[str]]) -> list[bytes]:
        """The packed ids of each list of pre-tokens."""
        new = set()
        for pieces in found:
            new.update(pieces)
        missing = new.difference(self)
        if len(self) + len(missing) > CACHE_ENTRIES:
            known = {p: self[p] for p in new if p in self}
            self.clear()
            self.update(known)
        self.add(missing)
        return [b"".join(map(self.__getitem__, pieces)) for pieces in found]


def vocabulary_key(what: str, ranks: dict[bytes, int]) -> str:
    """The same for the same ranks, so that a worker's tables serve later runs too."""
    return f"{what}-{len(ranks)}-{zlib.crc32(b' '.join(ranks))}-{zlib.crc32(array('I', ranks.values()).tobytes())}"


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): the ids of every whole text, packed as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded on its own; there are no special tokens. Null and empty texts have no ids. Repeated
    rows give repeated results, an empty table an empty one; a null id stays null. Other columns of any name do not matter. ``ranks`` (bounded by the vocabulary file) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    key = vocabulary_key("ids", ranks)

    def make(texts):
        ids, find = once(key, lambda: PieceIds(shared.value)), regex.compile(pattern).findall
        packed = ids.encode([find(t) for t in texts.to_pylist()])
        return {"n_tokens": pa.array([len(x) >> 2 for x in packed], pa.int64()), "ids": pa.array(packed, pa.binary())}

    return scan_text(df, [id_col], text_col, make, "n_tokens long, ids binary")


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the packed ids stand for; null ids give empty bytes. ``out_col`` replaces a column of that name."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    df = small_batches(df.drop(out_col))
    key = vocabulary_key("bytes", ranks)

    def run(batches):
        of = once(key, lambda: {r: t for t, r in shared.value.items()}).__getitem__
        for batch in batches:
            for part in row_slices(batch, batch.column(ids_col)):
                out = [b"".join(map(of, array("I", x or b""))) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, out_col])
            tidy()

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out_col, BinaryType())]))


def round_trip_digests(df: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The contract's columns: encode, decode what came out, and hash both."""
    back = decode(encode(df, ranks, pattern), ranks)
    return back.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
