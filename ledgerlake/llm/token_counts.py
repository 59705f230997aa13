"""Token counts of whole texts, mostly without merging: whole-token pre-tokens are counted directly."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import CACHE_ENTRIES, Pairs
from .common import new_key, once, scan_text

#: The split of byte-level pre-tokenizers (a fixed value of the file format).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """What counting needs of a byte-level BPE file: merges, special strings, and the strings proven to be one token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = (
            model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
            and not spec["normalizer"] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        odd = [t for t in spec["added_tokens"] if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if not plain or odd:
            raise ValueError("only plain byte-level BPE files are counted here")
        of = byte_alphabet()
        raw = lambda s: bytes(of[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        ids = {raw(t): i for t, i in model["vocab"].items() if not set(t).difference(of)}
        rows = [(ids[a], ids[b], i, ids[a + b]) for (a, b), i in self.merges.items()]
        self.pairs = Pairs(*zip(*rows, strict=True), [ids[bytes([b])] for b in range(256)])
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.whole = self.prove([t for t in ids if t not in {x.encode() for x in self.special}])

    def prove(self, tokens: list[bytes]) -> set[str]:
        """The vocabulary strings whose own merges end in one token. A string that is not valid UTF-8 is never a pre-token."""
        parts = np.diff(self.pairs.merge(tokens)[1])
        return {t.decode() for t, n in zip(tokens, parts, strict=True) if n == 1 and _is_text(t)}


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


class PieceCounts(dict):
    """Pre-token -> number of tokens. Proven whole tokens are always there; at most CACHE_ENTRIES others are remembered."""

    def __init__(self, whole: set[str], pairs: Pairs):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.pairs, self.most = whole, pairs, len(whole) + CACHE_ENTRIES

    def count(self, found: list[list[str]]) -> list[int]:
        """The tokens of each list of pre-tokens; only those that are neither proven nor remembered are merged."""
        new = set()
        for pieces in found:
            new.update(pieces)
        missing = new.difference(self)
        if len(self) + len(missing) > self.most:
            known = {p: self[p] for p in new if p in self}
            self.clear()
            self.update(dict.fromkeys(self.whole, 1) | known)
        missing = list(missing)
        bounds = self.pairs.merge([p.encode() for p in missing])[1]
        self.update(zip(missing, np.diff(bounds).tolist(), strict=True))
        return [sum(map(self.__getitem__, pieces)) for pieces in found]


def count_tokens(df: DataFrame, vocabulary: Vocabulary, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text; null texts count as empty.

    A special string inside a text is one token and splits the text, as the library does by default. Repeated rows give
    repeated results, an empty table an empty one; a null id stays null. Other columns of any name do not matter. The vocabulary is broadcast; its size is that of its file.
    """
    shared = df.sparkSession.sparkContext.broadcast((vocabulary.whole, vocabulary.pairs, vocabulary.special))
    key = new_key()

    def make(texts):
        whole, pairs, special = shared.value
        counts, find = once(key, lambda: PieceCounts(whole, pairs)), regex.compile(BYTE_LEVEL).findall
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        found, specials = [], []
        for t in texts.to_pylist():
            parts = cut.split(t) if cut is not None and any(s in t for s in special) else [t]
            found.append([piece for part in parts for piece in find(part)] if len(parts) > 1 else find(t))
            specials.append(len(parts) - 1)
        total = pa.array(np.add(counts.count(found), specials, dtype=np.int64), pa.int64())
        return {"n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": total, "over_limit": pc.greater(total, limit)}

    return scan_text(df, [id_col], text_col, make, "n_bytes long, n_tokens long, over_limit boolean")
