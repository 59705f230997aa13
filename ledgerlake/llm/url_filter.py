"""URL filters: host and path rules, and for all other URLs a Bloom filter cascade over the corpus's own keys."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null and for URLs without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    of_host, _, rest = rule.partition("/")
    return ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + rest)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest fitting rule, or null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        out = (F if out is None else out).when(fits(host, path, rule), F.lit(rule))
    return F.lit(None).cast("string") if out is None else out


def domains(host: Column, labels: int) -> Column:
    """The host and its parent domains of up to ``labels`` labels, each once. Linear in the length of the host for each label."""
    if labels < 1:
        return F.array().cast("array<string>")
    last = F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    return F.array_distinct(last)


class Level:
    """One Bloom filter: its bits, a byte string, and how many hashes. It goes to the tasks as one binary literal of about 1.4
    bits for each key and halving of the error, whatever its size."""

    def __init__(self, data: bytes, bits: int, hashes: int):
        self.data, self.bits, self.hashes = data, bits, hashes

    @staticmethod
    def places(key: Column, bits: int, hashes: int, depth: int) -> list[Column]:
        """Double hashing, seeded by the level's depth."""
        a, b = (F.pmod(F.xxhash64(key, F.lit(2 * depth + i)), F.lit(bits)) for i in (0, 1))
        return [F.pmod(a + F.lit(i) * b + F.lit(i * i), F.lit(bits)) for i in range(hashes)]

    def has(self, key: Column, depth: int) -> Column:
        data, out = F.lit(self.data), F.lit(True)
        for place in self.places(key, self.bits, self.hashes, depth):
            byte = F.conv(F.hex(data.substr((F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out &= F.getbit(byte, (place % 8).cast("int")) == 1
        return out


class Cascade:
    """Exact membership of the listed keys among a known universe of keys.

    Level 0 holds the listed keys, level 1 the universe's other keys that level 0 also matches, level 2 the listed keys that
    level 1 also matches, and so on until none is left. The first level that does not match a key decides: it is listed if that
    level's number is odd. Keys outside the universe may be judged wrongly, so the universe must hold every key of the corpus.
    """

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """From two DataFrames of one string column ``key``; null keys are passed over. The driver gets the filters' bits alone."""
        listed = materialise(listed.where("key is not null").distinct(), "listed")
        others = materialise(universe.where("key is not null").distinct().join(listed, "key", "left_anti"), "others")
        inside, outside, levels = listed, others, []
        n, m = inside.count(), outside.count()
        while n:
            p = 0.5 if levels else min(0.5, max(1e-9, n / max(1, m) * math.sqrt(0.5)))
            bits = max(64, math.ceil(n * -math.log(p) / math.log(2) ** 2))
            hashes, depth = max(1, round(bits / n * math.log(2))) if bits > 64 else 4, len(levels)
            place = F.explode(F.array(*Level.places(F.col("key"), bits, hashes, depth)))
            rows = inside.select(place.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).toArrow()
            words = np.zeros(-(-bits // 64), "<u8")
            words[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
            level = Level(words.tobytes(), bits, hashes)
            levels.append(level)
            inside, outside = outside.where(level.has(F.col("key"), depth)), inside
            n = inside.count()
        discard(listed)
        discard(others)
        return cls(levels)

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[depth].has(key, depth), F.lit(depth % 2 == 1)).otherwise(out)
        return out


def judge_urls(pages: DataFrame, rules: dict[str, str], listed: list[str] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each URL.

    ``rules`` maps ``host/path`` to allow or block; a rule fits its host and all subdomains if the path starts with the rule's,
    and the longest fitting rule decides. Other URLs are blocked if their host or a parent domain is in ``listed`` (strings, or
    a DataFrame with a column ``key``), decided by the cascade over all hosts of the corpus. A null URL and one without ``://``
    have an empty host and path and are allowed. Repeated rows give repeated results, an empty table an empty one; other columns of
    any name do not matter. Hosts may have any number of labels: only parents as long as a listed key are made.
    """
    spark: SparkSession = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keys = listed if isinstance(listed, DataFrame) else spark.createDataFrame([(x,) for x in listed], "key string")
    # a key of more labels than any listed one is not listed, so a host of many labels has few keys
    labels = keys.agg(F.max(F.size(F.split("key", r"\."))).alias("n")).first().n or 0
    universe = parts.select("host").distinct().select(F.explode(domains(F.col("host"), labels)).alias("key"))
    cascade = Cascade.build(keys.select("key"), universe)
    judged = parts.withColumn("_listed", F.exists(domains(F.col("host"), labels), cascade.has))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    ruled = judged.select(id_col, "host", "path", rule.alias("rule"), F.coalesce("_listed", F.lit(False)).alias("_listed"))
    by_rule = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))[F.col("rule")] if rules else F.lit(None).cast("string")
    return ruled.select(id_col, "host", "path", "rule", F.coalesce(by_rule, F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
