"""Filter interaction audit: what each of several filters removes in every order of applying them.

Each document gets a failure flag for each filter. Documents are counted for each combination of part and flags, and a CUBE over the
flags and the part is taken of those counts, which are 32 a part at most. A grouping set that keeps some flags, in its row where all of
them are false, counts the documents that survive this subset of the filters. Subsets joined with themselves and one more filter give
what a filter removes after any others, and so each step of each order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, find_words, join_skewed, materialise, scan_text, text_bytes, word_hashes

FILTERS = "ABCDE"
#: Limits of the filters A to D.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
_COUNTS = ("n", "good", "toxic")


def text_flags(texts: pa.LargeStringArray) -> dict[str, np.ndarray]:
    """Whether each text fails A (few words), B (few different words), C (many capitals), D (a mark inside)."""
    data, offsets = text_bytes(texts)
    starts, ends, bounds = find_words(data, offsets, NOT_SPACE)
    hashes = word_hashes(data, starts, ends)
    words = np.diff(bounds)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(mask)
        return np.searchsorted(at, offsets[1:], "left") - np.searchsorted(at, offsets[:-1], "left")

    upper, points = count((data >= 65) & (data <= 90)), count((data & 0xC0) != 0x80)
    return {
        "A": words < MIN_WORDS, "B": 100 * distinct < MIN_DISTINCT_PERCENT * words, "C": 100 * upper > MAX_UPPER_PERCENT * points,
        "D": count(np.isin(data, np.frombuffer(MARKS, np.uint8))) > 0,
    }


def flagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, A to E) of every document: true where it fails the filter.

    E fails where a row of the table with a smaller id has the same text (compared by its 256-bit digest). Null texts are empty ones, a null part is the
    empty string, and a null id is neither smaller nor larger than any. The least id of each text is counted before any exchange,
    and a text that very many rows share is joined by broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    kinds = ", ".join(f"{c} boolean" for c in "ABCD")
    rows = materialise(scan_text(picked, ["id", "part", "digest"], "text", text_flags, kinds), "flags")
    same = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("_rows")).where("_rows > 1")
    repeated = materialise(same, "copies")
    size = repeated.agg(F.sum("_rows")).first()[0] or 0
    out = join_skewed(rows, repeated, "digest", size, "left")
    return out.select(F.col("id").alias(id_col), "part", *FILTERS[:-1], F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("E"))


def survivors(flags: DataFrame, filters: str = FILTERS, counts: tuple[str, ...] = _COUNTS) -> DataFrame:
    """(part, subset, counts): what passes every filter of each subset, for each part and, with part null, over all parts.

    ``flags`` has part, a boolean for each filter, and the counts to add up. Bit i of ``subset`` stands for the filter ``filters[i]``.
    Subsets that nothing survives have rows of zeros.
    """
    summed = flags.groupBy("part", *filters).agg(*(F.sum(c).alias(c) for c in counts))
    cubed = summed.cube("part", *filters).agg(F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"g{f}") for f in filters), *(F.sum(c).alias(c) for c in counts))
    passed = F.lit(True)
    for f in filters:
        passed &= (F.col(f"g{f}") == 1) | ~F.col(f)
    subset = sum(((1 - F.col(f"g{f}").cast("int")) * (1 << i) for i, f in enumerate(filters)), F.lit(0))
    found = cubed.where(passed).select("part", "all_parts", subset.alias("subset"), *counts)
    # rows of the grouping sets without a flag stand for their parts
    every = found.where("subset = 0").select("part", "all_parts", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    joined = every.alias("e").join(found.alias("f"), F.col("e.part").eqNullSafe(F.col("f.part")) & (F.col("e.all_parts") == F.col("f.all_parts")) & (F.col("e.subset") == F.col("f.subset")), "left")
    return joined.select("e.part", F.col("e.all_parts").cast("boolean").alias("all_parts"), "e.subset", *(F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in counts))


def steps(table: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from ``survivors``; part null is that of all parts."""
    size, full = len(filters), (1 << len(filters)) - 1
    spark = table.sparkSession
    cut = [F.col("part"), F.col("all_parts")]
    before = table.select(*cut, F.col("subset").alias("before"), *(F.col(c).alias(f"b_{c}") for c in _COUNTS)).withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    before = before.where("shiftright(before, filter) & 1 = 0").withColumn("after", F.col("before") + F.expr("shiftleft(1, filter)"))
    after = table.select(F.col("part").alias("p"), F.col("all_parts").alias("q"), F.col("subset").alias("after"), *(F.col(c).alias(f"a_{c}") for c in _COUNTS))
    pairs = before.join(after.withColumnRenamed("after", "s"), F.col("part").eqNullSafe(F.col("p")) & (F.col("all_parts") == F.col("q")) & (F.col("after") == F.col("s")))
    gone = {c: F.col(f"b_{c}") - F.col(f"a_{c}") for c in _COUNTS}
    # a subset of s filters comes before one of the others in s! (size - 1 - s)! orders
    orders = F.element_at(F.array(*(F.lit(factorial(s) * factorial(size - 1 - s)) for s in range(size))), F.bit_count("before") + 1)
    pairs = pairs.select(*cut, "before", "filter", F.col("a_n").alias("kept"), gone["n"].alias("removed"), gone["good"].alias("good_lost"), gone["toxic"].alias("toxic_lost"), (gone["n"] * orders).alias("share"))
    others = F.lit(full) - F.expr("shiftleft(1, filter)")
    of_filter = pairs.groupBy(*cut, "filter").agg(
        F.sum("share").alias("shapley"),
        F.sum(F.when(F.col("before") == 0, F.col("removed")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("before") == others, F.col("removed")).otherwise(0)).alias("unique_fails"),
    )
    places = []
    for order in permutations(range(size)):
        done = 0
        for step, f in enumerate(order, 1):
            places.append(("".join(filters[i] for i in order), step, f, done))
            done |= 1 << f
    places = spark.createDataFrame(places, "filter_order string, step int, filter int, before int")
    joined = pairs.join(of_filter.select(F.col("part").alias("p"), F.col("all_parts").alias("q"), F.col("filter").alias("f"), "shapley", "failing", "unique_fails"), F.col("part").eqNullSafe(F.col("p")) & (F.col("all_parts") == F.col("q")) & (F.col("filter") == F.col("f")))
    joined = joined.join(F.broadcast(places), ["filter", "before"])  # factorial(size) * size rows
    return joined.select(*cut, "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", overall: bool = False) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters.

    ``labels`` tell which ids are of good quality or toxic; where rows of an id disagree, a 1 counts. Documents of null id have no
    labels. Repeated rows are documents of their own (E compares different ids only). An empty table has no parts and gives no
    rows. Other columns of any name are left out. With ``overall``, rows of part null follow, for the whole table.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    flags = flagged(docs, id_col, text_col, part_col).withColumnRenamed(id_col, "id")
    rows = flags.join(known, flags["id"] == known["doc_id"], "left").select("part", *FILTERS, F.lit(1).cast("long").alias("n"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    table = materialise(survivors(rows), "survivors")
    out = steps(table)
    return (out if overall else out.where(~F.col("all_parts"))).drop("all_parts")
