"""What the text operators share: batch plumbing, vectorised word scanning, shared work tables, labelled samples."""

from __future__ import annotations

import ctypes
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at a time (a single longer text is a step of its own).
SLICE_BYTES = 1 << 20

#: An odd multiplier of the polynomial word hash.
BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where that is unset, and the master is local, a folder under /tmp is used instead.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/ledgerlake-work"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends here, and any executor may be lost."""
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def few_parts(df: DataFrame) -> DataFrame:
    """``df`` in a few partitions for each core at most: tables of links are small, and thousands of files of a few rows cost more than they hold."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._work_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def row_slices(batch: pa.RecordBatch, column: pa.Array):
    """Parts of a batch with about SLICE_BYTES of a string or binary column each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        base = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def slices(batch: pa.RecordBatch, text_col: str):
    """(part of the batch, its texts as a large string array without nulls), each of about SLICE_BYTES."""
    for part in row_slices(batch, batch.column(text_col)):
        yield part, pc.fill_null(part.column(text_col).cast(pa.large_string()), "")


def text_bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of the texts end to end, and the n + 1 offsets."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Keys that ``join_skewed`` sends to all executors, at most.
HOT_KEYS, HOT_ROWS = 100_000, 1_000


def join_skewed(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join of ``rows`` (``total`` of them) with ``table``, which has a row for each key and in ``_rows`` how many rows have it. With
    ``how`` "left", the table may lack keys, and ``total`` counts the rows of its keys alone.

    A key that many rows share is not one task's work: keys of HOT_ROWS rows and of a HOT_KEYS-th of all rows, so HOT_KEYS keys at
    most, are broadcast, and the other keys alone are joined by a shuffle. ``rows`` is read twice.
    """
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, cold = table.where(F.col("_rows") >= least).drop("_rows"), table.where(F.col("_rows") < least).drop("_rows")
    often = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return often.unionByName(rest)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+`` (UTF-8 continuation and lead bytes are never white space here).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z went to lower case.
WORDISH = np.zeros(256, bool)
WORDISH[48:58] = WORDISH[97:123] = WORDISH[128:] = True


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 bounds: text i has the words bounds[i]:bounds[i + 1]. No word crosses texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = np.empty_like(inside)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = True
    last = np.empty_like(inside)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for key, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): nearby inputs get unrelated outputs."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each word, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of n words from each position on, where n words follow."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += mix(words[j : len(words) - n + 1 + j] + np.uint64(j))
    return mix(total)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


_ONCE: dict[str, object] = {}


def once(key: str, build):
    """What ``build()`` returns, kept for the later tasks of the same Python worker; the two last keys stay."""
    if key not in _ONCE:
        while len(_ONCE) >= 2:
            _ONCE.pop(next(iter(_ONCE)))
        _ONCE[key] = build()
    return _ONCE[key]


def new_key() -> str:
    return uuid.uuid4().hex


def tidy() -> None:
    """Gives memory that a batch has used back to the system: a worker lives on for other tasks and other operators."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
except OSError:
    _LIBC = None

#: Rows of an Arrow batch between the JVM and Python, unless the session sets its own number.
BATCH_ROWS = 2000


def small_batches(df: DataFrame) -> DataFrame:
    """Texts are long, so batches of the default number of rows would hold tens of MB on both sides; a number set by the user stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, BATCH_ROWS)
    return df


def scan_text(df: DataFrame, keep: list[str], text_col: str, make, schema: str, beside: list[str] = ()) -> DataFrame:
    """``keep`` columns and what ``make(texts) -> dict of arrays`` returns for each row, in Arrow batches.

    Columns are picked by name before the scan, so others of any name do not matter. One row in, one row out. Numbers of the
    columns ``beside``, which must not be null, follow the texts as arrays.
    """
    picked = df.select(*dict.fromkeys([*keep, text_col, *beside]))

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text_col):
                made = make(texts, *(part.column(c).to_numpy() for c in beside))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(v if isinstance(v, pa.Array) else pa.array(v) for v in made.values())],
                    [*keep, *made],
                )
            tidy()

    kept = [f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep]
    return small_batches(picked).mapInArrow(run, ", ".join([*kept, schema]))


def filter_text(df: DataFrame, text_col: str, keep_mask) -> DataFrame:
    """The rows for which ``keep_mask(texts)`` is true, with all columns as they were."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, text_col):
                yield part.filter(pa.array(keep_mask(texts)))
            tidy()

    return small_batches(df).mapInArrow(run, df.schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled rows, chosen by a hash of the id; every class keeps its share.

    ``usable`` is a condition on doc_id. Rows without id, text or a 0/1 label teach nothing. One label a document: the
    largest where several disagree. One text: the least where rows repeat an id. So ``limit`` bounds the rows too, what is
    broadcast and what the model is fitted on.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id"), F.col("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def with_holdout(scored: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5 on)."""
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
