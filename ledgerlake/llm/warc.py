"""WARC archives in Zstandard: a dictionary in a leading skippable frame, one frame for each record, and a checking reader."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_slices, work_dir

#: Magic numbers of the format (fixed values): skippable dictionary frame, Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Records with shorter payloads are always responses.
MIN_REVISIT = 1000
#: An archive is closed at so many bytes. A dictionary is trained on at most so many payloads, of so many bytes each.
ARCHIVE_BYTES, DICTIONARY_ROWS, DICTIONARY_PART, DICTIONARY_BYTES = 64 << 20, 600, 8192, 32 << 10
#: Groups of equal payloads that are sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000
READ_BYTES = 1 << 16


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to): of equal payloads of MIN_REVISIT bytes or more, the row with the
    largest id is the response and the others revisit it. Payloads are equal if their SHA-1 and length are."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long_rows = F.length("payload") >= MIN_REVISIT
    groups = rows.where(long_rows).groupBy("digest", F.length("payload").alias("n")).agg(F.max("page_id").alias("keep"), F.count("*").alias("rows")).where("rows > 1").select("digest", "n", "keep")
    groups = materialise(groups, "copies")
    few = groups.count() <= MAX_BROADCAST_ROWS
    both = rows.join(F.broadcast(groups) if few else groups, (rows.digest == groups.digest) & long_rows & (F.length("payload") == groups.n), "left")
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return both.select(
        "page_id", "url", "payload", rows.digest.alias("digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keep")).alias("refers_to"),
    )


def train_dictionary(records: DataFrame) -> bytes:
    """A dictionary for archives of such records, from the start of at most DICTIONARY_ROWS different payloads (those with the least
    hashes); empty if there are too few. Tasks send the driver hashes first, then the chosen payloads alone."""
    some = records.where((F.col("record_type") == "response") & (F.length("payload") >= 64)).select(F.xxhash64("digest").alias("h"), F.substring("payload", 1, DICTIONARY_PART).alias("p"))
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(DICTIONARY_ROWS).collect()]
    if len(least) < 16:
        return b""
    parts = [bytes(r.p) for r in some.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("p").alias("p")).orderBy("h").collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, parts)) // 10), parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header block alone; its Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    name = lambda x: f"<urn:ledgerlake:page:{'null' if x is None else x}>"
    head = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if record_type == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes ``.warc.zst`` files below ``folder`` (a URI that driver and executors share) and returns (path, n_records, n_bytes).

    Each task writes files of its own attempt; the result lists those of successful attempts only, once it is written down.
    """
    dictionary = train_dictionary(records)
    names = ["page_id", "url", "payload", "digest", "record_type", "refers_to"]

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
        out, number, done = None, 0, []
        path, count, size = "", 0, 0
        for batch in batches:
            for part in row_slices(batch, batch.column(2)):
                for row in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                    if out is None:
                        path, count = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst", 0
                        out, number = store.open_output_stream(path), number + 1
                        size = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary) if dictionary else 0
                    size += out.write(press.compress(record_bytes(*row, date)))
                    count += 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((path, count, size))
                        out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "n_records", "n_bytes"])

    return records.select(*names).mapInArrow(run, "path string, n_records long, n_bytes long")


class ArchiveError(ValueError):
    """An archive that does not keep to the format."""


def read_frames(stream):
    """The content of each Zstandard frame. The dictionary is loaded from a leading skippable frame; other skippable frames are
    passed over. A frame that ends early is an error."""
    buffer = b""

    def more(n: int) -> bool:
        nonlocal buffer
        while len(buffer) < n and (got := stream.read(max(READ_BYTES, n - len(buffer)))):
            buffer += got
        return len(buffer) >= n

    unpack = zstandard.ZstdDecompressor()
    first = True
    while more(1):
        if not more(4):
            raise ArchiveError("bytes after the last frame")
        magic = struct.unpack_from("<I", buffer)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if not more(8) or not more(8 + (n := struct.unpack_from("<I", buffer, 4)[0])):
                raise ArchiveError("a skippable frame ends early")
            if magic == DICTIONARY_MAGIC and first:
                raw = buffer[8 : 8 + n]
                if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            buffer, first = buffer[8 + n :], False
            continue
        if magic != FRAME_MAGIC:
            raise ArchiveError(f"no frame starts with {magic:#x}")
        first, one, parts = False, unpack.decompressobj(), []
        while True:
            parts.append(one.decompress(buffer))
            if one.eof:
                buffer = one.unused_data
                break
            buffer = stream.read(READ_BYTES)
            if not buffer:
                raise ArchiveError("a frame ends early")
        yield b"".join(parts)


def parse_record(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one record, after checking version, headers, lengths
    and digests."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1":
        raise ArchiveError("not a WARC/1.1 record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"} - set(fields):
        raise ArchiveError(f"fields are missing: {sorted(missing)}")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError("the block has another length than its header says")
    block = rest[:n]
    if fields["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
        raise ArchiveError("the block has another digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not mark or length is None:
        raise ArchiveError("the HTTP header block has no length")
    size, digest, kind = int(length[1]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    page = lambda x: None if (v := re.fullmatch(r"<urn:ledgerlake:page:(null|-?\d+)>", x)[1]) == "null" else int(v)
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError("the payload has another length or digest")
        return page(fields["warc-record-id"]), size, digest, kind, None
    if kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ArchiveError("neither a response nor a revisit")
    return page(fields["warc-record-id"]), size, digest, kind, page(fields["warc-refers-to"])


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the files in column ``path``.

    Files are dealt over as many tasks as there are files, also where their list is a few rows; a task streams a file and holds a
    record at a time. A broken file raises ArchiveError. No files give no records.
    """

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with store.open_input_stream(path) as stream:
                    for raw in read_frames(stream):
                        rows.append(parse_record(raw))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = paths.select("path").distinct()
    return files.repartition(max(1, files.count()), "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives in the shared folder and reads them back.

    A null html is an empty payload; a null url has no target field; a null page_id is written as ``null``. Rows that repeat
    the largest id of a group are all responses, and so are all rows of a group without ids. Ids are whole numbers. An empty table
    gives no archive and no rows; other columns do not matter. The archives stay in the folder, in which DICTIONARY_ROWS and
    DICTIONARY_PART bound only what the dictionary is trained on: every payload is written whole.
    """
    folder = f"{work_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    written = materialise(write_archives(plan_records(pages), folder), "archives")
    return read_archives(written, folder)
