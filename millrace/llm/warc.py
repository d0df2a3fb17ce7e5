"""WARC archives with a two-level capture index.

Writing: each task streams its records, one gzip member each, into archives of bounded size in the shared folder and
returns a line per capture. Indexing: the lines are range-sorted by reversed-host URL key and cut into compressed blocks;
after so many blocks a task writes their sparse directory, a line per block, beside them. What is left to name is a
segment: its first and last key and where its directory is, a row for up to ``SEGMENT_BLOCKS * BLOCK_LINES`` captures.
Reading: a key is found by binary search in the segments, a range read and binary search of the segment's directory, a
range read and binary search of a block, and a range read of its records. Many keys are sought by tasks that hold
neighbouring ones, so each directory and block is read about once; the records found are then dealt by archive and
stretch, so that a task reads a bounded number of bytes, neighbours together.

Archives and blocks are opened through pyarrow's file systems, so the shared folder may be any that it knows. A
task that runs again writes files under a new name; only the names that the committed tables hold are ever read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.llm.storage import materialise, new_path

#: Bytes of an archive before the next one begins, of the stretch of one that a task reads, and read together.
ARCHIVE_BYTES = 256 << 20
STRETCH_BYTES = 32 << 20
READ_BYTES = 4 << 20
#: Lines of an index block, and blocks of a directory.
BLOCK_LINES, SEGMENT_BLOCKS = 1000, 1000
#: Segments that go to the tasks as one table: 10^5 of them index 10^11 captures in some 20 MB.
MOST_SEGMENTS = 100_000
WHEN = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """The URL with its host's parts reversed, ``com,example,www)/path?query``; what has no host stays as it is."""
    if not url or "://" not in url:
        return url or ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:end].lower().rsplit("@", 1)[-1]
    return ",".join(reversed(host.split(":")[0].split("."))) + ")" + (rest[end:] or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit holds no payload, but its length beside its digest."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {WHEN}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
        f"X-Page-ID: {page_id}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        payload = b""
        head += [f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(payload)}")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n") + deflate.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    return files, path


class _Archives:
    """Archives of one task, one open at a time."""

    def __init__(self, folder: str):
        self.files, self.path = _opened(folder)
        self.out, self.name, self.at = None, "", 0

    def add(self, member: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(member) > ARCHIVE_BYTES and self.at:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.files.open_output_stream(f"{self.path}/{self.name}", compression=None)
        place = self.at
        self.out.write(member)
        self.at += len(member)
        return self.name, place, len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def shared_payloads(pages: DataFrame, least: int) -> DataFrame:
    """``(sha1, refers_to)`` of every payload of ``least`` bytes or more that several records hold: the largest page_id."""
    known = pages.where(F.length("payload") >= least).select("page_id", F.sha1("payload").alias("sha1"))
    shared = known.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    return materialise(shared.where("n > 1").select("sha1", "refers_to"), "shared")


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` below ``folder``; the captures as a table of
    ``(key, page_id, archive, offset, length)``, written once.

    A null html is an empty payload, a null url an empty one; a null page_id is kept as null and revisits the largest
    id with its payload. Repeated rows and ids give a record each, with record ids of their own; of equal payloads
    every record with the largest page_id is a response. Large payloads are one record, whole. An empty table writes
    nothing; further columns, whatever their names, are not read. Only payloads that several records hold are joined,
    by their digest; where those are few they are broadcast and no payload is shuffled.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives(folder + "/archives")
        for batch in batches:
            rows = []
            for page_id, url, body, sha1, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                payload = body.as_py()
                kind = "response" if refers_to is None or page_id == refers_to else "revisit"
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = record(kind, str(uuid.uuid4()), page_id, url, payload, digest, len(payload), refers_to)
                rows.append((url_key(url), page_id, *archives.add(member)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "page_id", "archive", "offset", "length"])
        archives.close()

    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = plain.withColumn("sha1", F.sha1("payload")).join(shared_payloads(plain, least), "sha1", "left")
    lines = rows.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(written, "key string, page_id long, archive string, offset long, length long")
    return materialise(lines, "captures")


def index(captures: DataFrame, folder: str) -> DataFrame:
    """Compressed blocks of captures in key order, their directories, and the segments:
    ``(first_key, last_key, lines, file, offset, length)``, written once. Equal keys may span blocks and segments."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archives(folder + "/index")
        held: list = []
        directory: list = []

        def block(rows: list) -> None:
            lines = "\n".join(json.dumps(r) for r in rows)
            place = out.add(zlib.compress(lines.encode("utf-8", "surrogatepass"), 6))
            directory.append((rows[0][0], rows[-1][0], len(rows), *place))

        def segment() -> tuple:
            lines = "\n".join(json.dumps(r) for r in directory)
            found = (directory[0][0], directory[-1][1], sum(r[2] for r in directory), *out.add(zlib.compress(lines.encode("utf-8", "surrogatepass"), 6)))
            directory.clear()
            return found

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["first_key", "last_key", "lines", "file", "offset", "length"])

        for batch in batches:
            held += zip(*(c.to_pylist() for c in batch.columns))
            done, at = [], 0
            while len(held) - at >= BLOCK_LINES:
                block(held[at : at + BLOCK_LINES])
                at += BLOCK_LINES
                if len(directory) >= SEGMENT_BLOCKS:
                    done.append(segment())
            held = held[at:]
            yield batch_of(done)
        if held:
            block(held)
        yield batch_of([segment()] if directory else [])
        out.close()

    # the page_id parts equal keys, so that one very common URL does not fall into one task
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    entries = ordered.select("key", "page_id", "archive", "offset", "length")
    found = entries.mapInArrow(blocks, "first_key string, last_key string, lines long, file string, offset long, length long")
    return materialise(found, "segments")


def _ranged(files: fs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with files.open_input_file(path) as f:
        return f.read_at(length, offset)


class _Lines:
    """Compressed lines of the index, the last piece read kept: neighbouring keys ask for the same one."""

    def __init__(self, folder: str):
        self.files, self.path = _opened(folder)
        self.place, self.lines = None, []

    def at(self, name: str, offset: int, length: int) -> list:
        if self.place != (name, offset):
            data = zlib.decompress(_ranged(self.files, f"{self.path}/index/{name}", offset, length))
            self.place, self.lines = (name, offset), [json.loads(x) for x in data.decode("utf-8", "surrogatepass").split("\n")]
        return self.lines


def _within(rows: list, key: str) -> Iterator:
    """By binary search, the rows (first key, last key, ...), sorted, that may hold the key."""
    i = bisect.bisect_left(rows, key, key=lambda r: r[1])  # the first that ends at the key or after it
    while i < len(rows) and rows[i][0] <= key:
        yield rows[i]
        i += 1


def captures_of(keys: DataFrame, segments: DataFrame, folder: str) -> DataFrame:
    """``(key, archive, offset, length)`` of every capture of ``keys(key)``, null and unknown keys giving none.

    A key that several segments hold is sought in each by a task of its own, so a very common URL is shared out.
    """
    spark = keys.sparkSession
    number = segments.count()
    if number > MOST_SEGMENTS:
        raise ValueError(f"{number} segments; write fewer and larger ones: raise SEGMENT_BLOCKS")
    names = ["first_key", "last_key", "file", "offset", "length"]
    root = spark.sparkContext.broadcast(sorted(tuple(r) for r in segments.select(*names).collect()))

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *r[2:]) for key in batch.column(0).to_pylist() for r in _within(root.value, key)]
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "file", "offset", "length"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directories, blocks = _Lines(folder), _Lines(folder)
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[i], k) for i, k in zip((0, 2, 3, 4), kinds)], ["key", "archive", "offset", "length"])

        rows: list = []
        for batch in batches:
            for key, *segment in zip(*(c.to_pylist() for c in batch.columns)):
                for _, _, _, *place in _within(directories.at(*segment), key):
                    lines = blocks.at(*place)
                    a = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    rows += lines[a : bisect.bisect_right(lines, key, key=lambda x: x[0])]
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)

    wanted = keys.select(F.col("key").cast("string")).where("key is not null").distinct()
    places = wanted.mapInArrow(sought, "key string, file string, offset long, length long")
    # as many parts as the segments need: neighbouring keys share directories and blocks
    parts = max(spark.sparkContext.defaultParallelism, number)
    places = places.repartitionByRange(parts, "file", "offset", "key").sortWithinPartitions("file", "offset", "key")
    return places.mapInArrow(found, "key string, archive string, offset long, length long")


def read(spans: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of every record of ``spans(archive, offset,
    length)``, with ``url`` and ``payload`` (null for a revisit) if asked for. A response's digest is computed from the
    payload that was read; a payload that isn't as its header says fails the read. No spans give no rows."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 7 if payloads else 5]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def number(header: str) -> int | None:
        return None if header == "None" else int(header)

    def row_of(member: bytes, place: str) -> tuple:
        headers, payload = parsed(member)
        digest, n, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"]), headers["WARC-Type"]
        if kind == "response" and (base32_sha1(payload) != digest or len(payload) != n):
            raise ValueError(f"{place}: the payload differs from its header")
        refers = number(headers["X-Refers-To-Page"]) if kind == "revisit" else None
        return (number(headers["X-Page-ID"]), n, digest, kind, refers, headers["WARC-Target-URI"], payload if kind == "response" else None)[: len(names)]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(folder)
        for batch in batches:
            spans = list(zip(*(c.to_pylist() for c in batch.columns)))
            i = 0
            while i < len(spans):
                j, (archive, start, length) = i + 1, spans[i]
                end = start + length
                while j < len(spans) and spans[j][0] == archive and spans[j][1] == end and end - start < READ_BYTES:
                    end += spans[j][2]
                    j += 1
                data = _ranged(files, f"{path}/archives/{archive}", start, end - start)
                rows = [row_of(data[offset - start : offset - start + length], f"{archive} at {offset}") for _, offset, length in spans[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                i = j

    # a part is some stretches of archives, by bytes of payload and not by rows; the number given is kept as it is
    spans = materialise(spans.select("archive", "offset", "length"), "spans")
    size = spans.agg(F.sum("length")).first()[0] or 0
    parts = max(spans.sparkSession.sparkContext.defaultParallelism, -(-size // STRETCH_BYTES))
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    dealt = spans.repartition(parts, "archive", stretch).sortWithinPartitions("archive", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    return dealt.mapInArrow(records, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages; then every page's key is sought in the index and its captures are read."""
    folder = new_path(spark, "warc")
    captures = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, least=0)
    return read(captures_of(captures.select("key"), index(captures, folder), folder), folder)
