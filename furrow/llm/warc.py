"""WARC archives with a two-level capture index.

Every record is a gzip member of its own, so an archive can be read from any record on. Captures are sorted by their
url key (host labels reversed) into compressed blocks; each index part keeps a sparse directory of its blocks,
and a small list names the first key of every part. A lookup searches the list of parts, then the part's
directory, then the block, each by bisection, and reads one range of one archive.

Archives and index are plain files in a shared folder. A task writes files under names of its own and returns rows
that refer to them; a repeated task writes other files, and only those of the attempt that counts are referred to.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from furrow.operators.joins import small_side

from .common import attempt_file, opened, shared_folder, written

MIN_SHARED_BYTES = 100
BLOCK_CAPTURES = 2000
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 8 << 20
PAGE, REFERRED_PAGE = "X-Page-ID", "X-Refers-To-Page-ID"
VERSION = b"WARC/1.1\r\n"

CAPTURES = (
    "surt string, page_id long, archive string, offset long, length long"
)
DIRECTORY = "first_surt string, first_id long, last_surt string, last_id long, part string, directory_offset long, directory_length long"


def url_key(url: Column) -> Column:
    """Sort key of a url: host labels reversed and joined by commas, ``)``, then path and query; lower case."""
    text = F.coalesce(url, F.lit(""))
    after = F.regexp_replace(F.lower(text), "^[^:/?#]*://", "")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.regexp_replace(F.regexp_replace(after, "^[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)


def planned_records(pages: DataFrame) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type, refers_to and its url to ``pages(page_id, url, html)``.

    Digests that occur twice or more are found from narrow rows; while they are few, pages are not moved to learn of them.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digested = pages.select(
        "page_id", "url", "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")
    )
    firsts = (
        digested.where(F.col("payload_bytes") >= MIN_SHARED_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    joined = digested.join(small_side(firsts), "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("first_id") != F.coalesce(F.col("page_id"), F.lit(-1)))
    return joined.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.coalesce("first_url", F.lit(""))).alias("refers_to_url"),
    )


def one_line(url: str | None) -> str:
    """A url that can stand in a header."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, place: str, date: str) -> bytes:
    """One record: header lines, empty line, block, two empty lines.

    The block is an HTTP response, without a payload for revisits. The record's id comes from its ``place`` (archive and
    offset), so it is unique whatever the page ids are; these stand in fields of their own.
    """
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if revisit else http + (row["html"] or "").encode()
    lines = [
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {one_line(row['url'])}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"{PAGE}: {'' if row['page_id'] is None else row['page_id']}",
        "Content-Type: application/http;msgtype=response",
    ]
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To-Target-URI: {one_line(row['refers_to_url'])}")
        lines.append(f"WARC-Refers-To-Date: {date}")
        lines.append(f"{REFERRED_PAGE}: {row['refers_to']}")
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; fails when it is not whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(VERSION.rstrip()):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    length = int(headers["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record is cut short")
    return headers, rest[:length]


def payload_of(block: bytes) -> tuple[int, bytes]:
    """Length that the HTTP headers of a block tell, and the payload behind them."""
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return int(fields["Content-Length"]), payload


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records to archives of bounded size; returns one capture row per record. All bear the time of writing."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    schema = pa.schema(
        [("surt", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = attempt_file(base, ".warc.gz"), 0
                    out = store.open_output_stream(name, compression=None)
                member = gzip.compress(record_bytes(row, f"{name}:{at}", date), 1, mtime=0)
                out.write(member)
                rows.append((row["surt"], row["page_id"], name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if out is not None:
            out.close()

    return records.withColumn("surt", url_key(F.col("url"))).mapInArrow(task, CAPTURES)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into parts of compressed blocks; returns one row per part, naming its directory."""
    schema = pa.schema(
        [("first_surt", pa.string()), ("first_id", pa.int64()), ("last_surt", pa.string()), ("last_id", pa.int64()),
         ("part", pa.string()), ("directory_offset", pa.int64()), ("directory_length", pa.int64())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        out, name, at, directory, block, last = None, "", 0, [], [], None

        def flush() -> None:
            nonlocal at, block
            data = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), 6)
            directory.append([block[0][0], block[0][1], at, len(data)])
            out.write(data)
            at += len(data)
            block = []

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = attempt_file(base, ".cdxz")
                    out = store.open_output_stream(name, compression=None)
                last = [row["surt"], -1 if row["page_id"] is None else row["page_id"], row["archive"], row["offset"], row["length"]]
                block.append(last)
                if len(block) == BLOCK_CAPTURES:
                    flush()
        if out is None:
            return
        if block:
            flush()
        data = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(data)
        out.close()
        first = directory[0]
        row = (first[0], first[1], last[0], last[1], name, at, len(data))
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    keys = [F.col("surt"), F.coalesce(F.col("page_id"), F.lit(-1))]
    return captures.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(task, DIRECTORY)


class CaptureIndex:
    """Lookups in an index: parts, directory and block are searched by bisection, one block is held."""

    def __init__(self, folder: str, parts: list[tuple]):
        self.store, _ = opened(folder)
        self.parts = parts  # (first_surt, first_id, last_surt, last_id, file, offset, length), sorted
        self.ends = [(p[2], p[3]) for p in parts]
        self.files: dict[str, object] = {}
        self.directory: tuple[int, list] = (-1, [])
        self.block: tuple[str, int, list] = ("", -1, [])

    def range(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.store.open_input_file(file)
        data = self.files[file].read_at(length, offset)
        if len(data) != length:
            raise ValueError(f"{file} is cut short")
        return data

    def captures(self, surt: str, page_id: int | None = None) -> list[list]:
        """Captures of a url key, of one page if given: [surt, page_id, archive, offset, length]."""
        low = (surt, -(1 << 63) if page_id is None else page_id)
        high = (surt, 1 << 63) if page_id is None else low
        found = []
        for p in range(bisect.bisect_left(self.ends, low), len(self.parts)):
            part = self.parts[p]
            if (part[0], part[1]) > high:
                break
            if self.directory[0] != p:
                self.directory = (p, json.loads(zlib.decompress(self.range(*part[4:7]))))
            blocks = self.directory[1]
            starts = [(b[0], b[1]) for b in blocks] if len(blocks) < 64 else _Starts(blocks)
            for b in range(max(0, bisect.bisect_left(starts, low) - 1), len(blocks)):
                if starts[b] > high:
                    break
                if self.block[:2] != (part[4], b):
                    data = zlib.decompress(self.range(part[4], blocks[b][2], blocks[b][3]))
                    self.block = (part[4], b, [json.loads(x) for x in data.split(b"\n")])
                rows = self.block[2]
                i = bisect.bisect_left(_Starts(rows), low)
                while i < len(rows) and (rows[i][0], rows[i][1]) <= high:
                    found.append(rows[i])
                    i += 1
        return found

    def record(self, capture: list) -> tuple[dict[str, str], bytes]:
        return parsed_record(gzip.decompress(self.range(*capture[2:5])))


class _Starts:
    """Keys of rows as a sequence, for bisection without a copy."""

    def __init__(self, rows: list):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple:
        return self.rows[i][0], self.rows[i][1]


def read_captures(wanted: DataFrame, folder: str, parts: list[tuple], tasks: int | None = None) -> DataFrame:
    """Look up ``wanted(surt, page_id)`` in the index and read their records.

    A row asked for twice, or two records under one key, give the records once per distinct key. Responses are
    checked against their digest. ``tasks`` share the keys; see :func:`reading_tasks`. Returns page_id, payload_bytes, payload_digest,
    record_type, refers_to.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64())]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, parts)
        for batch in batches:
            rows = []
            captures = [c for row in batch.to_pylist() for c in index.captures(row["surt"], row["page_id"])]
            for capture in sorted(captures, key=lambda c: (c[2], c[3])):
                headers, block = index.record(capture)
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                kind, (size, payload) = headers["WARC-Type"], payload_of(block)
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {capture} differs from its digest")
                page, refers = headers[PAGE], headers.get(REFERRED_PAGE)
                rows.append((int(page) if page else None, size, digest, kind, int(refers) if refers else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    keys = wanted.select("surt", F.coalesce(F.col("page_id"), F.lit(-1).cast("long")).alias("page_id")).distinct()
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    ranges = keys.repartitionByRange(*([tasks] if tasks else []), "surt", "page_id")
    return ranges.sortWithinPartitions("surt", "page_id").mapInArrow(task, out)


def reading_tasks(captures: DataFrame) -> int:
    """Number of tasks so that each reads about ``READ_BYTES`` of the archives; keys alone are too small to tell."""
    total = captures.agg(F.sum("length").alias("bytes")).first()["bytes"] or 0
    return max(1, -(-total // READ_BYTES))


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[str, list[tuple], int]:
    """Write ``pages`` to archives and index them; returns the folder, the list of index parts and the tasks to read all.

    The list has one row per part, as many as the index has partitions.
    """
    folder = folder or shared_folder(spark, "warc")
    captures = written(write_archives(planned_records(pages), folder), "captures")
    parts = sorted(tuple(row) for row in write_index(captures, folder).collect())
    return folder, parts, reading_tasks(captures)


def archived_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives and read every record back through the index.

    Null html is an empty payload, a null url an empty one. Payloads under 100 bytes are always responses. Of rows with
    equal payloads the smallest page_id is the response (null ids are never first); rows repeating that id are
    responses too. An empty table gives no rows; other columns are ignored.
    """
    wanted = pages.select("page_id", "url", "html")
    folder, parts, tasks = archive_pages(spark, wanted)
    return read_captures(wanted.select("page_id", url_key(F.col("url")).alias("surt")), folder, parts, tasks)
