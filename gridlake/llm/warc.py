"""WARC archives of pages with a two-level capture index.

Writing: a page is one gzip member with one WARC record; a file begins with a warcinfo record. Of pages with equal payloads
the one with the smallest id is a ``response``; the others are ``revisit`` records that name it. Which pages are revisits
comes from digests and ids alone, so the join on a digest that a third of all pages share moves small rows, which Spark can
split; payloads are joined by page id.

Index: a capture is a line ``key id file offset length``; the key is the URL with its host reversed
(``org,example,www)/path``). Lines are sorted over all tasks and stored in compressed blocks, a file a task; a file ends in
its sparse directory, the first and last key and the place of each block. The table of index files is a row a task.

Lookup: the files, a file's directory and a block's lines are searched by halves; then the records are read by range. Of
many URLs, tasks first find the blocks that each key is in, then each block is read once for all keys that are in it, so a
URL with very many captures is spread over its blocks. Records are parsed one by one; output goes in slices of bounded size.

Archive files get a new name each time a task runs, and the captures name the file of the run that counted, so a task
that runs twice cannot mix two files.

Defined results: a null html is an empty payload; a null URL is an empty one; payloads shorter than ``least_bytes`` are
always responses; rows that repeat a page id are records of their own with ids of their own, and all rows with the smallest
id are responses; rows without an id are responses that nothing refers to; captures of one key sort by page id, file and
place; very long pages are written and read one at a time; an empty table writes nothing and reads as no rows; further
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SharedFile, apart, filesystem, new_path, table, width

FILE_BYTES = 256_000_000
BLOCK_LINES = 1000
_DATE = "2024-01-01T00:00:00Z"  # pages carry no capture time
CAPTURE = "key string, page_id long, file string, offset long, length long"
INDEX = "first_key string, last_key string, file string, directory long, size long, blocks int"
SLICE_BYTES = 4_000_000
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def host_key(url: str) -> str:
    """The sort key of a URL: lower-case host reversed by labels, then port, path and query."""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return f"){url}"
    host = ",".join(reversed(host.split("."))) if host else ""
    return f"{host}{f':{port}' if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _member(data: bytes) -> bytes:
    gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


def _info() -> bytes:
    block = b"software: gridlake\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {_DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, lone: bool = True, lone_target: bool = True) -> bytes:
    """One WARC record; a revisit has the HTTP head of the full payload but not the payload. lone: no other row has the
    page id, so the record's id comes from it; lone_target: the same of the page it refers to, so its record has a known id."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    own = name(page_id) if lone and page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {json.dumps(url)[1:-1]}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
        head += [f"WARC-Refers-To: {name(refers_to)}"] if lone_target else []
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says, checked against its payload where it has one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} differs from its digest")
    number = lambda x: int(x) if x is not None else None
    return {
        "page_id": number(fields.get("Page-ID")), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("Refers-To-Page-ID")), "url": json.loads(f'"{fields["WARC-Target-URI"]}"'), "payload": payload,
    }


def _few(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose payloads in a column are few bytes, or one row, so that few are Python objects at once."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < b.num_rows:
            j = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + SLICE_BYTES, "right")))
            yield b.slice(k, j - k)
            k = j


def write_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write all pages to archives. Returns their captures (a table)."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    digests = pages.filter(F.col("page_id").isNotNull() & (F.length("payload") >= least_bytes)).select("page_id", F.unhex(F.sha1("payload")).alias("digest"))
    pairs = digests.groupBy("page_id", "digest").agg(F.count("*").alias("rows"))
    first = pairs.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = pages.filter(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select("page_id", F.lit(True).alias("again"))
    revisits = pairs.join(apart(first), "digest", "left").withColumn("refers_to", F.when(F.col("refers_to") != F.col("page_id"), F.col("refers_to")))
    told = revisits.join(apart(repeated), "page_id", "left").join(apart(repeated.select(F.col("page_id").alias("refers_to"), F.col("again").alias("target"))), "refers_to", "left")
    notes = told.filter("refers_to is not null or again").select("page_id", "digest", "refers_to", "again", "target")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, 2):
            payloads = b.column(2).to_pylist()
            packed = [zlib.compress(x, 1) for x in payloads]
            digest = [hashlib.sha1(x).digest() for x in payloads]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array(digest, pa.binary())], names=["page_id", "url", "packed", "digest"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, at = None, "", 0
        for batch in _few(batches, 2):
            out = []
            for row in batch.to_pylist():
                if file is None or at >= FILE_BYTES:
                    if file is not None:
                        file.close()
                    name, at = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0
                    file = SharedFile(name)
                    file.stream.write(info := _member(_info()))
                    at = len(info)
                member = _member(record(row["page_id"], row["url"], zlib.decompress(row["packed"]), row["refers_to"], not row["again"], not row["target"]))
                file.stream.write(member)
                out.append({"key": host_key(row["url"]), "page_id": row["page_id"], "file": name, "offset": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if file is not None:
            file.close()

    packed = pages.mapInArrow(squeeze, "page_id long, url string, packed binary, digest binary")
    decided = packed.join(notes, ["page_id", "digest"], "left").select("page_id", "url", "packed", "refers_to", "again", "target")
    return table(decided.mapInArrow(store, CAPTURE), "captures")


def build_index(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Sort captures into files of compressed blocks, each with its directory. Returns the table of files, a row a task."""
    spark = captures.sparkSession
    folder = folder or new_path(spark, "warc-index")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, name, at, lines, directory = None, "", 0, [], []

        def block() -> int:
            data = zlib.compress(json.dumps(lines).encode(), 6)
            file.stream.write(data)
            directory.append((lines[0][0], lines[-1][0], at, len(data)))
            lines.clear()
            return len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if file is None:
                    name = f"{folder}/index-{uuid.uuid4().hex}.blocks"
                    file = SharedFile(name)
                lines.append((row["key"], row["page_id"], row["file"], row["offset"], row["length"]))
                if len(lines) == BLOCK_LINES:
                    at += block()
        if lines:
            at += block()
        out = []
        if file is not None:
            data = zlib.compress(json.dumps(directory).encode(), 6)
            file.stream.write(data)
            file.close()
            out.append({"first_key": directory[0][0], "last_key": directory[-1][1], "file": name, "directory": at, "size": len(data), "blocks": len(directory)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("directory", pa.int64()), ("size", pa.int64()), ("blocks", pa.int32())]))

    # The id and place beside the key split a URL that very many captures share.
    order = ("key", "page_id", "file", "offset")
    return table(captures.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).mapInArrow(store, INDEX), "warc-index-files")


class _Files:
    """A few files open for range reads."""

    def __init__(self):
        self.open: dict = {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            files, path = filesystem(uri)
            self.open[uri] = files.open_input_file(path)
        return self.open[uri].read_at(length, offset)


def _covering(rows: list, key: str, first: int, last: int) -> Iterator:
    """Of rows sorted by key ranges, those whose range has the key."""
    for row in rows[bisect.bisect_left(rows, key, key=lambda r: r[last]) :]:
        if row[first] > key:
            break
        yield row


class CaptureIndex:
    """Lookups by URL: binary search among files, in a file's directory and in a block; then range reads.

    A row for each index file is held, as many as tasks wrote the index; directories and blocks are read when needed.
    """

    def __init__(self, index: DataFrame):
        self.rows = sorted((r["first_key"], r["last_key"], r["file"], r["directory"], r["size"]) for r in index.collect())
        self.files, self.held = _Files(), ("", [])

    def __getstate__(self) -> dict:
        return {"rows": self.rows}

    def __setstate__(self, state: dict) -> None:
        self.rows, self.files, self.held = state["rows"], _Files(), ("", [])

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of each block that may have the key."""
        for _, _, file, at, size in _covering(self.rows, key, 0, 1):
            if self.held[0] != file:
                self.held = file, json.loads(zlib.decompress(self.files.read(file, at, size)))
            for _, _, offset, length in _covering(self.held[1], key, 0, 1):
                yield file, offset, length

    def captures(self, block: tuple[str, int, int]) -> list[list]:
        return json.loads(zlib.decompress(self.files.read(*block)))

    def record(self, line: list) -> dict:
        return parse(zlib.decompress(self.files.read(*line[2:]), 31))

    def lookup(self, url: str) -> list[dict]:
        key = host_key(url)
        return [self.record(line) for block in self.blocks(key) for line in _equal(self.captures(block), key)]


def _equal(lines: list[list], key: str) -> list[list]:
    """The lines of a block that have the key."""
    return lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]


def find(index: DataFrame, urls: DataFrame) -> DataFrame:
    """The records of all captures of urls (a column url), each once, through the index."""
    spark = index.sparkSession
    opened = spark.sparkContext.broadcast(CaptureIndex(index))  # a row for each task that wrote the index

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([host_key(u or "") for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                found = [(*block, key) for key in b.column(0).slice(k, 1000).to_pylist() for block in opened.value.blocks(key)]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "offset", "length", "key"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])
        index = opened.value

        def records(lines: list[list]) -> pa.RecordBatch:
            # In the order of the archives, not of the keys; of a record its fields alone stay.
            found = [{k: v for k, v in index.record(line).items() if k != "payload"} for line in sorted(lines, key=lambda x: x[2:4])]
            return pa.RecordBatch.from_pylist(found, schema=schema)

        held, lines, wanted = None, [], []
        for b in batches:
            for *block, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held != block:
                    if wanted:
                        yield records(wanted)  # a block's at most
                    held, lines, wanted = block, index.captures(tuple(block)), []
                wanted += _equal(lines, key)
        if wanted:
            yield records(wanted)

    # Keys in order, so that a task reads few directories; then blocks, each for all its keys.
    wanted = urls.select("url").mapInArrow(keys, "key string").distinct().repartitionByRange(width(spark), "key").sortWithinPartitions("key")
    located = wanted.mapInArrow(locate, "file string, offset long, length long, key string")
    return located.repartition(width(spark), "file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(load, RECORD)
