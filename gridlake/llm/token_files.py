"""Token-ID output: Arrow files with fixed-size-list batches, and their reader.

Documents are dealt to shards by ranges of their id, so that shard order and order inside a shard are ascending ids.
A shard is two Arrow IPC files. ``ids-*.arrow`` holds equal-length sequences: ``input_ids``, a fixed-size list of the
narrowest unsigned type for the vocabulary, and ``mask``, a fixed-size list of bytes, 1 for ids and 0 on the padding at the
shard's end. Batches are not compressed: a mapped file gives any sequence and its mask without a copy. ``docs-*.arrow``
holds ``doc_id``, ``start`` (in the shard) and ``n_tokens``. Shards are written and read batch by batch, whatever their size.

Defined results: a null or empty text has the end id alone; null ids come first; rows that share an id all stay, in the
order of their compressed texts; very long texts are written piece by piece; an empty table gives no shards and no rows;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SharedFile, filesystem, new_path, table, width
from .tokens import encoder

DOCS_A_SHARD = 4096
MOST_SHARDS = 20_000  # beyond this shards grow; no task holds one
SEQUENCES_A_BATCH = 512
MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_tokens long, n_sequences long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ShardWriter:
    """Writes one shard, batch by batch."""

    def __init__(self, folder: str, part: int, length: int, kind: np.dtype):
        self.part, self.length, self.kind = part, length, kind
        self.names = [f"{folder}/{x}-{part:08d}.arrow" for x in ("ids", "docs")]
        self.value = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(self.value, length)), ("mask", pa.list_(pa.uint8(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [SharedFile(x) for x in self.names]
        self.writers = [pa.ipc.new_file(f.stream, s) for f, s in zip(self.files, (self.schema, self.index), strict=True)]
        self.left = b""
        self.docs = self.tokens = self.sequences = 0

    def add(self, doc_ids: list, ids: list[bytes]) -> None:
        size = self.kind.itemsize
        n = np.array([len(x) // size for x in ids], np.int64)
        start = self.tokens + np.cumsum(n) - n
        self.writers[1].write_batch(pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(start), pa.array(n)], schema=self.index))
        self.docs += len(ids)
        self.tokens += int(n.sum())
        data = b"".join([self.left, *ids])
        batch = size * self.length * SEQUENCES_A_BATCH  # all batches but the last are full
        whole = len(data) // batch * batch
        self._sequences(data[:whole], whole // size)
        self.left = data[whole:]

    def _sequences(self, data: bytes, real: int) -> None:
        values = np.frombuffer(data, self.kind)
        per = SEQUENCES_A_BATCH * self.length
        for k in range(0, len(values), per):
            part = values[k : k + per]
            mask = (np.arange(k, k + len(part)) < real).view(np.uint8)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.writers[0].write_batch(pa.record_batch(lists, schema=self.schema))
            self.sequences += len(part) // self.length

    def close(self) -> dict:
        if self.left:
            real = len(self.left) // self.kind.itemsize
            self._sequences(self.left + bytes(-len(self.left) % (self.length * self.kind.itemsize)), real)
        for w, f in zip(self.writers, self.files, strict=True):
            w.close()
            f.close()
        return {"part": self.part, "ids_file": self.names[0], "docs_file": self.names[1], "n_docs": self.docs, "n_tokens": self.tokens, "n_sequences": self.sequences}


def write(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encode and write all documents. Returns the manifest: one row a shard."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = docs.count()
    parts = max(width(spark), min(MOST_SHARDS, -(-rows // DOCS_A_SHARD)))
    # One number a shard, whatever the table's size.
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else None
    bounds = np.array(cuts or [], np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            texts = [squeeze((x or "").encode()) for x in batch.column(1).to_pylist()]
            # An id that fills several shards is spread over them by its text.
            low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
            spread = np.array([zlib.crc32(x) for x in texts], np.int64)
            part = (low + spread % (high - low + 1)).astype(np.int32)
            yield pa.record_batch([pa.array(part), batch.column(0), pa.array(texts, pa.binary())], names=["part", "doc_id", "packed"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        opened, done = None, []
        for batch in batches:
            part, doc_ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            k = 0
            while k < len(part):
                # A zstd frame tells its text's size, so that long texts go through few at a time.
                j, size = k, 0
                while j < len(part) and part[j] == part[k] and (j == k or size < 4_000_000):
                    size += zstandard.frame_content_size(batch.column(2)[j].as_py())
                    j += 1
                unpack = zstandard.ZstdDecompressor().decompress
                ids = encode.encode([unpack(x.as_py()).decode() for x in batch.column(2)[k:j]])
                if opened is None or opened.part != part[k]:
                    done += [opened.close()] if opened else []
                    opened = ShardWriter(folder, part[k], length, encode.kind)
                opened.add(doc_ids[k:j], ids)
                k = j
        done += [opened.close()] if opened else []
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("ids_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    packed = docs.mapInArrow(pack, "part int, doc_id long, packed binary").repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "packed")
    return table(packed.mapInArrow(store, MANIFEST), "token-manifest")


def open_shard(uri: str) -> pa.ipc.RecordBatchFileReader:
    """A shard's file, its batches by number. Local files are mapped, of others a batch is read when it is asked for."""
    files, path = filesystem(uri)
    return pa.ipc.open_file(pa.memory_map(path) if files.type_name == "local" else files.open_input_file(path))


def _flat(column: pa.FixedSizeListArray) -> np.ndarray:
    """All values of a batch's lists, as a view."""
    return column.flatten().to_numpy(zero_copy_only=True)


def sequence(uri: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of a shard and its mask: views of the mapped file, no other sequence is read."""
    batch = open_shard(uri).get_batch(k // SEQUENCES_A_BATCH)
    length = batch.schema.field(0).type.list_size
    at = slice(k % SEQUENCES_A_BATCH * length, (k % SEQUENCES_A_BATCH + 1) * length)
    return _flat(batch.column(0))[at], _flat(batch.column(1))[at]


def checksums(ids_file: str, docs_file: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of a shard's documents, each with the CRC-32 of its ids; batches of ids are passed once, in order."""
    ids, docs = open_shard(ids_file), open_shard(docs_file)
    held, begin, number, real = np.zeros(0, np.uint16), 0, 0, 0
    for k in range(docs.num_record_batches):
        batch = docs.get_batch(k)
        out = []
        for start, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            crc, at = 0, start
            while at < start + n:
                if at >= begin + len(held):
                    begin += len(held)
                    sequences = ids.get_batch(number)
                    held, number = _flat(sequences.column(0)), number + 1
                    real += int(_flat(sequences.column(1)).sum(dtype=np.int64))
                part = held[at - begin : start + n - begin]
                crc, at = zlib.crc32(part.astype("<u4"), crc), at + len(part)
            out.append(crc)
        yield batch, out
    said = sum(docs.get_batch(k).column(2).to_numpy().sum() for k in range(docs.num_record_batches))
    if number != ids.num_record_batches or real != said:
        raise ValueError(f"{ids_file} has {real} ids in {number} of {ids.num_record_batches} batches, its documents {said}")


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (over all shards), n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                for docs, crc in checksums(shard["ids_file"], shard["docs_file"]):
                    start = pa.array(docs.column(1).to_numpy() + shard["before"])
                    yield pa.record_batch([docs.column(0), start, docs.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a shard, so this window is small.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("part", "ids_file", "docs_file", "n_tokens", before.alias("before"))
    return shards.repartition(width(spark), "part").mapInArrow(load, READ)
