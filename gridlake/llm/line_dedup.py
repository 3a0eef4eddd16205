"""Line dedup: a sharded minimal perfect hash over repeated lines' hashes; documents probe its arrays.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. Counts cover
all rows: each task counts its own keys first, then a grouped sum joins them. Every key that two or more documents have
(one that a single document has is dropped nowhere) is dealt to a shard by its hash. A shard is a minimal perfect hash
(levels of bit arrays: a key that is alone at its place in a level stays there, the others go on to the next; ranks are
kept a word of 64 bits) that indexes two compact arrays, a 48-bit fingerprint and a count (of one byte where as few as 255 documents are asked for); keys
with at least as many documents as asked have their largest id in a third one. Documents probe the arrays and the count
decides; no line is joined with anything. A task gathers texts up to a size and probes each shard once for all of them.
Shards on a local file system are mapped, so tasks of a machine share their pages; others are read into a cache of bounded
size. A line that is in no shard passes for one that is with a probability of 2^-48.

Defined results: a null or empty text is one empty line; each row is a document of its own, also where ids repeat, and a
null id is below all others; a key's lines all stay in every row with the largest id; very long texts are taken one by one;
further columns are kept or ignored as the caller asks; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts
from .shared import Mapped, SharedFile, new_path, pack_arrays, spent, table, unpack_arrays

KEYS_A_SHARD = 500_000  # about 5 MB
GATHERED_BYTES = 32_000_000  # of texts, for which each shard is probed once
CACHED_BYTES = 128_000_000  # of shards that cannot be mapped
_NO_ID = np.iinfo(np.int64).min


class MinimalPerfectHash:
    """Maps each of n distinct 64-bit keys to a number of its own below n; other keys to any number, or -1.

    levels: bit arrays in words of 64 bits, of 64 * size bits each.
    """

    LEVELS = 48

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = []  # of each word: the keys before it, in all levels
        n = 0
        for words in levels:
            per = np.bitwise_count(words).astype(np.int64)
            self.ranks.append((n + np.cumsum(per) - per).astype(np.uint32))
            n += int(per.sum())

    @staticmethod
    def place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
        return texts.mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % np.uint64(64 * words)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash | None:
        """None if keys are equal, or do not come apart."""
        levels = []
        while len(keys):
            if len(levels) == cls.LEVELS:
                return None
            words = -(-2 * len(keys) // 64)
            at = cls.place(keys, len(levels), words).astype(np.int64)
            alone = np.bincount(at, minlength=64 * words) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, words in enumerate(self.levels):
            if not len(open_):
                break
            at = self.place(keys[open_], k, len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[k][word[hit]] + np.bitwise_count(below).astype(np.int64)
            open_ = open_[~hit]
        return out


class Lines:
    """Lines of a batch of texts: bytes begin..end of each, the text of each, and key hashes where keys are long."""

    def __init__(self, values: pa.Array, least: int):
        w = texts.words(values, lower=True, hashed=False)
        _, at = texts.buffers(values)
        breaks = np.flatnonzero(w.raw == 10)
        n = len(at) - 1
        inner = np.searchsorted(breaks, at)
        self.per_text = np.diff(inner) + 1
        self.first = np.concatenate(([0], np.cumsum(self.per_text)))
        begin, end = np.empty(self.first[-1], np.int64), np.empty(self.first[-1], np.int64)
        heads = np.zeros(self.first[-1], bool)
        heads[self.first[:-1]] = True
        begin[heads] = at[:-1]
        begin[~heads] = breaks + 1
        tails = np.zeros(self.first[-1], bool)
        tails[self.first[1:] - 1] = True
        end[tails] = at[1:]
        end[~tails] = breaks
        self.begin, self.end = begin, end
        self.text = np.repeat(np.arange(n), self.per_text)
        one, last = np.searchsorted(w.begin, begin), np.searchsorted(w.begin, end) - 1
        filled = np.flatnonzero(last >= one)
        a, b = w.begin[one[filled]], w.end[last[filled]]
        long = texts.code_points(w.raw, a, b) >= least
        self.keyed, a, b = filled[long], a[long], b[long]
        self.key = texts.span_hashes(w.raw, a, b)
        self.check = texts.span_hashes(w.raw, a, b, salt=1)
        self.a, self.b, self.raw = a, b, w.raw


def _ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def counts(docs: DataFrame, least_chars: int) -> DataFrame:
    """Each long line key's hashes, documents and largest id: key, mark, n, last."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            done = 0
            for part, values in texts.text_slices(batch, "text"):
                x = Lines(values, least_chars)
                own = ids[done : done + part.num_rows][x.text[x.keyed]]
                order = np.lexsort((x.text[x.keyed], x.check, x.key))
                key, check, text, own = x.key[order], x.check[order], x.text[x.keyed][order], own[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
                doc = new.copy()
                doc[1:] |= text[1:] != text[:-1]
                at = np.flatnonzero(new)
                n = np.add.reduceat(doc.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
                top = np.maximum.reduceat(own, at) if len(at) else np.zeros(0, np.int64)
                yield pa.record_batch([pa.array(key[at].view(np.int64)), pa.array(check[at].view(np.int64)), pa.array(n), pa.array(top)], names=["key", "mark", "n", "last"])
                done += part.num_rows

    found = docs.select("doc_id", "text").mapInArrow(local, "key long, mark long, n long, last long")
    return found.groupBy("key", "mark").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _count_type(least_docs: int) -> np.dtype:
    return np.dtype(np.uint8 if least_docs <= 255 else np.uint32)


def _joint(key: np.ndarray, mark: np.ndarray, salt: int) -> np.ndarray:
    """One hash of both; two pairs that one salt makes equal another one parts."""
    return texts.mix(key ^ texts.mix(mark + np.uint64(salt)))


def shard_bytes(key: np.ndarray, mark: np.ndarray, n: np.ndarray, last: np.ndarray, least_docs: int) -> bytes:
    """A shard's arrays: salt, fingerprints in two parts, counts, ids of keys with least_docs documents, and the levels."""
    made = None
    for salt in range(64):
        joint = _joint(key, mark, salt)
        made = MinimalPerfectHash.build(joint)
        if made is not None:
            break
    if made is None:
        raise ValueError("keys do not come apart")
    order = np.empty(len(key), np.int64)
    order[made(joint)] = np.arange(len(key))
    kind = _count_type(least_docs)
    mark, n, last = mark[order], np.minimum(n[order], np.iinfo(kind).max).astype(kind), last[order]
    arrays = [np.array([salt]), (mark & np.uint64(0xFFFFFFFF)).astype(np.uint32), (mark >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.uint16), n, last[n >= least_docs]]
    return pack_arrays([*arrays, *made.levels])


class Shard:
    """One shard's arrays, as views of its file's bytes."""

    def __init__(self, data: pa.Buffer, least_docs: int):
        salt, self.low, self.high, self.n, self.last, *levels = unpack_arrays(data)
        self.salt, self.hash = int(salt[0]), MinimalPerfectHash(levels)
        self.places = np.cumsum(self.n >= least_docs, dtype=np.uint32)  # of often repeated keys, in last

    def probe(self, key: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's count of documents (0: not here), and the largest id of those that are repeated often enough."""
        at = self.hash(_joint(key, mark, self.salt))
        found = np.flatnonzero(at >= 0)
        own = at[found]
        same = (self.low[own] == (mark[found] & np.uint64(0xFFFFFFFF))) & (self.high[own] == (mark[found] >> np.uint64(32) & np.uint64(0xFFFF)))
        found, own = found[same], own[same]
        n, last = np.zeros(len(key), np.int64), np.full(len(key), _NO_ID)
        n[found] = self.n[own]
        if len(self.last):
            last[found] = self.last[np.maximum(self.places[own].astype(np.int64) - 1, 0)]
        return n, last


def build(keys: DataFrame, folder: str, shards: int, least_docs: int) -> DataFrame:
    """Write the shards' arrays for rows (key, mark, n, last). Returns the directory: shard, file, n_keys."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        which = rows.column("shard").to_numpy()
        out = []
        for s in np.unique(which):
            part = rows.filter(pa.array(which == s))
            key, mark = (part.column(k).to_numpy().view(np.uint64) for k in ("key", "mark"))
            name = f"{folder}/shard-{s:06d}.bin"
            file = SharedFile(name)
            file.stream.write(shard_bytes(key, mark, part.column("n").to_numpy(), part.column("last").to_numpy(), least_docs))
            file.close()
            out.append({"shard": int(s), "file": name, "n_keys": len(key)})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_keys", pa.int64())]))

    dealt = keys.withColumn("shard", F.pmod(F.shiftrightunsigned("key", 33), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return table(dealt.mapInArrow(store, "shard int, file string, n_keys long"), "line-shards")


def _gathered(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[list[tuple[pa.RecordBatch, pa.Array, np.ndarray, Lines]]]:
    """Slices of batches with their lines, gathered up to a size of texts."""
    held: list[tuple[pa.RecordBatch, pa.Array, np.ndarray, Lines]] = []
    size = 0
    for batch in batches:
        ids = _ids(batch)
        done = 0
        for part, values in texts.text_slices(batch, "text"):
            x = Lines(values, least_chars)
            size += len(x.raw)
            del x.raw, x.begin, x.end, x.a, x.b
            held.append((part, values, ids[done : done + part.num_rows], x))
            done += part.num_rows
            if size >= GATHERED_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def drop_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, digest: bool = False) -> DataFrame:
    """Documents without their repeated lines: all columns with the new text, or digest columns."""
    spark = docs.sparkSession
    folder = new_path(spark, "line-arrays")
    source = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    repeated = table(counts(source, least_chars).filter(F.col("n") >= min(2, least_docs)), "line-keys")
    shards = max(1, -(-repeated.count() // KEYS_A_SHARD))
    directory = {r["shard"]: r["file"] for r in build(repeated, folder, shards, least_docs).collect()}  # one short row a shard
    spent(repeated)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Mapped(lambda data: Shard(data, least_docs), CACHED_BYTES)
        for held in _gathered(batches, least_chars):
            key, mark = (np.concatenate([getattr(x, k) for *_, x in held]) for k in ("key", "check"))
            which = (key >> np.uint64(33)) % np.uint64(shards)
            order = np.argsort(which, kind="stable")
            n, last = np.zeros(len(key), np.int64), np.full(len(key), _NO_ID)
            for rows in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(key) else ():
                s = int(which[rows[0]])
                if s in directory:
                    n[rows], last[rows] = opened[directory[s]].probe(key[rows], mark[rows])
            often = n >= least_docs
            done = 0
            for part, values, ids, x in held:
                here = slice(done, done + len(x.key))
                done = here.stop
                gone = np.zeros(len(x.text), bool)
                gone[x.keyed] = often[here] & (last[here] != ids[x.text[x.keyed]])
                n_dropped = np.add.reduceat(gone.astype(np.int64), x.first[:-1]) if part.num_rows else np.zeros(0, np.int64)
                text = []
                for k, old in enumerate(values.to_pylist()):
                    if n_dropped[k]:
                        gone_here = gone[x.first[k] : x.first[k + 1]]
                        old = "\n".join([line for line, g in zip(old.split("\n"), gone_here, strict=True) if not g])
                    text.append(old)
                if digest:
                    sha = [hashlib.sha256(t.encode()).hexdigest() for t in text]
                    column = part.column(part.schema.get_field_index("doc_id"))
                    yield pa.record_batch([column, pa.array(x.per_text.astype(np.int64)), pa.array(n_dropped), pa.array(sha)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                else:
                    k = part.schema.get_field_index("text")
                    new = pa.array(text, part.schema.field(k).type)
                    yield pa.RecordBatch.from_arrays([new if i == k else c for i, c in enumerate(part.columns)], schema=part.schema)

    if digest:
        return source.select("doc_id", "text").mapInArrow(probe, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return source.mapInArrow(probe, source.schema)
