"""Benchmark decontamination with spaced seeds.

A mask of four words ignores the places between them, so a seed survives substitutions there. The three masks together
hit every way to have 75 % of 8 to 24 words equal (the tests try all of them), so no item that the check below accepts is
missed. Every benchmark item's seeds (items below 6 words have one of all their words) go into sorted arrays with item
and place; documents are hashed the same way and searched in those arrays, which is the join. Tasks over the benchmark
write the arrays as block files of bounded size to the shared folder; one pass over the documents hashes each text once
and searches it in every block. Blocks on a local file system are mapped, so tasks of a machine share their pages; others
are read into a cache of bounded size. Nothing of the benchmark comes to the driver but the names of the blocks. Around
each hit, in the text that holds it, the words within a window's reach are compared; where enough are equal, the item is
laid over the whole text on the hit's diagonal and words are compared one by one, so substitutions cost their words only.

Words are runs of bytes other than white space and ASCII punctuation, with A-Z in lower case. An item is in a document
where, in some window of min(its words, 24), at least 75 % of the words agree (all of them for items below 8 words).

Defined results: a null or empty text has no overlaps; null or empty items never match; rows that share an id are each
judged and reported; a very long text or item is a slice or block by itself; of equal overlaps with an item the first
diagonal counts; further columns are ignored or kept, whatever their names; empty tables give no overlaps.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts
from .shared import Mapped, SharedFile, new_path, pack_arrays, table, unpack_arrays

# Fixed masks. Each begins and ends with a place that counts; together they hit all that WINDOW and SHARE accept.
MASKS = ("10111", "111001", "1001011")
SHORT = 6  # an item below it is one contiguous seed
WHOLE = 8  # an item below it must be there word for word
WINDOW = 24
SHARE = 0.75
SEEDS_AT_ONCE = 1_000_000  # of a block, 16 bytes each
SLICE_BYTES = 8_000_000
CACHED_BYTES = 64_000_000  # of blocks that cannot be mapped
HITS_AT_ONCE = 20_000  # each is compared on some 50 words
OVERLAP = "doc_id long, item_id long, n_equal int, n_words int, first_word int"


def _places(masks: tuple[str, ...]) -> list[np.ndarray]:
    return [np.flatnonzero(np.frombuffer(m.encode(), np.uint8) == 49) for m in masks]


def _masks(words: int) -> list[np.ndarray]:
    """Masks for an item; one below SHORT words is one contiguous seed."""
    return [np.arange(words)] if words < SHORT else _places(MASKS)


def _seeds(hashes: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The masked hash at each place where the mask fits."""
    n = len(hashes) - int(mask[-1])
    out = np.full(max(n, 0), np.uint64(len(mask)))
    for k in mask:
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + max(n, 0)] * np.uint64(2 * int(k) + 1)
    return texts.mix(out)


class Items:
    """A block of benchmark items and the sorted seeds of all of them."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray]):
        self.ids = ids
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.words = np.concatenate(hashes)
        rows = [(s, np.full(len(s), k), np.arange(len(s))) for k, h in enumerate(hashes) for mask in _masks(len(h)) for s in [_seeds(h, mask)]]
        seed = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.item = np.concatenate([r[1] for r in rows])[order].astype(np.int32) if rows else np.zeros(0, np.int32)
        self.place = np.concatenate([r[2] for r in rows])[order].astype(np.int32) if rows else np.zeros(0, np.int32)
        self._derive()

    ARRAYS = ("ids", "size", "words", "seed", "item", "place")

    def to_bytes(self) -> bytes:
        return pack_arrays([np.asarray(getattr(self, k), np.int64) if k == "ids" else getattr(self, k) for k in self.ARRAYS])

    @classmethod
    def from_bytes(cls, data: pa.Buffer) -> Items:
        """Views of the bytes."""
        self = cls.__new__(cls)
        for name, value in zip(cls.ARRAYS, unpack_arrays(data), strict=True):
            setattr(self, name, value)
        self._derive()
        return self

    def _derive(self) -> None:
        self.begin = np.cumsum(self.size) - self.size
        self.width = np.minimum(self.size, WINDOW)
        self.need = np.where(self.size < WHOLE, self.width, np.ceil(self.width * SHARE)).astype(np.int64)
        sizes = set(self.size.tolist())
        self.masks = [*(_places(MASKS) if max(sizes) >= SHORT else []), *(np.arange(n) for n in sorted(sizes) if n < SHORT)]

    def hits(self, w: texts.Words) -> np.ndarray:
        """Text, item and diagonal (document place less item place) of the seed hits that may be matches, each once."""
        found = [np.zeros((0, 3), np.int64)]
        for mask in self.masks:
            seed = _seeds(w.hashes, mask)
            low = np.searchsorted(self.seed, seed)
            at = np.flatnonzero(self.seed[np.minimum(low, len(self.seed) - 1)] == seed) if len(self.seed) else np.zeros(0, int)
            text = np.searchsorted(w.first, at, "right") - 1
            own = at + mask[-1] < w.first[text + 1]  # a seed over two texts is none
            at, text = at[own], text[own]
            low = low[at]
            n = np.searchsorted(self.seed, seed[at], "right") - low
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(n) // HITS_AT_ONCE)) + 1):
                many = n[part]
                k = np.repeat(low[part], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                where, of = np.repeat(at[part], many), np.repeat(text[part], many)
                item, place = self.item[k], self.place[k]
                near = self._near(item, place, w, where, of)
                found.append(np.unique(np.stack((of, item, where - place), axis=1)[near], axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def _near(self, item: np.ndarray, place: np.ndarray, w: texts.Words, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Whether the windows that can hold a hit have as many equal words together as one of them needs."""
        equal = np.zeros(len(item), np.int64)
        for k in range(1 - WINDOW, WINDOW):
            p, d = place + k, at + k
            inside = (p >= 0) & (p < self.size[item]) & (d >= w.first[text]) & (d < w.first[text + 1])
            equal[inside] += self.words[(self.begin[item] + p)[inside]] == w.hashes[d[inside]]
        return equal >= self.need[item]

    def overlap(self, item: int, hashes: np.ndarray, diagonal: int) -> tuple[int, int] | None:
        """Equal words in the best window on the diagonal, and the window's words; None where they are too few."""
        own = self.words[self.begin[item] : self.begin[item] + self.size[item]]
        low, high = max(0, -diagonal), min(len(own), len(hashes) - diagonal)
        width = int(self.width[item])
        if high - low < width * SHARE:
            return None
        equal = np.zeros(len(own) + 1, np.int64)
        equal[low + 1 : high + 1] = own[low:high] == hashes[low + diagonal : high + diagonal]
        sums = np.cumsum(equal)
        best = int((sums[width:] - sums[: len(sums) - width]).max())
        return (best, width) if best >= self.need[item] else None


def item_blocks(benchmark: DataFrame) -> list[str]:
    """The benchmark as files of items with their seeds, each of a bounded number of seeds or of one item."""
    spark = benchmark.sparkSession
    folder = new_path(spark, "benchmark-seeds")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        hashes: list[np.ndarray] = []
        size, names = 0, []

        def write() -> None:
            file = SharedFile(f"{folder}/seeds-{uuid.uuid4().hex}.bin")
            file.stream.write(Items(ids, hashes).to_bytes())
            file.close()
            names.append(f"{folder}/{os.path.basename(file.path)}")

        for batch in batches:
            for part, values in texts.text_slices(batch, "text", 1_000_000):
                w = texts.words(values, lower=True, marks=True)
                for k, item_id in enumerate(part.column(0).to_pylist()):
                    own = w.hashes[w.first[k] : w.first[k + 1]]
                    if item_id is None or not len(own):
                        continue
                    ids.append(item_id)
                    hashes.append(own)
                    size += len(own) * len(MASKS)
                    if size >= SEEDS_AT_ONCE:
                        write()
                        ids, hashes, size = [], [], 0
        if ids:
            write()
        yield pa.record_batch([pa.array(names, pa.string())], names=["file"])

    # Whole blocks from few tasks: Spark packs small files together, and a benchmark's partitions are few.
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return sorted(r["file"] for r in table(rows.hint("rebalance").mapInArrow(store, "file string"), "benchmark-blocks").collect())


def _judge(items: Items, w: texts.Words) -> list[tuple[int, int, int, int, int]]:
    """(text, item, equal, words, first word) of each overlap in a batch."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for t, i, d in items.hits(w).tolist():
        a, b = int(w.first[t]), int(w.first[t + 1])
        found = items.overlap(i, w.hashes[a:b], d - a)
        if found and found > best.get((t, i), (0, 0, 0))[:2]:
            best[t, i] = (*found, max(d - a, 0))
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it contains."""
    blocks = item_blocks(benchmark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Mapped(Items.from_bytes, CACHED_BYTES)
        for batch in batches:
            for part, values in texts.text_slices(batch, "text", SLICE_BYTES):
                w = texts.words(values, lower=True, marks=True)
                ids = part.column(0).to_pylist()
                for name in blocks:
                    items = opened[name]
                    rows = _judge(items, w)
                    if rows:
                        columns = list(zip(*((ids[t], int(items.ids[i]), n, of, at) for t, i, n, of, at in rows), strict=True))
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "n_equal", "n_words", "first_word"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, OVERLAP)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns."""
    blocks = item_blocks(benchmark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = Mapped(Items.from_bytes, CACHED_BYTES)
        for batch in batches:
            for part, values in texts.text_slices(batch, "text", SLICE_BYTES):
                w = texts.words(values, lower=True, marks=True)
                good = np.ones(part.num_rows, bool)
                for name in blocks:
                    good[[r[0] for r in _judge(opened[name], w)]] = False
                yield part.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
