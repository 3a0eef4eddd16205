"""Best-fit packing: whole token pieces into as few fixed-capacity sequences as best-fit decreasing gives.

Best-fit decreasing looks only at lengths, and there are at most ``capacity`` of them. So the driver gets a histogram of
lengths - at most ``capacity`` rows, however many documents - and packs whole runs of equal pieces into whole runs of
equal bins. A segment tree over remaining capacities finds the tightest open bin in logarithmic time. The plan is the
exact result of best-fit decreasing over all pieces, as runs ``(length, first rank, bins, pieces a bin, offset)``; its
size is bounded by the square of the capacity, not by the data. Each piece then finds its place from its rank among the
pieces of its length. The task that writes a piece counts those of its length that it wrote before; only counts by task and
length are shuffled, and their running sums lie in a folder for each task. Pieces are neither sorted nor moved, so no
length, however common, is in one task.

Defined results: a null or empty text is one piece with the end id; a longer document than the capacity is cut into
pieces, all full but perhaps the first; repeated rows are pieces of their own; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import filesystem, new_path, table
from .texts import give_back
from .tokens import encoder, small_lists

TASKS_HELD = 64
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
NUMBER = "_chunk long, _nth long"


class CapacityTree:
    """A segment tree of counts of open bins by remaining capacity."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        k = remaining + self.leaves
        while k:
            self.count[k] += n
            k //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds length."""
        k = length + self.leaves
        if self.count[k]:
            return length
        while k > 1:
            if k % 2 == 0 and self.count[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.leaves
            k //= 2
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first bin, pieces a bin, offset in the bin), and the number of bins."""
    tree = CapacityTree(capacity)
    bins: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(remaining: int, first: int, n: int) -> None:
        if remaining and n:
            bins.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                per = capacity // length
                room, first, n = capacity, opened, -(-left // per)
                opened += n
            else:
                per = room // length
                first, n = bins[room].pop()
                tree.add(room, -n)
            full, rest = min(n, left // per), 0
            if full < n:
                rest = left - full * per
            runs.append((length, rank, first, per, capacity - room))
            put(room - per * length, first, full)
            if full < n:
                used = full
                if rest:
                    put(room - rest * length, first + full, 1)
                    used += 1
                if room < capacity:
                    put(room, first + used, n - used)
            rank += full * per + rest
            left -= full * per + rest
    return np.array(runs, np.int64).reshape(-1, 5), opened


def _cutter(tokenizer: str, end_id: int, capacity: int):
    """A function from batches of ids and texts to batches of PIECE."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = batch.column(0).to_pylist()
            for a, b in small_lists(texts):
                out: list[tuple] = []
                for doc_id, data in zip(ids[a:b], encode.encode(texts[a:b]), strict=True):
                    values = np.frombuffer(data, encode.kind).astype("<u4")
                    n = len(values)
                    head = n - (-(-n // capacity) - 1) * capacity
                    for k, end in enumerate(range(head, n + 1, capacity)):
                        begin = end - capacity if k else 0
                        out.append((doc_id, k, begin, end - begin, zlib.crc32(values[begin:end])))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's token pieces: doc_id, piece, start, length, ids_crc32."""
    return _texts(docs, id_col, text_col).mapInArrow(_cutter(tokenizer, end_id, capacity), PIECE)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the task's number, and how many rows of the same length the task had before."""
    chunk, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length")).fill_null(0).to_numpy(zero_copy_only=False)
        order = np.argsort(length, kind="stable")
        values, first, n = np.unique(length[order], return_index=True, return_counts=True)
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) + np.repeat(np.array([seen.get(v, 0) for v in values.tolist()], np.int64) - first, n)
        for v, k in zip(values.tolist(), n.tolist(), strict=True):
            seen[v] = seen.get(v, 0) + k
        yield pa.record_batch([*batch.columns, pa.array(np.full(len(length), chunk, np.int64)), pa.array(nth)], names=[*batch.schema.names, "_chunk", "_nth"])


def _schema(kinds: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """Give each row of items (with a column length of 1 to capacity) a sequence_id and an offset.

    items is read once, so it may be a plan; no columns of it may be named _chunk or _nth.
    """
    return _place(table(items.mapInArrow(_number, f"{_schema(items.schema)}, {NUMBER}"), "pieces"), capacity)


def _place(numbered: DataFrame, capacity: int) -> DataFrame:
    """pack() for a table of items that _number() has numbered while it was written."""
    spark = numbered.sparkSession
    names = [x for x in numbered.columns if x not in ("_chunk", "_nth")]
    histogram = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    if any(not 0 < (x or 0) <= capacity for x in histogram):
        raise ValueError("a length is null, below 1 or above the capacity")
    runs, _ = best_fit_decreasing(histogram, capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("length", F.col("_chunk").alias("chunk")).agg(F.count("*").alias("n"))
    sums = counts.select("chunk", F.col("length").cast("long").alias("length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = new_path(spark, "before")
    sums.repartition("chunk").write.partitionBy("chunk").parquet(at)
    plan = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # no text is encoded from here on
        runs = plan.value
        # Structured keys: the last run of this length that begins at or before the rank.
        lengths, first_of = np.unique(runs[:, 0], return_index=True)
        last_of = np.append(first_of[1:], len(runs))
        files, folder = filesystem(at)
        held: dict[int, np.ndarray] = {}

        def earlier(chunk: int) -> np.ndarray:
            """By length, the rows of tasks before this one."""
            if chunk not in held:
                if len(held) >= TASKS_HELD:
                    held.clear()
                found = pq.read_table(f"{folder}/chunk={chunk}", filesystem=files, columns=["length", "before"])
                held[chunk] = np.zeros(capacity + 1, np.int64)
                held[chunk][found["length"].to_numpy()] = found["before"].to_numpy()
            return held[chunk]

        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()  # noqa: B023, E731
            length, chunk, rank = column("length"), column("_chunk"), column("_nth").copy()
            for c in np.unique(chunk).tolist():
                rows = chunk == c
                rank[rows] += earlier(c)[length[rows]]
            at_run = np.zeros(len(rank), np.int64)
            group = np.searchsorted(lengths, length)
            for g in np.unique(group):
                rows = group == g
                at_run[rows] = first_of[g] + np.searchsorted(runs[first_of[g] : last_of[g], 1], rank[rows], "right") - 1
            run = runs[at_run]
            k = rank - run[:, 1]
            sequence, offset = run[:, 2] + k // run[:, 3], run[:, 4] + k % run[:, 3] * length
            yield pa.record_batch([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = _schema(numbered.select(*names).schema)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Tokenize, cut and pack documents: a row for each piece with its sequence and offset."""
    cut = _cutter(tokenizer, end_id, capacity)
    numbered = _texts(docs, "doc_id", "text").mapInArrow(lambda batches: _number(cut(batches)), f"{PIECE}, {NUMBER}")
    return _place(table(numbered, "pieces"), capacity)
