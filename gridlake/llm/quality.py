"""Quality rules as a short-circuit cascade.

Word statistics of a text are counted once, on the bytes of its column. The rules after them are tried in the order of
rejections per second that a bounded sample shows, each only on the documents that all earlier rules kept, whose bytes
alone it reads. The order changes the cost, never the verdict: a document is kept when every rule keeps it.

The sample is drawn from at most SAMPLE_PARTS partitions, spread over the table; of each, the rows with the least text
hashes, up to a number of rows and of bytes (a text that alone has more is passed over). Its cost does not grow with the
table, and no more than SAMPLE_PARTS * SAMPLE_BYTES come to the driver.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: a null or empty text has no words, all counts 0, and fails; rows
are judged one by one, so repeated rows and null ids are as any other; further columns stay as they are where whole rows
are asked for; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts

LEAST_WORDS = 50
SAMPLE_PARTS, SAMPLE_ROWS, SAMPLE_BYTES = 8, 250, 1_000_000  # rows and bytes of each partition
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, bool)
_BREAK[10] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Batch:
    """A batch's bytes, words and base counts."""

    raw: np.ndarray
    at: np.ndarray
    w: texts.Words
    stats: dict[str, np.ndarray]

    def flagged(self, flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many bytes of each of some texts have a flag; no other text is read."""
        return np.array([np.count_nonzero(flags[self.raw[self.at[r] : self.at[r + 1]]]) for r in rows], np.int64)


def _sum_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def _repeats(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one in their group, and which have an equal one before them."""
    order = np.lexsort((np.arange(len(keys)), keys, group))
    same = np.zeros(len(keys), bool)
    later = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = (keys[order][1:] == keys[order][:-1]) & (group[order][1:] == group[order][:-1])
        later[order[1:]] = equal
        same[order[1:]] = equal
        same[order[:-1]] |= equal
    return same, later


def count(values: pa.Array) -> Batch:
    """The base counts of each text."""
    raw, at = texts.buffers(values)
    w = texts.words(values, lower=False)
    n = np.diff(w.first)
    text = w.text_of()
    chars = texts.code_points(raw, w.begin, w.end)
    # Lines with a word; equal lines have equal bytes.
    breaks = np.flatnonzero(raw == 10)
    bounds = np.unique(np.concatenate((at, breaks + 1)))
    begin = bounds[:-1]
    end = bounds[1:].copy()
    closed = np.zeros(len(raw) + 1, bool)
    closed[breaks + 1] = True
    end -= closed[end]
    filled = np.searchsorted(w.begin, begin) < np.searchsorted(w.begin, end)
    begin, end = begin[filled], end[filled]
    owner = np.searchsorted(at, begin, "right") - 1
    _, later = _repeats(texts.span_hashes(raw, begin, end), owner)
    dup = np.bincount(owner[later], minlength=len(values))
    # Words in windows of three that are found again in the text.
    h, start, first = texts.windows(w, 3, short=False)
    same, _ = _repeats(h, np.repeat(np.arange(len(values)), np.diff(first)))
    covered = np.zeros(len(w.begin) + 3, bool)
    for k in range(3):
        covered[start[same] + k] = True
    return Batch(raw, at, w, {
        "n_words": n, "word_chars": _sum_by(w.first, chars), "n_symbols": _sum_by(at, _SYMBOL[raw].astype(np.int64)), "n_dup_lines": dup,
        "n_repeat_words": np.bincount(text[covered[: len(text)]], minlength=len(values)),
    })


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


#: Name and rule: of some rows of a batch, which are rejected. Thresholds leave wide room for ordinary prose.
Rule = Callable[[Batch, np.ndarray], np.ndarray]


def _symbols(b: Batch, rows: np.ndarray) -> np.ndarray:
    return b.stats["n_symbols"][rows] > 0.5 * b.stats["n_words"][rows]


def _dup_lines(b: Batch, rows: np.ndarray) -> np.ndarray:
    lines = 1 + b.flagged(_BREAK, rows)
    return b.stats["n_dup_lines"][rows] > 0.5 * lines


def _word_length(b: Batch, rows: np.ndarray) -> np.ndarray:
    mean = b.stats["word_chars"][rows] / np.maximum(b.stats["n_words"][rows], 1)
    return (mean < 2) | (mean > 20)


def _digits(b: Batch, rows: np.ndarray) -> np.ndarray:
    return b.flagged(_DIGIT, rows) > 0.5 * np.maximum(b.stats["word_chars"][rows], 1)


def _marks(b: Batch, rows: np.ndarray) -> np.ndarray:
    return b.flagged(_MARK, rows) > 0.4 * np.maximum(b.stats["word_chars"][rows], 1)


def _same_word(b: Batch, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k, r in enumerate(rows):
        h = b.w.hashes[b.w.first[r] : b.w.first[r + 1]]
        out[k] = len(h) > 0 and np.unique(h, return_counts=True)[1].max() > 0.4 * len(h)
    return out


RULES: dict[str, Rule] = {"same_word": _same_word, "marks": _marks, "digits": _digits, "dup_lines": _dup_lines, "word_length": _word_length, "symbols": _symbols}


def sample(docs: DataFrame) -> list[str]:
    """A bounded sample of texts from a few partitions, without running the others."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, str]] = []
        size = seen = 0
        for batch in batches:
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, seen = len(text) * 4, seen + 1
                if n > SAMPLE_BYTES or (len(held) == SAMPLE_ROWS and -held[0][0] <= h):
                    continue
                heapq.heappush(held, (-h, seen, text))
                size += n
                while len(held) > SAMPLE_ROWS or size > SAMPLE_BYTES:
                    size -= 4 * len(heapq.heappop(held)[2])
        yield pa.record_batch([pa.array([x[2] for x in held], pa.string())], names=["text"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(least, "text string").rdd
    n = rows.getNumPartitions()
    chosen = sorted({k * n // SAMPLE_PARTS for k in range(SAMPLE_PARTS)}) if n else []
    return [r["text"] for r in docs.sparkSession.sparkContext.runJob(rows, list, chosen)] if chosen else []


def rule_order(docs: DataFrame, rules: dict[str, Rule]) -> list[str]:
    """The rules by rejections per second on a sample; each is timed on all sampled rows."""
    rows = sample(docs)
    if not rows:
        return list(rules)
    b = count(texts.column(pa.array(rows, pa.string())))
    all_rows = np.arange(len(rows))
    rate = {}
    for name, rule in rules.items():
        began = time.thread_time()
        out = int(rule(b, all_rows).sum())
        rate[name] = (out + 0.5) / (len(rows) + 1) / max(time.thread_time() - began, 1e-6)
    return sorted(rules, key=lambda k: -rate[k])


def judge(docs: DataFrame, rules: dict[str, Rule] | None = None, rows: bool = False) -> DataFrame:
    """doc_id with counts and verdict of each document; rows: the documents that are kept, as they were."""
    rules = RULES if rules is None else rules
    order = rule_order(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in texts.text_slices(batch, "text", 4_000_000):
                b = count(values)
                failed = base_failed(b.stats)
                left = np.flatnonzero(~failed)
                for name in order:
                    if len(left):
                        left = left[~rules[name](b, left)]
                kept = np.zeros(len(values), bool)
                kept[left] = True
                if rows:
                    yield part.filter(pa.array(kept))
                    continue
                ids = part.column(part.schema.get_field_index("doc_id")).cast(pa.int64())
                columns = [ids, *(pa.array(b.stats[k].astype(np.int64)) for k in STATS), pa.array(failed), pa.array(kept)]
                yield pa.record_batch(columns, names=["doc_id", *STATS, "base_failed", "kept"])

    if rows:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS) + ", base_failed boolean, kept boolean")
