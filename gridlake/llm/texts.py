"""Words, hashes and windows of many texts at once, on the bytes of an Arrow string column.

White space is ``[\\x20\\x09-\\x0D]`` and letter case is A-Z only, so every rule works on UTF-8 bytes: no byte of a
longer character is below 0x80. Nulls are taken as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
KEPT: list[Callable[[], None]] = []  # called before a worker's memory is given back
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MARKS = _SPACE.copy()
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), base))))[:n]


def column(values: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large-string array without nulls."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("")
    return values.cast(pa.large_string())


def buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each text begins (one more at the end)."""
    values = column(values)
    _, ends, data = values.buffers()
    at = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """Words of a batch of texts, in order: bytes begin..end, the text of each, hashes, and each text's first word."""

    raw: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of len(texts) + 1
    hashes: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(values: pa.Array, lower: bool, marks: bool = False, hashed: bool = True) -> Words:
    """Split texts into words and hash each. marks: ASCII punctuation separates words too."""
    raw, at = buffers(values)
    if lower:
        raw = _LOWER[raw]
    inside = ~(_MARKS if marks else _SPACE)[raw]
    edge = inside.copy()
    if len(raw):
        edge[1:] &= ~inside[:-1]
        starts = at[:-1][np.diff(at) > 0]
        edge[starts] = inside[starts]  # a text's first byte never continues the text before
    begin = np.flatnonzero(edge)
    stop = np.zeros(len(raw) + 1, bool)
    stop[1:][inside] = True  # after a byte of a word ...
    if len(raw):
        stop[1:-1] &= ~inside[1:]  # ... where no word goes on,
        ends = at[1:][np.diff(at) > 0]
        stop[ends] = inside[ends - 1]  # or the text ends
    end = np.flatnonzero(stop)
    first = np.searchsorted(begin, at)
    return Words(raw, begin, end, first, span_hashes(raw, begin, end) if hashed else np.zeros(0, np.uint64))


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (spans in ascending order); another for another salt."""
    byte = mix(_BYTE + np.uint64(salt)) if salt else _BYTE
    out = np.zeros(len(begin), np.uint64)
    # By blocks, so that powers and sums stay small. A block begins where a span does.
    k = 0
    while k < len(begin):
        j = max(k + 1, int(np.searchsorted(end, begin[k] + 1_000_000, "right")))
        lo, hi = begin[k], end[j - 1]
        n = int(hi - lo)
        power = _powers(_BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte[raw[lo:hi]] * power, out=sums[1:])
        a, b = begin[k:j] - lo, end[k:j] - lo
        back = _powers(_INVERSE, n + 1)
        out[k:j] = mix((sums[b] - sums[a]) * back[a] ^ mix((b - a).astype(np.uint64)))
        k = j
    return out


def windows(w: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, with each window's first word; and each text's first window.

    short: a text of 1 to n - 1 words has one window of all its words.
    """
    per = np.diff(w.first)
    whole = np.maximum(per - n + 1, 0)
    count = np.where((per > 0) & (per < n), 1, whole) if short else whole
    first = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    start = np.arange(first[-1]) - np.repeat(first[:-1] - w.first[:-1], count)
    length = np.repeat(np.minimum(per, n), count)
    out = np.zeros(len(start), np.uint64)
    padded = np.concatenate((w.hashes, np.zeros(n, np.uint64)))
    for k in range(n):
        out = out * _STEP + np.where(k < length, padded[start + k], np.uint64(0))
    return mix(out ^ length.astype(np.uint64)), start, first


def code_points(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points in each span of bytes."""
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=sums[1:])
    return sums[end] - sums[begin]


def give_back() -> None:
    """Return freed memory to the system, and what other operators keep. Workers serve one operator after another; without
    this each keeps the most that any of them had."""
    for forget in KEPT:
        forget()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_slices(batch: pa.RecordBatch, column_name: str, most_bytes: int = 16_000_000):
    """The batch in slices whose texts hold about most_bytes, so that work arrays stay small."""
    give_back()
    texts = column(batch.column(batch.schema.get_field_index(column_name)))
    _, at = buffers(texts)
    k = 0
    while k < len(at) - 1:
        j = max(k + 1, int(np.searchsorted(at, at[k] + most_bytes, "right")) - 1)
        yield batch.slice(k, j - k), texts.slice(k, j - k)
        k = j
    give_back()
