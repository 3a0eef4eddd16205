"""Token ids of whole texts with the tokenizers library, cached by space-led chunk.

A byte-level BPE with the usual split pattern never joins a space and the visible character after it to what stands
before them. A text can so be cut before each such space and each chunk encoded by itself. A text in which a space is
followed by further white space is encoded in one go instead. The ids of a chunk that is not in the cache come from the
library: from its model, piece by piece of the split pattern, where all characters are of the common alphabets, else
from its whole encoder. Two generations of chunks are kept, each of a bounded number; the ids are the same either way.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import regex

from .texts import KEPT

CACHE_CHUNKS = 400_000
_RUN = re.compile(r" \s")
# Fixed values of the byte-level scheme: the split pattern, and a byte shown as itself where it is printable, else as
# the next free code point from 256 on.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_SPACE = _VISIBLE[32]
_COMMON = "԰"  # Latin, Greek and Cyrillic letters are below
_encoders: dict[str, "Encoder"] = {}


class _Chunks(dict):
    """Ids by chunk; a missing chunk is looked up in the generation before, or encoded."""

    def __init__(self, encoder: Encoder, old: dict[str, bytes]):
        super().__init__({"": b""})
        self.encoder, self.old = encoder, old

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if max(chunk) < _COMMON and chunk.replace("\n", "").isprintable():
                if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
                    ids = self.encoder.piece(chunk)
                else:
                    pieces = _PIECE.findall(chunk)
                    ids = b"".join([self[x] for x in pieces]) if len(pieces) > 1 else self.encoder.piece(chunk)
            else:
                ids = self.encoder.whole(chunk)
        self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts to arrays of ids, followed by an end id."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.tokenize = self.tokenizer.model.tokenize
        self.pack = [struct.Struct(f"<{n}{'H' if self.kind.itemsize == 2 else 'I'}").pack for n in range(65)]
        self.chunks = _Chunks(self, {})

    def piece(self, piece: str) -> bytes:
        """The ids of what the split pattern leaves in one piece."""
        if not piece.isascii() or "\n" in piece:
            shown = piece.encode().decode("latin-1").translate(_VISIBLE)
        else:
            shown = _SPACE + piece[1:] if piece[0] == " " else piece
        ids = [x.id for x in self.tokenize(shown)]
        return self.pack[len(ids)](*ids) if len(ids) <= 64 else np.array(ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        """The ids of any text."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as little-endian bytes of self.kind."""
        out = []
        for text in texts:
            if len(self.chunks) > CACHE_CHUNKS:
                self.chunks = _Chunks(self, self.chunks)
                self.chunks.old.old = {}
            if _RUN.search(text) or "\0" in text:
                out.append(self.whole(text) + self.end)
            else:
                out.append(b"".join(map(self.chunks.__getitem__, text.replace(" ", "\0 ").split("\0"))) + self.end)
        return out


def _forget() -> None:
    for e in _encoders.values():
        e.chunks = _Chunks(e, {})


KEPT.append(_forget)  # operators that cut texts in slices do not encode


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a process for each path and end id."""
    key = f"{path}:{end_id}"
    if key not in _encoders:
        _encoders[key] = Encoder(path, end_id)
    return _encoders[key]


def small_lists(texts: list[str], most_chars: int = 4_000_000):
    """Ranges of the list that hold about most_chars."""
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) <= most_chars):
            size += len(texts[j])
            j += 1
        yield k, j
        k = j
