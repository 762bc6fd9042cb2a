"""The words of many texts at once, as codes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BREAK, SPACE = 0x0A, 0x20
CHUNK = 1 << 20  # bytes of text that are cut into words at a time; a longer text is a chunk of its own


def translation(breaks: bytes, spaces: bytes) -> bytes:
    """A table for bytes.translate: A-Z lower-cased, breaks as newlines, spaces as blanks."""
    table = bytearray(bytes(range(256)).lower())
    for b in spaces:
        table[b] = SPACE
    for b in breaks:
        table[b] = BREAK
    return bytes(table)


@dataclass
class Words:
    """The words of a chunk in order: their bytes and ends therein, the text each stands in, and its piece."""

    data: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    piece: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: bytes times odd numbers by position, added up with the length, and mixed."""
        if not len(self):
            return np.zeros(0, np.uint64)
        starts = np.concatenate([[0], self.ends[:-1]])
        sizes = self.ends - starts
        at = np.arange(len(self.data)) - np.repeat(starts, sizes)
        weighted = self.data.astype(np.uint64) * _weights(int(sizes.max()))[at]
        return scrambled(np.add.reduceat(weighted, starts) + sizes.astype(np.uint64) * np.uint64(STEP))

    def spelled(self) -> pa.DictionaryArray:
        """The words themselves, as codes of distinct ones."""
        offsets = np.concatenate([[0], self.ends]).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(self.data)]
        return pa.Array.from_buffers(pa.large_binary(), len(self), buffers).dictionary_encode()


def cut(texts: list[bytes], table: bytes) -> Words:
    """The words of texts; a piece ends at every newline of the translated text and with the text."""
    parts = [t.translate(table) for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    breaks = buf == BREAK
    word = ~(breaks | (buf == SPACE))
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts = edge[::2]
    firsts = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    return Words(
        buf[word],
        np.cumsum(edge[1::2] - starts),
        np.searchsorted(firsts, starts, side="right") - 1,
        np.searchsorted(np.flatnonzero(breaks), starts),
    )


def chunks(column: pa.Array, rows: int = 256, most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of a text column, some `most` bytes at a time; null texts are empty. Few rows of a batch are
    copied at once."""
    first, held, texts = 0, 0, []
    for at in range(0, len(column), rows):
        for t in column.slice(at, rows).cast(pa.large_binary()).to_pylist():
            texts.append(t or b"")
            held += len(texts[-1])
            if held >= most:
                yield first, texts
                first, held, texts = first + len(texts), 0, []
    if texts:
        yield first, texts


STEP = 0x9E3779B97F4A7C15


def scrambled(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers, one to one, so that every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _table(size: int) -> np.ndarray:
    return scrambled(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(STEP)) | np.uint64(1)


def _weights(size: int) -> np.ndarray:
    """Odd numbers for the positions of a word of that size."""
    return _table(max(256, 1 << (size - 1).bit_length()))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in that order."""
    return scrambled(a * np.uint64(STEP) + b)
