"""Texts as arrays: blocks of Arrow string columns cut into words with numpy, without a Python step per word.

A block holds some megabytes, so memory is bounded whatever a batch holds; a single longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_CHARS = 2_000_000


def blocks(batch: pa.RecordBatch, column: int, most: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows with at most `most` characters together, or a single row."""
    texts = batch.column(column).to_pylist()
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if size + n > most and i > first:
            yield first, texts[first:i]
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, texts[first:]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, as a new array."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


@cache
def letters() -> np.ndarray:
    """True at the code points that are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Letters:
    """The runs of letters of lower-cased texts: `code` holds code points, `start`, `size` and `doc` a value for each run."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").lower() for t in texts]
        self.n_docs = len(parts)
        self.code = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.zeros(self.n_docs + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=at[1:])
        self.at = at
        inside = letters()[self.code]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.start = edges[::2]
        self.size = edges[1::2] - self.start  # the last code point is a line end
        self.doc = np.searchsorted(at, self.start, "right") - 1

    def hashes(self) -> np.ndarray:
        return hash_runs(self.code, self.start, self.size)


def hash_runs(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each run of code points."""
    h = np.full(len(start), 0x9E3779B97F4A7C15, np.uint64)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        h[live] = (h[live] ^ code[start[live] + k]) * np.uint64(0x100000001B3) + np.uint64(0x632BE59BD9B4E019)
        k += 1
        live = live[size[live] > k]
    return mix(h)


def hash_words(words: list[str]) -> np.ndarray:
    """`hash_runs` of whole words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return hash_runs(code, np.cumsum(size) - size, size)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, found) of each wanted value in the sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts with A-Z in lower case: `start`, `size` and `doc` in the bytes `data`."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.n_docs = len(parts)
        data = np.frombuffer(b"\n".join(parts) + b"\n" + bytes(8), np.uint8)  # eight bytes more, so that words can be read by eights
        self.data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        at = np.zeros(self.n_docs + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=at[1:])
        inside = ~_WHITE[self.data[:-8]]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        self.start = edges[::2]
        self.size = edges[1::2] - self.start
        self.doc = np.searchsorted(at, self.start, "right") - 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        eights = np.ndarray(len(self.data) - 7, np.uint64, self.data, strides=(1,))
        h = mix(self.size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        live, k = np.arange(len(self.start)), 0
        while len(live):
            left = self.size[live] - k
            h[live] = mix(h[live] ^ (eights[self.start[live] + k] & _MASKS[np.minimum(left, 8)]))
            live = live[left > 8]
            k += 8
        return h


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as the byte planes of their differences, which compress well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as the byte planes of unsigned 64-bit numbers."""
    return counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def part_slices(keys: np.ndarray, bits: int, parts: int) -> list[tuple[int, slice]]:
    """(part, its slice) of sorted keys of `bits` bits that are dealt by range to `parts` parts, without empty parts."""
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate((np.ones(len(part[:1]), bool), part[1:] != part[:-1])))
    return [(int(part[a]), slice(a, b)) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False)]
