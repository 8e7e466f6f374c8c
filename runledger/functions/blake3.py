"""BLAKE3 in its default hash mode, after the published specification, vectorised over the chunks of a message."""

from __future__ import annotations

import numpy as np

# Fixed values of the specification.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_MIXED = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_BLOCK, _CHUNK = 64, 1024
#: Chunks that are mixed together, some megabytes with their copies; a longer message is mixed alone.
CHUNKS = 4096


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The next chaining values (8 x n) of n blocks (16 x n)."""
    n = words.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = chain, _IV[:4, None]
    v[12], v[13] = counter & 0xFFFFFFFF, counter >> 32
    v[14], v[15] = size, flags
    for step in range(7):
        for i, (a, b, c, d) in enumerate(_MIXED):
            v[a] += v[b] + words[2 * i]
            v[d] = _turned(v[d] ^ v[a], 16)
            v[c] += v[d]
            v[b] = _turned(v[b] ^ v[c], 12)
            v[a] += v[b] + words[2 * i + 1]
            v[d] = _turned(v[d] ^ v[a], 8)
            v[c] += v[d]
            v[b] = _turned(v[b] ^ v[c], 7)
        if step < 6:
            words = words[_PERMUTATION]
    return v[:8] ^ v[8:]


def blake3_all(messages: list[bytes]) -> list[str]:
    """The 256-bit hashes of messages as lower-case hexadecimal digits; the chunks of up to CHUNKS of them are mixed together."""
    out: list[str] = []
    first = size = 0
    for i, m in enumerate(messages):
        n = max(1, -(-len(m) // _CHUNK))
        if i > first and size + n > CHUNKS:
            out += _mixed_together(messages[first:i])
            first, size = i, 0
        size += n
    return out + _mixed_together(messages[first:]) if messages else out


def _mixed_together(messages: list[bytes]) -> list[str]:
    lengths = np.array([len(m) for m in messages], np.int64)
    counts = np.maximum(1, -(-lengths // _CHUNK))
    of = np.repeat(np.arange(len(messages)), counts)
    counter = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.minimum(_CHUNK, lengths[of] - counter * _CHUNK)
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    data = b"".join(m.ljust(int(n) * _CHUNK, b"\0") for m, n in zip(messages, counts, strict=True))
    padded = np.frombuffer(data, "<u4").reshape(len(of), 16, 16)
    chain = np.repeat(_IV[:, None], len(of), 1)
    root = np.where(counts[of] == 1, _ROOT, 0)
    for b in range(int(blocks.max())):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = (_START if b == 0 else 0) + np.where(last, _END + root[live], 0)
        size = np.clip(sizes[live] - b * _BLOCK, 0, _BLOCK)
        chain[:, live] = _compress(chain[:, live], padded[live, b].T.astype(np.uint32), counter[live], size.astype(np.uint32), flags.astype(np.uint32))
    while (counts > 1).any():  # pairs from the left; a value left over goes up unchanged
        start, pairs, up = np.cumsum(counts) - counts, counts // 2, -(-counts // 2)
        of = np.repeat(np.arange(len(counts)), pairs)
        left = start[of] + 2 * (np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs))
        flags = np.where(counts[of] == 2, _PARENT | _ROOT, _PARENT).astype(np.uint32)
        words = np.concatenate((chain[:, left], chain[:, left + 1]))
        n = len(left)
        mixed = _compress(np.repeat(_IV[:, None], n, 1), words, np.zeros(n, np.int64), np.full(n, _BLOCK, np.uint32), flags)
        above = np.empty((8, int(up.sum())), np.uint32)
        at = np.cumsum(up) - up
        above[:, at[of] + (left - start[of]) // 2] = mixed
        odd = np.flatnonzero(counts % 2)
        above[:, at[odd] + up[odd] - 1] = chain[:, start[odd] + counts[odd] - 1]
        chain, counts = above, up
    return [c.tobytes().hex() for c in np.ascontiguousarray(chain.T.astype("<u4"))]


def blake3_hex(data: bytes) -> str:
    """The hash of one message."""
    return blake3_all([data])[0]
