"""Words of Arrow text columns as numpy arrays: byte positions, 64-bit hashes, rolling k-word hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LANES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes than this are hashed one by one with BLAKE2b, the others eight bytes at a time all together.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, and the n+1 row offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of every row. at: n+1 offsets into the words, by row."""

    def __init__(self, col: pa.Array, lower: bool = False) -> None:
        data, off = text_bytes(col)
        self.data, n = (LOWER[data] if lower else data), len(data)
        gap = SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        edge[1:] |= gap  # a word may start after a space or a row's edge
        self.starts = np.flatnonzero(edge[:n] & ~gap) if n else np.zeros(0, np.int64)
        edge[:n] = gap
        edge[n] = True
        edge[off] = True  # a word ends before a space or a row's edge
        self.ends = np.flatnonzero(edge[1:] & ~gap) + 1 if n else np.zeros(0, np.int64)
        self.at = np.searchsorted(self.starts, off)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), self.counts())

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: its bytes, eight at a time, each eight mixed into the state before the next.

        lane 1 gives another 64 bits, so that both tell words apart by 128.
        """
        size = self.ends - self.starts
        out = mix(size.astype(np.uint64) * _STEP + _LANES[lane])
        if not len(out):
            return out
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))  # those from each byte on
        at = np.arange(len(out)) if size.max() <= LONG_WORD else np.flatnonzero(size <= LONG_WORD)
        done = 0
        while len(at):
            rest = np.minimum(size[at] - done, 8)
            eight = eights[self.starts[at] + done] & (~np.uint64(0) >> (np.uint64(64) - rest.astype(np.uint64) * np.uint64(8)))
            out[at] = mix((out[at] ^ eight) * _LANES[lane] + np.uint64(done + 1))
            done += 8
            at = at[size[at] > done]
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=16).digest()[8 * lane : 8 * lane + 8], "little")
        return out

    def coded(self) -> np.ndarray:
        """Each word as a number that equal words of these rows share, and no others: told apart by their bytes."""
        size = self.ends - self.starts
        off = np.concatenate([[0], np.cumsum(size)])
        data = pa.py_buffer(np.ascontiguousarray(self.data[~SPACE[self.data]]))
        if off[-1] < 1 << 31:
            words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32)), data])
        else:
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.astype(np.int64)), data])
        return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def extended(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of runs that have one more item each."""
    return mix(h * _STEP + word)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k consecutive items, item by item; those that cross a row are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n]
    for j in range(1, k):
        acc = extended(acc, h[j : j + n])
    return acc


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """As grams(), put together from runs of 1, 2, 4, ... items: for long runs. Another hash than that of grams()."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, acc, done = h, 1, None, 0
    while size <= k:
        if k & size:
            part = power[done : done + n]
            acc = part if acc is None else extended(acc, part)
            done += size
        if 2 * size <= k:
            power = extended(power[:-size], power[size:])
        size *= 2
    return mix(acc + np.uint64(k))


def coded_runs(code: np.ndarray, k: int) -> np.ndarray:
    """Each k consecutive items as a number that equal runs share, and no others. code: from 0 on."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    width = int(code.max()) + 1
    acc, values = code[:n], width
    for j in range(1, k):
        if values * width >= 1 << 62:
            distinct, acc = np.unique(acc, return_inverse=True)
            values = len(distinct)
        acc, values = acc * width + code[j : j + n], values * width
    return acc


def whole(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of the k-item runs lie within one row."""
    return rows[: len(rows) - k + 1] == rows[k - 1 :] if len(rows) >= k else np.zeros(0, bool)
