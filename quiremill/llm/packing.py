"""Packing along a space-filling curve.

Every document's hashed bag of tokens is projected to three dimensions; its place on a Hilbert curve is the sort key.
Documents are range-partitioned by that key and laid end to end along the curve; every `length` tokens a sequence is
full and the document at hand is cut. What is left at a partition's end goes into sequences that are powers of two long,
so that nothing is padded at all. Neighbours on the curve share sequences.

Defined results: a null or empty text is its end id alone. Rows with one id are packed each. Null ids are kept. A range
of the curve is cut by id as well, so copies without number, which share a key, still spread over partitions. Sequence
ids are unique, not dense. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, only, regroup, small_batches, tasks

LENGTH = 4096
END = 2
DIMS = 3
BITS = 16
HASHED = 256
#: Bytes of ids in one partition of the curve.
PART_BYTES = 12 << 20


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of whole-number points (rows), by Skilling's transform."""
    x = [points[:, d].astype(np.int64) for d in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | (((x[d] ^ t) >> b) & 1)
    return key


_PLANE = np.random.Generator(np.random.PCG64(11)).normal(size=(HASHED, DIMS))


def curve_keys(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Hilbert key of each row of ids."""
    rows = len(edges) - 1
    h = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    slot, sign = (h & np.uint64(HASHED - 1)).astype(np.int64), np.where(h & np.uint64(1 << 12), 1.0, -1.0)
    ids = flat & 0xFFFF
    owner = np.repeat(np.arange(rows, dtype=np.int64) * HASHED, np.diff(edges))
    v = np.bincount(owner + slot[ids], weights=sign[ids], minlength=rows * HASHED).reshape(rows, HASHED)
    z = v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12) @ _PLANE
    return hilbert(np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-1.702 * z))).astype(np.int64))


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in regroup(batches, rows=4096):
            flat, edges = e.column(b["text"])
            keys = curve_keys(flat, edges)
            raw, unit = flat.tobytes(), flat.itemsize
            tail = np.array([end], flat.dtype).tobytes()
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(keys), pa.array([raw[unit * x : unit * y] + tail for x, y in zip(edges[:-1], edges[1:])], pa.binary())], names=["id", "key", "ids"])

    return run


class Packer:
    """Takes documents in order and gives pieces: (id, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, length: int, first: int) -> None:
        self.length, self.sequence = length, first
        self.open: list[tuple] = []  # pieces of the sequence at hand, with their ids
        self.used = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            n = min(self.length - self.used, len(ids) - at)
            self.open.append((key, at, ids[at : at + n], len(ids), self.used))
            self.used += n
            at += n
            if self.used == self.length:
                yield from self._close()

    def _close(self) -> Iterator[tuple]:
        for key, at, ids, total, offset in self.open:
            yield key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset
        self.open, self.used = [], 0
        self.sequence += 1

    def finish(self) -> Iterator[tuple]:
        """The rest, in sequences of descending powers of two."""
        rest, left = self.open, self.used
        self.open, self.used = [], 0
        for key, at, ids, total, _ in rest:
            done = 0
            while done < len(ids):
                room = (1 << (left.bit_length() - 1)) - self.used
                n = min(room, len(ids) - done)
                self.open.append((key, at + done, ids[done : done + n], total, self.used))
                self.used += n
                done += n
                if n == room:
                    left -= self.used
                    yield from self._close()


def _packed(length: int, wide: str, kind: pa.DataType):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*pieces))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = Packer(length, TaskContext.get().partitionId() << 36)
        for b in batches:
            out = [x for key, ids in zip(b["id"].to_pylist(), b["ids"].to_pylist()) for x in p.add(key, np.frombuffer(ids, wide))]
            if out:
                yield rows(out)
        out = list(p.finish())
        if out:
            yield rows(out)

    return run


def pack(docs: DataFrame, path: str, *, length: int = LENGTH, end: int = END, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "packing")
    rows = only(docs, id=id, text=text)
    kind = rows.schema["id"].dataType
    ids = scratch.save(rows.mapInArrow(_encoded(path, end), f"id {kind.simpleString()}, key long, ids binary"), "ids")
    total = ids.agg(F.sum(F.octet_length("ids").cast("long") + 16)).first()[0] or 0
    parts = tasks(-(-total // PART_BYTES))
    # copies share a key: the id, and for repeated ids the ids' hash, split them
    tie = F.xxhash64("ids")
    curve = ids.repartitionByRange(parts, "key", "id", tie).sortWithinPartitions("key", "id", tie)
    from pyspark.sql.pandas.types import to_arrow_type

    out = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return curve.mapInArrow(_packed(length, encoder(path).dtype().dtype.str, to_arrow_type(kind)), out)
