"""Whole pages over Arrow batches: rows of a page travel as lists, and a step sees many pages at once as flat arrays.

Stretches of one page are packed where they lie, so that a shuffle carries a few rows a page and nothing sorts single
words. A page that lies in several places is put together after the shuffle, whatever their number.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spare

#: Bytes of an Arrow batch on its way to Python: rows are whole pages by then.
BATCH_BYTES = 8 << 20
#: Bytes of flat columns that a step sees at once; a page is never parted.
STEP_BYTES = 8 << 20


class Pages:
    """Items of whole pages: page counts from 0 for each item, heads are the keys of each page, cols the flat columns,
    wanted says which pages are (all, where nothing was asked for)."""

    def __init__(self, page: np.ndarray, heads: list[pa.Array], cols: dict[str, pa.Array], wanted: np.ndarray | None = None) -> None:
        self.page, self.heads, self.cols, self.wanted = page, heads, cols, wanted
        self.n = len(heads[0])

    def numbers(self, name: str) -> np.ndarray:
        """A column as floats; null is NaN."""
        return np.asarray(self.cols[name].cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)

    def flags(self, name: str) -> np.ndarray:
        return np.asarray(pc.fill_null(self.cols[name], False).to_numpy(zero_copy_only=False), bool)

    def ints(self, name: str) -> np.ndarray:
        return np.asarray(pc.fill_null(self.cols[name].cast(pa.int64()), 0).to_numpy(zero_copy_only=False), np.int64)

    def codes(self, name: str) -> np.ndarray:
        """One number for each (page, text); null is a text of its own."""
        d = self.cols[name].dictionary_encode("encode")
        return self.page * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def per_page(self, weights: np.ndarray) -> np.ndarray:
        """Sums of whole numbers."""
        out = np.zeros(self.n, np.int64)
        np.add.at(out, self.page, weights)
        return out


def _flat(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _new(keys: list[pa.Array]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; nulls are equal."""
    n = len(keys[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for k in keys:
        a, b = k.slice(1), k.slice(0, max(0, n - 1))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= np.asarray(differ.to_numpy(zero_copy_only=False), bool)
    return out


def _codable(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind)


def _steps(v: np.ndarray, start: np.ndarray, exclusive: bool = False) -> np.ndarray:
    """Each number less the one before on its page, in as few bytes as the largest needs; exclusive: bits that differ."""
    d = v.copy()
    d[1:] = v[1:] ^ v[:-1] if exclusive else v[1:] - v[:-1]
    d[start] = v[start]
    low, high = int(d.min()), int(d.max())
    return d.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _coded(col: pa.Array, start: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray | None]]]:
    """(code, parts) of a column: numbers as steps, texts as lengths and bytes. A part is an array, with places of its own
    for the pages if it has not one value an item. code: 1 where bits differ, 2 where a part tells nulls, 4 times the bytes of a step."""
    some = None
    if col.null_count:
        some = np.asarray(col.is_valid().to_numpy(zero_copy_only=False), np.uint8)
    parts: list[tuple[np.ndarray, np.ndarray | None]] = [(some, None)] if some is not None else []
    code = 2 if some is not None else 0
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        t = pc.fill_null(col, "") if col.null_count else col
        at = np.frombuffer(t.buffers()[1], np.int64 if pa.types.is_large_string(t.type) else np.int32)[t.offset : t.offset + len(t) + 1].astype(np.int64)
        steps = _steps(np.diff(at), start)
        raw = t.buffers()[2]
        parts += [(steps, None), (np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, np.uint8), at - at[0])]
        return code + 4 * steps.itemsize, parts
    if pa.types.is_floating(col.type):
        f = np.asarray(pc.fill_null(col.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), np.float64)
        with np.errstate(invalid="ignore"):
            v = f.astype(np.int64)
        code += int(not np.array_equal(v.astype(np.float64).view(np.int64), f.view(np.int64)))
        v = f.view(np.int64) if code & 1 else v
    elif pa.types.is_boolean(col.type):
        v = np.asarray(pc.fill_null(col, False).to_numpy(zero_copy_only=False), np.int64)
    else:
        v = pc.fill_null(col, pa.scalar(0, col.type)).to_numpy(zero_copy_only=False).astype(np.int64)
    steps = _steps(v, start, bool(code & 1))
    return code + 4 * steps.itemsize, [*parts, (steps, None)]


def _pack(keys: list[str], coded: list[str], lists: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for b in batches:
            if not b.num_rows:
                continue
            start = np.flatnonzero(_new([b[k] for k in keys]))
            ends = np.append(start, b.num_rows)
            codes, views, size = [], [], np.diff(ends) * (8 * len(coded))
            for c in coded:
                code, parts = _coded(b[c], start)
                codes.append(code)
                for v, at in parts:
                    places = (ends if at is None else at[ends]) * v.itemsize
                    views.append((v.tobytes(), places.tolist()))
                    size = size + (np.diff(places) if at is not None else 0)
            head = bytes(codes)
            blobs = []
            for i, n in enumerate(np.diff(ends).tolist()):
                raw = b"".join([v[at[i] : at[i + 1]] for v, at in views])
                blobs.append(struct.pack("<II", n, len(raw)) + head + (codec.compress(raw, asbytes=True) if raw else b""))
            offsets = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[b[k].take(pa.array(start)) for k in keys], *[pa.ListArray.from_arrays(offsets, b[c]) for c in lists], pa.array(size, pa.int64()), pa.array(blobs, pa.binary())], names=names)

    return run


def _decoded(blobs: list[bytes], kinds: list[pa.DataType]) -> tuple[np.ndarray, list[pa.Array]]:
    """(items of each blob, columns)."""
    codec = pa.Codec("zstd")
    counts = np.zeros(len(blobs), np.int64)
    codes = np.zeros((len(kinds), len(blobs)), np.int64)
    known: list[list[bytes]] = [[] for _ in kinds]
    steps: list[list[np.ndarray]] = [[] for _ in kinds]
    texts: list[list[bytes]] = [[] for _ in kinds]
    for i, blob in enumerate(blobs):
        n, size = struct.unpack_from("<II", blob)
        counts[i] = n
        raw = codec.decompress(memoryview(blob)[8 + len(kinds) :], size, asbytes=True) if size else b""
        at = 0
        for j, kind in enumerate(kinds):
            code = blob[8 + j]
            codes[j, i] = code
            if code & 2:
                known[j].append(raw[at : at + n])
                at += n
            else:
                known[j].append(b"\1" * n)
            width = code >> 2
            d = np.frombuffer(raw, f"<i{width}", n, at)
            steps[j].append(d)
            at += n * width
            if pa.types.is_string(kind) or pa.types.is_large_string(kind):
                length = int(np.cumsum(d, dtype=np.int64).sum())
                texts[j].append(raw[at : at + length])
                at += length
    first = np.cumsum(counts) - counts
    out = []
    for j, kind in enumerate(kinds):
        d = np.concatenate(steps[j]).astype(np.int64) if steps[j] else np.empty(0, np.int64)
        bits = np.repeat((codes[j] & 1).astype(bool), counts)
        v = _sums(np.where(bits, 0, d), first, counts)
        if bits.any():
            x = np.bitwise_xor.accumulate(np.where(bits, d, 0))
            x ^= np.repeat(x[first] ^ np.where(bits, d, 0)[first], counts)
        none = None
        if (codes[j] & 2).any():
            none = np.frombuffer(b"".join(known[j]), np.uint8) == 0
        if pa.types.is_string(kind) or pa.types.is_large_string(kind):
            wide = pa.types.is_large_string(kind)
            at = np.concatenate([[0], np.cumsum(v)]).astype(np.int64 if wide else np.int32)
            valid = pa.array(~none).buffers()[1] if none is not None else None
            out.append((pa.LargeStringArray if wide else pa.StringArray).from_buffers(len(v), pa.py_buffer(at), pa.py_buffer(b"".join(texts[j])), valid))
            continue
        if pa.types.is_floating(kind):
            v = v.astype(np.float64)
            if bits.any():
                v[bits] = x.view(np.float64)[bits]
        elif pa.types.is_boolean(kind):
            v = v.astype(bool)
        elif kind == pa.uint64():
            v = v.view(np.uint64)
        out.append(pa.array(v, mask=none, from_pandas=False).cast(kind))
    return counts, out


def _sums(d: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums of steps, anew from each first."""
    v = np.cumsum(d)
    return v - np.repeat(v[first] - d[first], counts)


def _unpack(keys: list[str], kinds: dict[str, pa.DataType], lists: list[str], names: tuple[str, str, str], step: Callable[[Pages], dict[str, pa.Array]], schema: pa.Schema):
    size, pack, mark = names

    def done(t: pa.Table) -> pa.RecordBatch:
        heads = [_flat(t[k]) for k in keys]
        new = _new(heads)
        page = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        packed = np.flatnonzero(np.asarray(t[pack].is_valid().to_numpy(), bool))
        lens, cols = _decoded(t[pack].take(pa.array(packed)).to_pylist(), list(kinds.values()))
        flat = {**dict(zip(kinds, cols)), **{c: pc.list_flatten(_flat(t[c])) for c in lists}}
        wanted = np.ones(len(first), bool)
        if mark in t.column_names:
            wanted = np.logical_or.reduceat(np.asarray(pc.fill_null(_flat(t[mark]), False).to_numpy(zero_copy_only=False), bool), first)
        out = step(Pages(np.repeat(page[packed], lens), [h.take(pa.array(first)) for h in heads], flat, wanted))
        return pa.RecordBatch.from_arrays([_flat(out[f.name]).cast(f.type) for f in schema], schema=schema)

    def parts(t: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pages from start on, so many at once as STEP_BYTES holds."""
        before = np.concatenate([[0], np.cumsum(pc.fill_null(_flat(t[size]), 0).to_numpy())])
        ends = np.append(start, t.num_rows)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(before[ends], before[start[i]] + STEP_BYTES, "right")) - 1)
            yield done(t.slice(start[i], ends[j] - start[i]).combine_chunks())
            i = j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            start = np.flatnonzero(_new([_flat(t[k]) for k in keys]))
            if len(start) > 1:  # the last page may go on in the next batch
                yield from parts(t.slice(0, start[-1]), start[:-1])
                held = t.slice(start[-1]).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield from parts(t, np.flatnonzero(_new([_flat(t[k]) for k in keys])))

    return run


def pagewise(items: DataFrame, keys: list[str], cols: list[str], step: Callable[[Pages], dict[str, pa.Array]], schema: T.StructType, wanted: DataFrame | None = None, small: bool = False) -> DataFrame:
    """step over all pages (keys) of items, whose other columns are cols: it returns the columns of schema.

    A page's numbers, flags and texts are one compressed value on the way; columns of other types are lists beside it.
    small: for pages of a few dozen items, whose values are not worth compressing one by one: all columns are lists.
    wanted: pages that the step is told of; they come along as rows of keys, so that no join moves items.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    items.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    items = items.select(*keys, *cols)
    types, arrow = items.schema, to_arrow_schema(items.schema)
    kinds = {c: arrow.field(c).type for c in cols if not small and _codable(arrow.field(c).type)}
    lists = [c for c in cols if c not in kinds]
    names = tuple(spare(items, "size", "pack", "mark"))
    fields = [*[types[k] for k in keys], *[T.StructField(c, T.ArrayType(types[c].dataType)) for c in lists], T.StructField(names[0], T.LongType()), T.StructField(names[1], T.BinaryType())]
    packed = items.mapInArrow(_pack(keys, list(kinds), lists, [f.name for f in fields]), T.StructType(fields))
    if wanted is not None:
        packed = packed.withColumn(names[2], F.lit(False)).unionByName(wanted.select(*keys, F.lit(True).alias(names[2])), allowMissingColumns=True)
    whole = packed.repartition(*keys).sortWithinPartitions(*keys)
    return whole.mapInArrow(_unpack(keys, kinds, lists, names, step, to_arrow_schema(schema)), schema)


def keyed(p: Pages, keys: list[str], page: np.ndarray | None = None) -> dict[str, pa.Array]:
    """The key columns of pages, one row a page or as many as page names."""
    return {k: h if page is None else h.take(pa.array(page)) for k, h in zip(keys, p.heads)}


def low(x: np.ndarray) -> np.ndarray:
    """For sorting as Spark does: null comes first."""
    return np.where(np.isnan(x), -np.inf, x)


def joined(text: pa.Array, order: np.ndarray, start: np.ndarray, separator: str) -> pa.Array:
    """Texts in order, joined from each start to the next; nulls are left out."""
    t = text.take(pa.array(order))
    some = np.asarray(pc.is_valid(t).to_numpy(zero_copy_only=False), bool)
    before = np.concatenate([[0], np.cumsum(some)])
    at = before[np.append(start, len(order))]
    kept = t if some.all() else t.filter(pa.array(some))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), kept), separator)


def folded(page: np.ndarray, cy: np.ndarray, h: np.ndarray, tolerance: float) -> np.ndarray:
    """Row of each item, from 1 on in each page; items are sorted by page, then centre. Equal neighbours decide once."""
    n = len(page)
    out = np.empty(n, np.int32)
    if not n:
        return out
    same = (page[1:] == page[:-1]) & (cy[1:] == cy[:-1]) & (h[1:] == h[:-1]) & (h[1:] > 0)
    start = np.flatnonzero(np.concatenate([[True], ~same]))
    sizes = np.diff(np.append(start, n))
    rows = np.empty(len(start), np.int32)
    at, row, cy_sum, h_sum, k = None, 0, 0.0, 0.0, 0
    for i, (p, c, x, m) in enumerate(zip(page[start].tolist(), cy[start].tolist(), h[start].tolist(), sizes.tolist())):
        if p != at:
            at, row, k = p, 0, 0
        if not (k and abs(c - cy_sum / k) < tolerance * (h_sum / k)):
            row, cy_sum, h_sum, k = row + 1, 0.0, 0.0, 0
        for _ in range(m):
            cy_sum += c
            h_sum += x
        k += m
        rows[i] = row
    return np.repeat(rows, sizes)
