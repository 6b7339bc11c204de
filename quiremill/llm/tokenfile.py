"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding, control bytes apart from the data.

A shard holds documents in ascending id order. Its table ranks the shard's ids by falling frequency, so that frequent
ids take one byte; each id's rank takes 1 to 4 bytes in the data section, and two bits of a control byte say how many.
Control bytes are decoded by a table of 256 rows, the data by gathers: numpy only, no loop over ids.

Layout, little-endian: magic, n_docs, n_ids, n_ranks (u64 each); ranks (u32 each); document ids (i64), whether they are
valid (u8), their numbers of ids (u32); control bytes; data.

Defined results: a null or empty text is its end id alone. Rows with one id follow one another, each with its own start.
Null ids come first. Other columns are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Scratch, blocks_for, only, regroup, small_batches, tasks

MAGIC = b"QMIDS\0\0\1"
#: Ids after which a task begins another shard.
SHARD_IDS = 1 << 23
#: Writing tasks whose shards are summed together.
RUN = 1024
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data) of ranks below 2**32."""
    r = ranks.astype("<u4")
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    raw = r.view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) <= code[:, None]].tobytes()
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = code
    q = padded.reshape(-1, 4)
    return (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes(), data


def decode_ranks(control: bytes | np.ndarray, data: bytes | np.ndarray, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    begin = end - size
    out = raw[begin].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[begin[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def to_bytes(keys: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    freq = np.bincount(ids)
    table = np.argsort(-freq, kind="stable")[: int((freq > 0).sum())].astype("<u4")
    rank = np.zeros(len(freq), np.uint32)
    rank[table] = np.arange(len(table))
    control, data = encode_ranks(rank[ids])
    head = np.array([len(keys), len(ids), len(table)], "<u8").tobytes()
    return b"".join([MAGIC, head, table.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is not None for k in keys], np.uint8).tobytes(), counts.astype("<u4").tobytes(), control, data])


def from_bytes(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, ids, number of ids of each document)."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, ranks = (int(v) for v in np.frombuffer(raw, "<u8", 3, 8))
    at = 32
    table = np.frombuffer(raw, "<u4", ranks, at)
    at += 4 * ranks
    keys, valid = np.frombuffer(raw, "<i8", docs, at), np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    quads = -(-n // 4)
    body = np.frombuffer(raw, np.uint8)
    ids = table[decode_ranks(body[at : at + quads], body[at + quads :], n)] if n else np.zeros(0, np.uint32)
    return [int(k) if v else None for k, v in zip(keys, valid)], ids, counts


def put(uri: str, name: str, raw: bytes) -> None:
    """Whole or not at all: written under another name, then moved. A second attempt writes the same bytes."""
    where, base = pafs.FileSystem.from_uri(uri)
    where.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as f:
        f.write(raw)
    where.move(part, f"{base}/{name}")


def get(uri: str, name: str) -> bytes:
    where, base = pafs.FileSystem.from_uri(uri)
    with where.open_input_file(f"{base}/{name}") as f:
        return f.read()


def _written(path: str, end: int, uri: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        e = encoder(path)
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal keys, parts, counts, held, seq
            name = f"shard-{task:06d}-{seq:06d}.ids"
            put(uri, name, to_bytes(keys, np.concatenate(parts), np.concatenate(counts)))
            row = pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "seq": pa.array([seq], pa.int64()), "name": [name], "n_ids": pa.array([held], pa.int64())})
            keys, parts, counts, held, seq = [], [], [], 0, seq + 1
            return row

        for b in regroup(batches):
            flat, edges = e.column(b["text"])
            ids = np.insert(flat, edges[1:], end)
            keys += b["id"].to_pylist()
            parts.append(ids)
            counts.append(np.diff(edges) + 1)
            held += len(ids)
            if held >= SHARD_IDS:
                yield shard()
        if keys:
            yield shard()

    return run


def write(docs: DataFrame, path: str, *, end: int = 0, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> tuple[DataFrame, str]:
    """Write the shards; returns their manifest (task, seq, name, n_ids; in order of ids) and their folder."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "tokenfile")
    rows = only(docs, id=id, text=text).withColumn("id", F.col("id").cast("long"))
    tie = F.xxhash64("text")  # an id that many rows share may still be split
    placed = rows.repartitionByRange(tasks(blocks_for(docs, text)), "id", tie).sortWithinPartitions("id", tie)
    uri = scratch.path("shards")
    return scratch.save(placed.mapInArrow(_written(path, end, uri), "task long, seq long, name string, n_ids long"), "manifest"), uri


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b["name"].to_pylist(), b["base"].to_pylist()):
                keys, ids, counts = from_bytes(get(uri, name))
                ends = np.cumsum(counts, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(base + ends - counts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based(manifest).repartition(tasks(manifest.count()), "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def based(manifest: DataFrame) -> DataFrame:
    """The manifest with base, the ids of all shards before: a running sum within each run of tasks, and one over the runs."""
    run = F.floor(F.col("task") / RUN).cast("long")
    rows = manifest.withColumn("run", run)
    runs = rows.groupBy("run").agg(F.sum("n_ids").alias("ids"))
    # a row for each RUN tasks: some thousands where shards are millions
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("run_base"))
    within = Window.partitionBy("run").orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(runs, "run").withColumn("base", F.col("run_base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("run", "run_base")


def report(docs: DataFrame, path: str) -> DataFrame:
    """Write the shards, read them back: doc_id, start, n_tokens, ids_crc32."""
    return read(*write(docs, path))
