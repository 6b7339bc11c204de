"""Media columns: content-addressed payloads in tar shards, metadata columns filled by header-only range reads.

Each distinct payload of a task's rows is stored once, as an 8-bit grey PNG 64 samples wide, under the SHA-256 of its
stored bytes as its member's name. Rows carry digest, shard, offset and length and never the payload. Shards are written
whole by one task, named by their task, and moved into place, so that a second attempt ends in the same bytes.

features() fills the metadata columns from the first 33 bytes of each payload; verified() then reads payloads whole, for
their digests, and holds them to these columns. Rows of one shard follow one another in the manifest, so reading needs
no shuffle and each stored payload is read whole once.

Defined results: a null or empty text is a payload of 64 zero bytes. Equal texts have equal payloads and stored bytes,
within one shard one copy. Repeated rows and null ids are kept. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, only, regroup, small_batches

WIDTH = 64
LEVEL = 4
SHARD_BYTES = 64 << 20
HEADER = 33
_SIGN = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes of a text, and how many are its own."""
    raw = (text or "").encode()
    return raw + b"\0" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(raw: bytes) -> bytes:
    rows = b"".join([b"\0" + raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)])
    head = struct.pack(">IIBBBBB", WIDTH, len(raw) // WIDTH, 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample from a PNG's first 33 bytes."""
    if head[:8] != _SIGN or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(raw: bytes) -> bytes:
    width, _, _ = png_header(raw[:HEADER])
    at, parts = 8, []
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if kind == b"IDAT":
            parts.append(raw[at + 8 : at + 8 + size])
        at += 12 + size
    rows = zlib.decompress(b"".join(parts))
    return b"".join([rows[i + 1 : i + 1 + width] for i in range(0, len(rows), width + 1)])


def _member(name: str, raw: bytes) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = len(raw)
    return info.tobuf(tarfile.USTAR_FORMAT) + raw + b"\0" * (-len(raw) % tarfile.BLOCKSIZE)


class Shards:
    """Writes tar shards of one task, each payload once a shard."""

    def __init__(self, uri: str, task: int, most: int = SHARD_BYTES) -> None:
        self.fs, self.base = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.base, recursive=True)
        self.task, self.seq, self.out, self.most = task, 0, None, most

    def add(self, media: bytes) -> tuple[bytes, str, int, int]:
        """digest, shard, offset and length of the stored bytes."""
        if self.out is None:
            self.name, self.part = f"shard-{self.task:06d}-{self.seq:04d}.tar", f"{self.base}/.{uuid.uuid4().hex}"
            self.out, self.size, self.seen = self.fs.open_output_stream(self.part), 0, {}
        digest = hashlib.sha256(media).digest()
        if digest not in self.seen:
            raw = _member(f"{digest.hex()}.png", media)
            self.out.write(raw)
            self.seen[digest] = self.size + tarfile.BLOCKSIZE
            self.size += len(raw)
        found = digest, self.name, self.seen[digest], len(media)
        if self.size >= self.most:
            self.close()
        return found

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.fs.move(self.part, f"{self.base}/{self.name}")
            self.out, self.seq = None, self.seq + 1


def _stored(uri: str, kind: pa.DataType, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shards = Shards(uri, TaskContext.get().partitionId(), most)
        for b in regroup(batches):
            rows = []
            for text in b["text"].to_pylist():
                raw, own = payload(text)
                rows.append((own, *shards.add(to_png(raw))))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["id", "n_bytes", "digest", "shard", "at", "length"])
        shards.close()

    return run


def store(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, scratch: Scratch | None = None) -> tuple[DataFrame, str]:
    """Store every text's payload; returns the manifest (id, n_bytes, digest, shard, at, length) and the shards' folder."""
    small_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "media")
    rows = only(docs, id=id, text=text)
    kind = rows.schema["id"].dataType
    uri = scratch.path("shards")
    return scratch.save(rows.mapInArrow(_stored(uri, to_arrow_type(kind), shard_bytes), f"id {kind.simpleString()}, n_bytes long, digest binary, shard string, at long, length long"), "manifest"), uri


def _ranges(uri: str):
    """A reader of byte ranges that keeps one shard open."""
    where, base = pafs.FileSystem.from_uri(uri)
    held: dict[str, pa.NativeFile] = {}

    def read(shard: str, at: int, length: int) -> bytes:
        if shard not in held:
            for f in held.values():
                f.close()
            held.clear()
            held[shard] = where.open_input_file(f"{base}/{shard}")
        held[shard].seek(at)
        return held[shard].read(length)

    return read


def features(manifest: DataFrame, uri: str) -> DataFrame:
    """The manifest with width, height and bits, from header-only range reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _ranges(uri)
        for b in batches:
            heads, last, head = [], None, (0, 0, 0)
            for at in zip(b["shard"].to_pylist(), b["at"].to_pylist()):
                if at != last:  # copies often follow one another
                    last, head = at, png_header(read(*at, HEADER))
                heads.append(head)
            cols = list(zip(*heads)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.int32()) for c in cols]], names=[*b.schema.names, "width", "height", "bits"])

    return manifest.mapInArrow(run, T.StructType([*manifest.schema.fields, *T._parse_datatype_string("width int, height int, bits int").fields]))


def verified(manifest: DataFrame, uri: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from stored bytes.

    manifest: as features() gives it; a payload that does not fit its columns, or its digest, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _ranges(uri)
        last: dict[tuple[str, int], tuple] = {}
        for b in batches:
            rows = []
            for shard, at, length, digest, width, height, bits in zip(*(b[c].to_pylist() for c in ("shard", "at", "length", "digest", "width", "height", "bits"))):
                if (shard, at) not in last:
                    media = read(shard, at, length)
                    raw = from_png(media)
                    if hashlib.sha256(media).digest() != digest or len(raw) != width * height * bits // 8:
                        raise ValueError(f"{shard} at {at}: stored bytes do not match their digest")
                    if len(last) > 50_000:
                        last.clear()
                    last[shard, at] = len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), length, digest.hex(), f"png;{width}x{height}x{bits};mean={sum(raw) / len(raw):.3f};zeros={len(raw) - len(raw.rstrip(b'\0'))}"
                rows.append(last[shard, at])
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["id"], b["n_bytes"], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = manifest.schema["id"].dataType.simpleString()
    return manifest.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def report(docs: DataFrame) -> DataFrame:
    """Store every payload, fill its metadata columns from its header, then read it back whole."""
    manifest, uri = store(docs)
    return verified(features(manifest, uri), uri)


def members(raw: bytes) -> list[tuple[str, bytes]]:
    """Name and content of every member of a shard, by the tar library."""
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        return [(m.name, t.extractfile(m).read()) for m in t.getmembers()]  # type: ignore[union-attr]


