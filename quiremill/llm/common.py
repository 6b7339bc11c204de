"""Helpers that the operators share: scratch tables in the cluster's checkpoint folder, and Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a Python worker holds at once. Longer single texts are held whole, as a row is in Spark itself.
BATCH_BYTES = 8 << 20
#: Text of one block, where documents are grouped by a hash of their id.
BLOCK_BYTES = 16 << 20
#: Reducers of one exchange. More would only add files to it: maps times reducers.
MOST_TASKS = 20_000
#: Spark 4.1 on: a query removes its shuffle files when it ends. Other versions ignore it.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir, as a full URI; a folder of our own only where
    it names none and the master is local, as in tests. Files written past Spark (shards) go to the same file system that way."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quiremill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder so that no lost executor takes them along.

    save() cuts the lineage; drop() deletes a table that nothing needs any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/quiremill/{name}-{uuid.uuid4().hex}"
        atexit.register(self.delete, self.base)

    def save(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """free: the files of its shuffles go as soon as the table is written, not when the driver collects garbage."""
        old = self.spark.conf.get(FREE_SHUFFLES, "false")
        if free:
            self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        finally:
            if free:
                self.spark.conf.set(FREE_SHUFFLES, old)
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            self.delete(f"{self.base}/{name}")

    def delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            if jvm is not None:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception as why:  # at exit the gateway may be gone; files then stay for whoever owns the folder
            if "py4j" not in type(why).__module__ and not isinstance(why, (OSError, AttributeError, AssertionError)):
                raise


def small_batches(spark: SparkSession, records: int = 1000) -> None:
    """Arrow batches by bytes, not only by rows: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """Give freed memory back to the system: workers live on from stage to stage, and two share an executor's rest."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def regroup(batches: Iterable[pa.RecordBatch], size: int = BATCH_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes, and at most about `rows` rows."""
    held: list[pa.RecordBatch] = []
    total = count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
            count += batch.num_rows
        if total >= size or count >= rows:
            whole, held, total, count = pa.concat_batches(held), [], 0, 0
            yield whole
            del whole
            release()
    if held:
        whole, held = pa.concat_batches(held), []
        yield whole
        del whole
    release()


def planes(x: np.ndarray) -> bytes:
    """64-bit whole numbers in as few bytes each as the largest needs, byte planes one after another: high bytes compress well."""
    x = x.astype("<i8").view("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    p = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, : raw[0]] = p.T
    return out.view("<i8").reshape(-1)


def blocks_for(docs: DataFrame, text: str, size: int = BLOCK_BYTES) -> int:
    """How many blocks of about `size` bytes the texts make: follows the input, so a block fits a worker at any size."""
    total = docs.agg(F.sum(F.octet_length(text).cast("long") + 16)).first()[0] or 0
    return max(1, -(-int(total) // size))


def tasks(groups: int) -> int:
    """Reducers for so many groups of bounded size: beyond MOST_TASKS a task takes many groups, one after another."""
    return max(1, min(groups, MOST_TASKS))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under fixed names, so that nothing else in the table can clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])
