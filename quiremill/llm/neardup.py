"""Near-duplicate documents: MinHash with tensored banding, candidates confirmed on full shingle sets.

Two small collections of m half-bands are computed, each half-band a hash of `rows` minhashes; a table key is a pair
(i, j) of one half-band from either collection, so that m*m tables cost only 2*m*rows minhashes. Two documents of
similarity t share no key with probability at most 2 * (1 - t**rows)**m; m is chosen for that to stay below MISS.

Shingles are hashes while candidates are sought; a link is confirmed on the words themselves, by their bytes.
Texts with one set of shingles fall together first (a grouped 128-bit sum over the whole set). Half-bands that nothing
else shares are dropped before keys are formed. In each table entry every member is confirmed against the smallest
member; entries left with several components then compare all pairs of members from different components, in cells of
bounded size, behind two exact bounds (set sizes, and the bits in which two parity sketches differ), so that no link
between the members of an entry is lost and no group is gathered or paired in full where its members are linked already.

Defined results: null and empty texts, and texts without a word, have an empty set and link with nothing. A text of
fewer words than a shingle has its whole word sequence as its one shingle. Repeated rows of one id are each returned,
under one component. Rows with a null id are returned with a null component and link with nothing. Other columns are
never read by near_duplicates(), and are kept by keep_first().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, regroup, small_batches
from .components import components
from .words import Words, coded_runs, grams, mix, whole

ROWS = 2
MISS = 1e-4
SKETCH_BITS = 2048
#: Members of a cell when an entry's components are compared.
CELL = 256


def half_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Half-bands in each collection, so that a pair at the threshold is missed with probability `miss` at most."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - threshold**rows))) if threshold < 1 else 1


def shingle_sets(col: pa.Array, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, ascending within the row, and the n+1 row offsets."""
    w = Words(col, lower=lower)
    h, rows, counts = w.hashes(), w.rows(), w.counts()
    ok = whole(rows, k)
    value, row = grams(h, k)[ok], rows[: len(ok)][ok]
    for n in range(1, k):  # whole short texts
        short = np.flatnonzero(counts == n)
        if len(short):
            acc = np.full(len(short), n, np.uint64)
            for j in range(n):
                acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[w.at[short] + j])
            value, row = np.concatenate([value, acc]), np.concatenate([row, short.astype(np.int32)])
    if (np.diff(row) < 0).any():
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    edges = np.searchsorted(row, np.arange(len(col) + 1))
    sets = [np.unique(value[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else value), np.concatenate([[0], np.cumsum(sizes)])


def _reduce(op: np.ufunc, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """op over each row's values; rows must not be empty."""
    return op.reduceat(values, at[:-1])


def _signatures(k: int, m: int, rows: int):
    n = 2 * m * rows
    mult = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(batches, rows=2048):
            sets, at = shingle_sets(b["text"], k)
            size = np.diff(at)
            full = np.flatnonzero(size)
            starts = np.concatenate([at[:-1][full], [at[-1]]])
            if len(full):
                low, high = _reduce(np.add, mix(sets + np.uint64(1)), starts), _reduce(np.add, mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                halves = np.empty((len(full), 2 * m), np.uint64)
                for g in range(2 * m):
                    acc = np.full(len(full), g + 1, np.uint64)
                    for r in range(rows):
                        v = sets * mult[g * rows + r]
                        v ^= v >> np.uint64(32)
                        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + _reduce(np.minimum, v * np.uint64(0xBF58476D1CE4E5B9), starts))
                    halves[:, g] = acc
                # odd counts of shingles by bit: sets that differ in d shingles differ in at most d bits
                sketch = np.zeros((len(full), SKETCH_BITS), bool)
                owner = np.repeat(np.arange(len(full)), size[full])
                counts = np.bincount(owner * SKETCH_BITS + (sets >> np.uint64(20)).astype(np.int64) % SKETCH_BITS, minlength=len(full) * SKETCH_BITS)
                sketch = np.packbits((counts & 1).astype(bool).reshape(len(full), SKETCH_BITS), axis=1)
            else:
                low = high = np.zeros(0, np.uint64)
                halves, sketch = np.zeros((0, 2 * m), np.uint64), np.zeros((0, SKETCH_BITS // 8), np.uint8)
            spread = np.full(b.num_rows, -1, np.int64)
            spread[full] = np.arange(len(full))
            pick = pa.array(spread, mask=spread < 0)
            yield pa.RecordBatch.from_arrays(
                [
                    b["id"],
                    pa.array(size),
                    pa.array(low.view(np.int64)).take(pick),
                    pa.array(high.view(np.int64)).take(pick),
                    pa.FixedSizeListArray.from_arrays(pa.array(halves.reshape(-1).view(np.int64)), 2 * m).cast(pa.list_(pa.int64())).take(pick),
                    pa.array([s.tobytes() for s in sketch], pa.binary()).take(pick),
                ],
                names=["id", "n", "low", "high", "halves", "sketch"],
            )

    return run


def linked(u: pa.Array, v: pa.Array, k: int, share: Fraction, lower: bool = True) -> np.ndarray:
    """Which pairs of texts have shingle sets that reach the share. Shingles are compared by their words' bytes."""
    n = len(u)
    w = Words(pa.concat_arrays([u, v]), lower=lower)
    code, counts = w.coded(), w.counts()
    ok = whole(w.rows(), k)
    value, row = coded_runs(code, k)[ok], w.rows()[: len(ok)][ok].astype(np.int64)
    distinct, value = np.unique(value, return_inverse=True)
    size = max(1, len(distinct))
    a, b = np.unique(row[row < n] * size + value[row < n]), np.unique((row[row >= n] - n) * size + value[row >= n])
    inter = np.bincount(np.intersect1d(a, b, assume_unique=True) // size, minlength=n)
    union = np.bincount(a // size, minlength=n) + np.bincount(b // size, minlength=n) - inter
    good = (union > 0) & (share.denominator * inter >= share.numerator * union)
    for i in np.flatnonzero((counts[:n] == counts[n:]) & (counts[:n] > 0) & (counts[:n] < k)):  # whole short texts
        good[i] = (code[w.at[i] : w.at[i + 1]] == code[w.at[n + i] : w.at[n + i + 1]]).all()
    return good


def _confirm(k: int, share: Fraction):
    """Of candidate pairs with both texts, those that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(batches):
            good = pa.array(linked(b["u_text"], b["v_text"], k, share))
            yield pa.RecordBatch.from_arrays([b["u"].filter(good), b["v"].filter(good)], names=["u", "v"])

    return run


def _cells(share: Fraction):
    """Pairs of one cell from different components that both exact bounds let through."""

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        ids, n, root = table["id"].to_numpy(), table["n"].to_numpy(), table["root"].to_numpy()
        bits = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(table.num_rows, -1)
        us, vs = [], []
        for i in one:
            j = two[(root[two] != root[i]) & (ids[two] != ids[i])]
            j = j[np.minimum(n[j], n[i]) * share.denominator >= np.maximum(n[j], n[i]) * share.numerator]
            # |A xor B| <= (1 - t) / (1 + t) * (|A| + |B|)
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1).astype(np.int64)
            j = j[apart * (share.denominator + share.numerator) <= (share.denominator - share.numerator) * (n[j] + n[i])]
            us.append(np.minimum(ids[i], ids[j]))
            vs.append(np.maximum(ids[i], ids[j]))
        u, v = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (us, vs))
        pairs = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, threshold: float | Fraction = 0.8, rows: int = ROWS, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, n_shingles, component_id of every row: components over links of Jaccard similarity >= threshold.

    Exact for every pair that shares a table entry; a pair at the threshold shares none with probability MISS at most.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "neardup")
    share = Fraction(threshold).limit_denominator(10_000)
    m = half_bands(float(share), rows)
    texts = only(docs, id=id, text=text).select(F.col("id").cast("long").alias("id"), "text")
    sigs = scratch.save(texts.mapInArrow(_signatures(shingle, m, rows), "id long, n long, low long, high long, halves array<long>, sketch binary"), "signatures")

    # one row for each distinct set; groupBy combines before the shuffle, so copies without number are no hot key
    sets = ["n", "low", "high"]
    known = sigs.where("id is not null and n > 0")
    classes = scratch.save(known.groupBy(sets).agg(F.min("id").alias("rep")), "classes")
    reps = known.join(classes.withColumnRenamed("rep", "id"), [*sets, "id"], "left_semi").dropDuplicates(["id", *sets])

    # one id may carry several texts: each (id, set) stands for itself under the id's component
    halves = reps.select("id", F.posexplode("halves").alias("g", "h"))
    shared = halves.groupBy("g", "h").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    left = halves.join(shared, ["g", "h"]).groupBy("id").agg(F.collect_list(F.struct("g", "h")).alias("s"))  # at most 2 * m each
    left = left.select("id", F.filter("s", lambda x: x["g"] < m).alias("a"), F.filter("s", lambda x: x["g"] >= m).alias("b")).where(F.size("a") * F.size("b") > 0)
    keyed = left.select("id", F.explode("a").alias("a"), "b").select("id", "a", F.explode("b").alias("b"))
    keys = scratch.save(keyed.select("id", F.xxhash64("a.g", "a.h", "b.g", "b.h").alias("key")), "keys")
    entries = keys.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v <> last").drop("last")
    stars = scratch.save(keys.join(entries, "key").where("id <> v").select(F.col("id").alias("u"), "v").distinct(), "stars")
    sizes = reps.select("id", "n")
    links = scratch.save(_confirmed(stars, sizes, texts, shingle, share), "links")
    scratch.drop("stars")
    first = components(links, scratch, "first")

    # entries whose members are not of one component yet
    rooted = keys.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c")).where("a <> b").select("key", "c")
    members = rooted.join(open_, "key").join(reps.select("id", "n", "sketch"), "id")
    cells = F.greatest(F.lit(1), F.ceil(F.col("c") / CELL)).cast("long")
    placed = members.withColumn("cells", cells).withColumn("at", F.pmod(F.xxhash64("id"), F.col("cells")))
    meets = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    meets = meets.select("key", "id", "n", "root", "sketch", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), F.when(F.col("at") == F.col("other"), 2).when(F.col("at") < F.col("other"), 0).otherwise(1).alias("side"))
    rest = meets.groupBy("key", "x", "y").applyInArrow(_cells(share), "u long, v long").distinct()
    rest = scratch.save(rest.select(F.col("v").alias("u"), F.col("u").alias("v")), "rest")
    more = scratch.save(_confirmed(rest, sizes, texts, shingle, share), "more")
    scratch.drop("keys", "rest")

    # texts of one set, and all sets of one id, belong together
    same = known.join(classes, sets).select(F.col("id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    roots = components(links.unionByName(more).unionByName(same), scratch, "last")
    return sigs.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def _confirmed(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, shingle: int, share: Fraction) -> DataFrame:
    """Pairs (u, v) that are links. Only pairs whose set sizes allow it meet their texts."""
    x, y = (sizes.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n")) for c in "uv")
    fits = pairs.join(x, "u").join(y, "v").where(F.least("u_n", "v_n") * share.denominator >= F.greatest("u_n", "v_n") * share.numerator).select("u", "v").distinct()
    a, b = (texts.where("id is not null").select(F.col("id").alias(c), F.col("text").alias(f"{c}_text")) for c in "uv")
    return fits.join(a, "u").join(b, "v").select("u", "v", "u_text", "v_text").mapInArrow(_confirm(shingle, share), "u long, v long").distinct()


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for three-word shingles and 85 of 100."""
    found = near_duplicates(docs, shingle=3, threshold=Fraction(85, 100))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, *, id: str = "doc_id", **options: object) -> DataFrame:
    """The documents but one of each component, that with the smallest id, with all their columns."""
    found = near_duplicates(docs, id=id, **options)
    gone = found.where("id <> component_id").select(F.col("id").alias(id)).distinct()
    return docs.join(gone, id, "left_anti")
