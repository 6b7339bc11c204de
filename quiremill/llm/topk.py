"""Exact top-k search by columnar branch and bound.

Vectors lie in vertical layout, one array for each dimension, in blocks of candidates. For a block of queries the
distances accumulate one block of dimensions at a time; after each, a bound on what the remaining dimensions can still
add (Cauchy-Schwarz on their norms) is held against the k-th best score so far, and the candidates that cannot reach it
are compacted away. What survives all dimensions is exact. Queries and candidates meet group by group, so that neither
side is ever held whole by a task or the driver: a group of candidates goes to as many tasks as there are groups of
queries, and the other way round. Within a task the k-th best goes on from one block of candidates to the next.

Scores are whole numbers. Where norms show that none can reach 2**53 they are summed in float64, which is exact there;
below 2**63 in int64, without bounds; beyond, as Python's numbers, and a score that no long can hold is an error.

Defined results: vectors that are null, or hold a null, NaN or infinity, take no part, as query or candidate; so do rows
with a null id. A query's own id is no candidate. Vectors of another length than a query's are no candidates for it.
Ties go to the smaller id; a repeated row is a candidate each time. A query id with several vectors is answered once, for
the smallest of them, compared component by component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, regroup, tasks

SCALE = 64
DIM_BLOCK = 16
QUERY_BLOCK = 1024
ROW_BLOCK = 8192
#: Blocks of either side that meet in one task.
QUERY_GROUP, ROW_GROUP = 1, 4


def branch_and_bound(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in one block: arrays of query position, candidate position, score.

    x: dimensions by candidates, candidates in ascending id. All values and scores are whole numbers below 2**53, as
    float64. floor: scores that k candidates of each query reach elsewhere; candidates below may be left out.
    """
    dims, n = x.shape
    edges = [*range(0, dims, DIM_BLOCK), dims] if dims else [0, 0]
    # norms of what is left from each edge on, rounded up
    left_x = np.array([np.sqrt((x[e:] ** 2).sum(0)) for e in edges]) * (1 + 1e-9)
    left_q = np.array([np.sqrt((q[:, e:] ** 2).sum(1)) for e in edges]) * (1 + 1e-9)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # the k-th best of the first candidates is a floor to begin with
    head = min(n, max(64, 4 * k))
    first = q @ x[:, :head]
    first[q_id[:, None] == x_id[None, :head]] = -np.inf
    here = np.partition(first, head - k, axis=1)[:, head - k] if head > k else np.full(len(q), -np.inf)
    floor = here if floor is None else np.maximum(floor, here)
    # the first block of dimensions for all pairs at once
    start = q[:, : edges[1]] @ x[: edges[1]]
    live = start + left_q[1][:, None] * left_x[1][None, :] >= floor[:, None]
    for i in range(len(q)):
        at = np.flatnonzero(live[i])
        score = start[i, at]
        for b in range(1, len(edges) - 1):
            lo, hi = edges[b], edges[b + 1]
            score = score + q[i, lo:hi] @ x[lo:hi, at]
            stay = score + left_q[b + 1][i] * left_x[b + 1][at] >= floor[i]
            if not stay.all():
                at, score = at[stay], score[stay]
        own = x_id[at] != q_id[i]
        at, score = at[own], score[own]
        best = np.lexsort((x_id[at], -score))[:k]
        out.append((np.full(len(best), i), at[best], score[best]))
    return tuple(np.concatenate(c) if out else np.zeros(0) for c in (zip(*out) if out else ((), (), ())))  # type: ignore[return-value]


def every_score(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As branch_and_bound(), for whole numbers of any size, without bounds."""
    at, scores = [], []
    wide = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, len(x)) >= 2.0**62
    kind = object if wide else np.int64
    whole_x = np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) if wide else x.astype(np.int64)
    for i in range(len(q)):
        row = np.array([int(v) for v in q[i]], kind)
        score = row @ whole_x if len(row) else np.zeros(x.shape[1], kind)
        own = np.flatnonzero(x_id != q_id[i])
        best = np.array(sorted(own.tolist(), key=lambda j: (-score[j], x_id[j]))[:k], np.int64)
        if any(not -(1 << 63) <= int(v) < 1 << 63 for v in score[best]):
            raise OverflowError(f"a score of query {q_id[i]} does not fit a long")
        at.append(best)
        scores.append(score[best].astype(np.int64))
    i = np.repeat(np.arange(len(q)), [len(a) for a in at])
    return i, (np.concatenate(at) if at else np.zeros(0, np.int64)), (np.concatenate(scores) if scores else np.zeros(0, np.int64))


def _bytes(x: np.ndarray) -> tuple[str, bytes]:
    """A whole-number matrix in the smallest type that holds it: (type, bytes)."""
    low, high = (x.min(), x.max()) if x.size else (0, 0)
    kind = next((t for t in ("i1", "i2", "i4") if np.iinfo(t).min <= low and high <= np.iinfo(t).max), "f8")
    return kind, np.ascontiguousarray(x).astype(kind).tobytes()


def _row(dims: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    kind, raw = _bytes(x)
    return pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int32()), "ids": [ids.astype(np.int64).tobytes()], "kind": [kind], "x": [raw]})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row blocks of equal length vectors, sorted by id: ids and a dimension-major matrix as bytes."""
    for b in regroup(batches, 32 << 20, ROW_BLOCK):
        t = pa.Table.from_batches([b])
        length = pc.list_value_length(t["x"]).to_numpy()
        for dims in np.unique(length):
            part = t.filter(pa.array(length == dims)).sort_by("id")
            for lo in range(0, part.num_rows, ROW_BLOCK):
                p = part.slice(lo, ROW_BLOCK)
                x = p["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(p.num_rows, dims)
                yield _row(int(dims), p["id"].to_numpy(), x.T)


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query."""
    order = np.lexsort((vec, -score, query))
    q = query[order]
    first = np.flatnonzero(np.diff(q, prepend=-1))
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k]


def _matrix(kind: str, raw: bytes, dims: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.float64).reshape(dims, n)


def _met(k: int):
    """A group of candidate blocks and one of query blocks -> the k best of each query among them."""

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        blocks = [(d, np.frombuffer(i, np.int64), t, x) for d, i, t, x in zip(*(rows[c].to_pylist() for c in ("dims", "ids", "kind", "x")))]
        for dims, ids, kind, raw in zip(*(queries[c].to_pylist() for c in ("dims", "ids", "kind", "x"))):
            q_id = np.frombuffer(ids, np.int64)
            q = _matrix(kind, raw, dims, len(q_id)).T
            norm = np.sqrt((q**2).sum(1)).max(initial=0)
            at, vec, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for d, x_id, x_kind, x_raw in blocks:
                if d != dims:
                    continue
                x = _matrix(x_kind, x_raw, dims, len(x_id))
                if norm * np.sqrt((x**2).sum(0)).max(initial=0) < 2.0**52:
                    floor = np.full(len(q_id), -np.inf)
                    full = np.bincount(at, minlength=len(q_id)) >= k
                    if full.any():
                        low = np.full(len(q_id), np.iinfo(np.int64).max)
                        np.minimum.at(low, at, score)
                        floor[full] = low[full]  # a tie may still win by its id
                    i, j, s = branch_and_bound(q, q_id, x, x_id, k, floor)
                else:
                    i, j, s = every_score(q, q_id, x, x_id, k)
                at, vec, score = np.concatenate([at, i.astype(np.int64)]), np.concatenate([vec, x_id[j.astype(np.int64)]]), np.concatenate([score, s.astype(np.int64)])
                keep = _best(at, vec, score, k)
                at, vec, score = at[keep], vec[keep], score[keep]
            out.append((q_id[at], vec, score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def search(vectors: DataFrame, *, k: int = 20, query_every: int = 20, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by query_every, its k best other rows."""
    v = F.col("v")
    ok = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor() of a double is a long and would cut what is beyond; such doubles have no fraction
    floor = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x * scale if scale != 1 else x).cast("double")).otherwise(x * scale)
    rows = only(vectors, id=id, v=vector).withColumn("v", v.cast("array<double>")).where(ok).select(F.col("id").cast("long").alias("id"), F.transform("v", floor).alias("x"))
    packed = "dims int, ids binary, kind string, x binary"
    # the number of groups follows the input, and so does the work: queries times rows
    queries = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min("x").alias("x"))
    n_queries, n_rows = (int(x or 0) for x in rows.agg(F.sum((F.col("id") % query_every == 0).cast("long")), F.count("*")).first())
    q_groups = max(1, -(-n_queries // (QUERY_BLOCK * QUERY_GROUP)))
    x_groups = max(1, -(-n_rows // (ROW_BLOCK * ROW_GROUP)))

    def slots(n: int):  # the groups that a block must meet
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    q = queries.repartition(tasks(q_groups), "id").mapInArrow(_packed_queries, packed).withColumn("h", F.pmod(F.xxhash64("ids"), F.lit(q_groups))).withColumn("g", slots(x_groups))
    c = rows.mapInArrow(_packed, packed).withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(x_groups))).withColumn("h", slots(q_groups))
    pairs = tasks(q_groups * x_groups)
    met = c.repartition(pairs, "g", "h").groupBy("g", "h").cogroup(q.repartition(pairs, "g", "h").groupBy("g", "h")).applyInArrow(_met(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _packed(batches):
        for k in range(b.num_rows):
            ids, dims = np.frombuffer(b["ids"][k].as_py(), np.int64), b["dims"][k].as_py()
            x = np.frombuffer(b["x"][k].as_py(), b["kind"][k].as_py()).reshape(dims, len(ids))
            for lo in range(0, len(ids), QUERY_BLOCK):
                yield _row(dims, ids[lo : lo + QUERY_BLOCK], x[:, lo : lo + QUERY_BLOCK])
