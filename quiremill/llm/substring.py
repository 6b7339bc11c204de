"""Substring dedup by fixed-block anchors: repeats of `window` words or more, exact, over all documents.

Reference blocks of window // 2 words that do not overlap are indexed in every document, and probed with every rolling
run of as many words; a window of `window` words always holds a whole block, so a block that no other run equals rules
out all windows around it. The windows around hit blocks are compared whole, and those that another, earlier place has
too are joined to maximal exact repeats, whose words go. Two windows are the same if 128 bits agree that are mixed from
128 bits of each of their words, word by word: among 10**13 windows any two agree by chance at odds of 1 to 10**12.

Documents are handled in blocks of bounded bytes, by a hash of id and text. What leaves a block is combined there first,
so a passage that a third of all rows share counts at most twice a block as a probe and once as a window. Keys travel as
sorted, delta-coded arrays, one for each block and each share of the hash space that the block has keys in.

Defined results: the earlier place is that with the smaller (id, start); a null id comes after all others. Rows with one
id and the same text are one document: neither takes words from the other, and all lose the same words. Null and empty
texts have no words. Texts of fewer than `window` words lose none. Other columns are never read by repeats(), and are
kept by without_repeats().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks_for, planes, release, small_batches, tasks, unplanes
from .words import Words, runs, whole

WINDOW = 20
KEY_BITS = 30
#: Text of one block: a worker holds its words, their hashes and windows at once.
BLOCK = 12 << 20
NO_ID = np.iinfo(np.int64).max


def pack(keys: np.ndarray) -> bytes:
    """Ascending keys, repeats included, as differences."""
    return planes(np.diff(keys.astype(np.int64), prepend=0))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw))


def spans(share: np.ndarray) -> list[tuple[int, int, int]]:
    """(share, begin, end) of each run of one share in an ascending column."""
    first = np.flatnonzero(np.diff(share, prepend=-1))
    return list(zip(share[first].tolist(), first.tolist(), np.append(first[1:], len(share)).tolist()))


class Block:
    """Words, documents and rolling hashes of one block."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.text = table["text"].combine_chunks()
        self.ids = table["id"].fill_null(NO_ID).to_numpy()
        self.words = Words(self.text)
        self.hash = self.words.hashes()
        self.rows = self.words.rows()
        self.step = window // 2
        self.window = window

    def probes(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Share and key, in one number, of the run at each word, and whether it lies within a document."""
        return runs(self.hash, self.step) >> np.uint64(64 - KEY_BITS - bits), whole(self.rows, self.step)

    def aligned(self, n: int) -> np.ndarray:
        """Which of the first n words start a reference block."""
        return (np.arange(n) - self.words.at[:-1][self.rows[:n]]) % self.step == 0

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, start) of the words at these positions."""
        row = self.rows[at]
        return self.ids[row], at - self.words.at[:-1][row]

    def windows(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions and both hashes of windows that hold a hit reference block whole. hits: by word, as aligned()."""
        n = len(self.rows) - self.window + 1
        if n <= 0 or not hits.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        near = np.concatenate([[0], np.cumsum(np.append(hits, np.zeros(len(self.rows) - len(hits), bool)))])
        span = self.window - self.step + 1  # a block may start at any of so many words of the window
        at = np.flatnonzero((near[span : span + n] > near[:n]) & whole(self.rows, self.window))
        return at, runs(self.hash, self.window)[at], runs(self.words.hashes(1), self.window)[at]


def _first(one: np.ndarray, two: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hashes, id, start); where in it other hashes begin; and of each place in it, the first with its hashes."""
    order = np.lexsort((starts, ids, two, one))
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(order)]
    return order, new, order[np.flatnonzero(new)][np.cumsum(new) - 1]


PROBES = "block long, share long, keys binary, anchors binary"
HITS = "block long, share long, hits binary"
WINDOWS = "block long, share long, one binary, two binary, ids binary, starts binary"
LATE = "block long, share long, late binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _probes(bits: int, window: int):
    """Block -> for each share of the hash space that it has runs in, their keys, each at most twice."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = Block(table, window)
        value, ok = b.probes(bits)
        if not ok.any():
            return _table(PROBES, [])
        marked = np.unique(value[ok & b.aligned(len(value))])
        value = np.sort(value[ok])
        third = np.zeros(len(value), bool)
        third[2:] = value[2:] == value[:-2]
        value = value[~third]
        mask, out = np.uint64((1 << KEY_BITS) - 1), []
        shares = spans((value >> np.uint64(KEY_BITS)).astype(np.int64))
        bounds = np.array([s for s, _, _ in shares], np.uint64)
        begin, end = np.searchsorted(marked, bounds << np.uint64(KEY_BITS)), np.searchsorted(marked, (bounds << np.uint64(KEY_BITS)) | mask, side="right")
        for (s, x, y), p, q in zip(shares, begin, end):
            out.append((key[0].as_py(), s, pack(value[x:y] & mask), pack(marked[p:q] & mask)))
        return _table(PROBES, out)

    return run


def _hits(key: tuple, table: pa.Table) -> pa.Table:
    """Share -> for each block, those of its reference blocks' keys that two runs or more have."""
    every = np.sort(np.concatenate([unpack(x.as_py()) for x in table["keys"]]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for block, raw in zip(table["block"], table["anchors"]):
        mine = unpack(raw.as_py())
        at = np.minimum(np.searchsorted(twice, mine), max(0, len(twice) - 1))
        mine = mine[twice[at] == mine] if len(twice) else mine[:0]
        if len(mine):
            out.append((block.as_py(), key[0].as_py(), pack(mine)))
    return _table(HITS, out)


def _hit_words(b: Block, hits: pa.Table, bits: int) -> np.ndarray:
    """By word: starts a reference block that was hit."""
    value, ok = b.probes(bits)
    found = [unpack(h.as_py()).astype(np.uint64) | (np.uint64(s.as_py()) << np.uint64(KEY_BITS)) for s, h in zip(hits["share"], hits["hits"])]
    out = np.zeros(len(value), bool)
    if found:
        at = np.flatnonzero(ok & b.aligned(len(value)))
        out[at[np.isin(value[at], np.concatenate(found))]] = True
    return out


def _distinct(b: Block, hits: pa.Table, bits: int):
    """A block's windows around hits: positions; their order by hashes and places, where other hashes begin, the first of
    each; ids and starts; and of the distinct ones, ascending, which share compares them."""
    at, one, two = b.windows(_hit_words(b, hits, bits))
    ids, starts = b.places(at)
    order, new, head = _first(one, two, ids, starts)
    heads = order[new]
    share = (one[heads] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(heads), np.int64)
    return at, one, two, order, new, head, ids, starts, spans(share)


def _windows(bits: int, window: int):
    """Block and hits -> for each share, its distinct windows around hits, each with its first place here."""

    def run(key: tuple, docs: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs.num_rows or not hits.num_rows:
            return _table(WINDOWS, [])
        _, one, two, order, new, _, ids, starts, shares = _distinct(Block(docs, window), hits, bits)
        heads, out = order[new], []
        for s, x, y in shares:
            h = heads[x:y]
            out.append((key[0].as_py(), s, one[h].tobytes(), two[h].tobytes(), planes(ids[h]), planes(starts[h])))
        return _table(WINDOWS, out)

    return run


def _later(key: tuple, table: pa.Table) -> pa.Table:
    """Share -> for each block, which of its windows have an earlier place in another block: bits in the block's order."""
    one, two = (np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table[c]]) for c in ("one", "two"))
    parts = [unplanes(x.as_py()) for x in table["ids"]]
    ids, starts = np.concatenate(parts), np.concatenate([unplanes(x.as_py()) for x in table["starts"]])
    order, _, head = _first(one, two, ids, starts)
    # the same (id, start) elsewhere is a repeated row: as early
    late = np.zeros(len(one), bool)
    late[order] = (ids[order] != ids[head]) | (starts[order] != starts[head])
    ends = np.cumsum([len(p) for p in parts])
    mine = [late[e - len(p) : e] for p, e in zip(parts, ends)]
    return _table(LATE, [(block.as_py(), key[0].as_py(), np.packbits(m).tobytes()) for block, m in zip(table["block"], mine) if m.any()])


def _removed(b: Block, hits: pa.Table, late: pa.Table, bits: int) -> np.ndarray:
    """By word: covered by a window that starts earlier too."""
    gone = np.zeros(len(b.words) + 1, np.int64)
    if hits.num_rows:
        at, _, _, order, new, head, ids, starts, shares = _distinct(b, hits, bits)
        bad = (ids[order] != ids[head]) | (starts[order] != starts[head])
        marks = dict(zip(late["share"].to_pylist(), late["late"].to_pylist()))
        elsewhere = [np.unpackbits(np.frombuffer(marks[s], np.uint8), count=y - x).astype(bool) if s in marks else np.zeros(y - x, bool) for s, x, y in shares]
        if elsewhere:
            bad |= np.concatenate(elsewhere)[np.cumsum(new) - 1]
        start = at[order[bad]]
        np.add.at(gone, start, 1)
        np.add.at(gone, start + b.window, -1)
    return np.cumsum(gone[:-1]) > 0


def _rebuild(bits: int, window: int, report: bool):
    def run(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({})
        b = Block(docs, window)
        gone = _removed(b, marks.filter(marks["hits"].is_valid()), marks.filter(marks["late"].is_valid()), bits)
        data, starts, ends = b.words.data.tobytes(), b.words.starts, b.words.ends
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[b.words.at[1:]] - total[b.words.at[:-1]]
        out: list[str | None] = []
        for i, (lo, hi) in enumerate(zip(b.words.at[:-1], b.words.at[1:])):
            if not report and not removed[i]:
                out.append(b.text[i].as_py())
                continue
            keep = np.flatnonzero(~gone[lo:hi]) + lo
            kept = b" ".join([data[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist())])
            out.append(hashlib.sha256(kept).hexdigest() if report else kept.decode())
        release()
        columns = {"rest": docs["rest"], "n_words": pa.array(b.words.counts(), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "out": pa.array(out, pa.string())}
        return pa.table(columns)

    return run


def repeats(docs: DataFrame, *, window: int = WINDOW, id: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """rest (struct of all columns but the text; report: of the id), n_words, n_removed and out.

    out: the text without its repeats, its kept words joined by one space; a text that loses nothing stays as it is.
    With report, the SHA-256 of the kept words joined by one space.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    spark = docs.sparkSession
    small_batches(spark)
    blocks = blocks_for(docs, text, BLOCK)
    bits = blocks.bit_length()  # a block of text has about as many words as a share has keys
    by_block, by_share = tasks(blocks), tasks(1 << bits)
    names = [id] if report else [c for c in docs.columns if c != text]
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("rest"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks).cast("long"))).repartition(by_block, "block")
    grouped = rows.groupBy("block")
    hits = grouped.applyInArrow(_probes(bits, window), PROBES).repartition(by_share, "share").groupBy("share").applyInArrow(_hits, HITS)
    wins = grouped.cogroup(hits.repartition(by_block, "block").groupBy("block")).applyInArrow(_windows(bits, window), WINDOWS)
    late = wins.repartition(by_share, "share").groupBy("share").applyInArrow(_later, LATE)
    nothing = F.lit(None).cast("binary")
    marks = hits.select("block", "share", "hits", nothing.alias("late")).unionByName(late.select("block", "share", nothing.alias("hits"), "late"))
    out = T.StructType([rows.schema["rest"], *T._parse_datatype_string("n_words long, n_removed long, out string").fields])
    return grouped.cogroup(marks.repartition(by_block, "block").groupBy("block")).applyInArrow(_rebuild(bits, window, report), out)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return repeats(docs, report=True).select("rest.doc_id", "n_words", "n_removed", F.col("out").alias("kept_sha256"))


def without_repeats(docs: DataFrame, *, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, texts without their repeats."""
    found = repeats(docs, window=window, id=id, text=text)
    return found.select(*[F.col("out").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in docs.columns])
