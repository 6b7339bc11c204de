"""Language-model scoring by a weighted backoff automaton.

Counts of n-grams up to order 3 are smoothed by interpolated absolute discounting and become an automaton: a state is a
context that training text holds, an arc a word seen after it, weighted by the word's log-probability there, and where a
state has no arc for a word, its failure arc leads to the next shorter context at the weight that is left over there. A
text is read once from left to right: its state goes from word to word along arcs and failure arcs, and their weights add
up. Texts of a block are read side by side, a word of each at a time. A state is at most two words, so that a long text
may be read in stretches of LANE words at once, each from two words before. All probabilities of a context sum to 1,
unknown words being one more word.

Documents are turned once into blocks of bounded bytes, each a file in the shared folder: word hashes, and each word of
the block by its index among the block's distinct words. Every n-gram of the training text counts, whatever its words
and however rare it is. As their number grows with the input, no task ever holds them all: blocks send their distinct
n-grams with counts to shares of the hash space and get the totals back. Orders go from 3 down to 1, since a share also
names one block as an n-gram's owner, and owners tell the context how many different words follow it, which is what its
failure arc weighs. So every block ends up with the states and arcs that its own texts can reach, at any size of input.
Words and n-grams are told apart by 64-bit hashes.

Defined results: a null or empty text is its end alone. Without training text every token is unknown with probability
1, so that both scores are 0. Rows with a null id are training rows. Repeated rows count and are scored each. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, planes, regroup, release, small_batches, tasks, unplanes
from .tokenfile import get, put
from .words import Words, extended, grams, whole

#: Bounds on the discount of unigrams, which follows from how many words occur once and twice.
LEAST, MOST = 0.1, 0.95
#: The end of a text, as a word's hash. (Words' hashes are mixed; none is likely to be this.)
END = np.uint64(0x00E2D00E2D00E2D1)
DISCOUNT = 0.75
BLOCK = 8 << 20
GRAMS_OF_A_SHARE = 1 << 21
#: Tokens of a text that are read in one stretch.
LANE = 256


def _held(ids: list) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids], bool)


def _blocks(uri: str):
    """Documents -> block files: ids, which are held out, tokens of each, token stream, distinct words; and their figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0
        for b in regroup(batches, BLOCK):
            h, counts = [], []
            for lo in range(0, b.num_rows, 1024):
                w = Words(b["text"].slice(lo, 1024), lower=True)
                h.append(np.insert(w.hashes(), w.at[1:], END))
                counts.append(w.counts() + 1)
            size = np.concatenate(counts)
            distinct, token = np.unique(np.concatenate(h), return_inverse=True)
            held = _held(b["id"].to_pylist())
            block = (task << 24) + seq
            whole_block = pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b["id"]),
                    pa.array([held.tobytes()], pa.binary()),
                    pa.array([planes(size)], pa.binary()),
                    pa.array([planes(token)], pa.binary()),
                    pa.array([distinct.tobytes()], pa.binary()),
                ],
                names=["ids", "held", "size", "token", "words"],
            )
            put(uri, f"block-{block}", _packed(whole_block))
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n_train": pa.array([int(size[~held].sum())], pa.int64()), "n": pa.array([len(token)], pa.int64())})
            seq += 1

    return run


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


class Block:
    """A block read again. Of each order: distinct n-grams ascending by hash, and which of them ends at a position, or -1."""

    def __init__(self, uri: str, block: int) -> None:
        b = _unpacked(get(uri, f"block-{block}"))
        self.ids = b["ids"].values
        held, size, token, words = (b[c][0].as_py() for c in ("held", "size", "token", "words"))
        self.held, self.size, self.token, self.words = np.frombuffer(held, bool), unplanes(size), unplanes(token), np.frombuffer(words, np.uint64)
        self.doc = np.repeat(np.arange(len(self.size), dtype=np.int32), self.size)
        self.train = np.repeat(~self.held, self.size)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        if order == 1:
            return self.words, self.token
        ok = whole(self.doc, order)
        distinct, index = np.unique(grams(self.words[self.token], order)[ok], return_inverse=True)
        at = np.full(len(self.token), -1, np.int64)
        at[np.flatnonzero(ok) + order - 1] = index
        return distinct, at

    def counts(self, n: int, at: np.ndarray) -> np.ndarray:
        """How often each of n distinct n-grams occurs in training text."""
        return np.bincount(at[(at >= 0) & self.train], minlength=n)


def _bound(share: np.ndarray, bits: int) -> np.ndarray:
    """Where shares of the hash space begin, of which there are 2**bits."""
    return share.astype(np.uint64) << np.uint64(64 - bits) if bits else np.zeros(len(share), np.uint64)


def _request(block: int, grams: np.ndarray, train: np.ndarray, follow: np.ndarray | None, bits: int) -> dict:
    """For each share of the hash space where the block has n-grams, these as steps, and their figures; at least one row."""
    share = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    first = np.flatnonzero(np.diff(share, prepend=-1))
    names = share[first] if len(first) else np.zeros(1, np.int64)
    edges = np.append(first, len(grams)) if len(first) else np.zeros(2, np.int64)
    bounds = _bound(names, bits)
    at = list(zip(bounds, edges[:-1].tolist(), edges[1:].tolist()))
    return {
        "block": pa.array([block] * len(at), pa.int64()),
        "share": pa.array(names),
        "grams": pa.array([planes(np.diff(grams[x:y], prepend=s)) for s, x, y in at], pa.binary()),
        "train": pa.array([planes(train[x:y]) for _, x, y in at], pa.binary()),
        "follow": pa.array([None if follow is None else planes(follow[x:y]) for _, x, y in at], pa.binary()),
    }


REQUEST = "block long, share long, grams binary, train binary, follow binary"


def _first(uri: str, bits: int):
    """Blocks -> their requests for n-grams of order 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b["block"].to_pylist():
                x = Block(uri, block)
                distinct, at = x.grams(3)
                yield pa.RecordBatch.from_pydict(_request(block, distinct, x.counts(len(distinct), at), None, bits))
        release()

    return run


def _whole(replies: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([unplanes(x.as_py()) for x in replies[column]])


def _next(uri: str, order: int, bits: int):
    """Replies for one order -> a file of them, and the block's requests for the order below, which its owned n-grams follow."""

    def run(key: tuple, replies: pa.Table) -> pa.Table:
        block = key[0].as_py()
        replies = replies.sort_by("share")
        total, own = _whole(replies, "total"), _whole(replies, "own").astype(bool)
        types = _whole(replies, "types") if order == 2 else np.zeros(0, np.int64)
        put(uri, f"totals-{order}-{block}", _packed(pa.RecordBatch.from_pydict({"total": pa.array([planes(total)], pa.binary()), "types": pa.array([planes(types)], pa.binary())})))
        x = Block(uri, block)
        distinct, at = x.grams(order)
        last = np.zeros(len(distinct), np.int64)
        ends = np.flatnonzero(at >= 0)
        last[at[ends]] = ends
        lower, below = x.grams(order - 1)
        follow = np.bincount(below[last[own] - 1], minlength=len(lower))
        out = pa.table(_request(block, lower, x.counts(len(lower), below), follow, bits))
        release()
        return out

    return run


def _totals(order: int, bits: int):
    """Share -> each block's totals, in the order of its n-grams: how often, how many words follow, whether it owns it.

    The owner is the first block that has the n-gram in training text. Order 1 adds figures under block -1.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bound = _bound(np.array([key[0].as_py()]), bits)[0]
        parts = [np.cumsum(unplanes(x.as_py()).view(np.uint64), dtype=np.uint64) + bound for x in table["grams"]]
        distinct, at = np.unique(np.concatenate(parts), return_inverse=True)
        train = _whole(table, "train")
        total = np.bincount(at, weights=train, minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in parts])
        spans = [(e - len(x), e) for x, e in zip(parts, ends)]
        blocks, extra = table["block"].to_pylist(), order == 1
        out = {"total": [planes(total[at[a:e]]) for a, e in spans], "types": [None] * len(blocks), "own": [None] * len(blocks)}
        if order < 3:
            types = np.bincount(at, weights=_whole(table, "follow"), minlength=len(distinct)).astype(np.int64)
            out["types"] = [planes(types[at[a:e]]) for a, e in spans]
        if order > 1:
            seen = np.flatnonzero(train)[::-1]
            first = np.full(len(distinct), -1, np.int64)
            first[at[seen]] = seen  # the last one written is the first there is
            own = first[at] == np.arange(len(at))
            out["own"] = [planes(own[a:e].astype(np.int64)) for a, e in spans]
        figures = {"known": int((total > 0).sum()), "once": int((total == 1).sum()), "twice": int((total == 2).sum())}
        tail = [None] * extra
        release()
        return pa.table(
            {
                "block": pa.array([*blocks, *([-1] * extra)], pa.int64()),
                "share": pa.array([key[0].as_py()] * (len(blocks) + extra), pa.int64()),
                **{k: pa.array([*v, *tail], pa.binary()) for k, v in out.items()},
                **{k: pa.array([*([None] * len(blocks)), *([v] * extra)], pa.int64()) for k, v in figures.items()},
            }
        )

    return run


REPLY = "block long, share long, total binary, types binary, own binary, known long, once long, twice long"


@dataclass
class Model:
    n: int
    v: int
    discount: float

    def unigrams(self, c: np.ndarray) -> np.ndarray:
        """Probability of words by their counts; a count of 0 is the one unknown word."""
        if not self.n:
            return np.ones(len(c))
        return np.where(c > 0, (c - self.discount) / self.n, self.discount * self.v / self.n)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1)))


@dataclass
class Order:
    """Distinct n-grams of one order, ascending by hash, and their figures in training text."""

    hash: np.ndarray
    total: np.ndarray  # how often
    types: np.ndarray  # how many different words follow
    context: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # in the order below: all words but the last
    suffix: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # in the order below: all words but the first


class Keys:
    """Finds hashes among ascending ones by their first bits: a few steps each, however many there are."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, bits = keys, max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))])

    def find(self, q: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        head = (q >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        out, open_ = np.full(len(q), -1, np.int64), np.flatnonzero(at < end)
        while len(open_):
            place = at[open_]
            same = self.keys[place] == q[open_]
            out[open_[same]] = place[same]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


class Automaton:
    """States are 0, the empty context; 1 + i, the i-th word; 1 + n + j, the j-th pair of words.

    arcs: of each order, the n-grams of training text, found by hash, each with log10 probability and target state.
    """

    def __init__(self, model: Model, orders: list[Order]) -> None:
        one, two, three = orders
        self.words, self.n = one.hash, len(one.hash)
        p = model.unigrams(one.total)
        self.start = np.log10(p), np.where(one.total > 0, 1 + np.arange(self.n), 0)
        self.state_hash = np.concatenate([np.zeros(1, np.uint64), one.hash, two.hash])
        self.fail = np.concatenate([[0], np.zeros(self.n, np.int64), 1 + two.suffix])
        left = [np.where(o.total > 0, DISCOUNT * o.types / np.maximum(o.total, 1), 1.0) for o in (one, two)]
        with np.errstate(divide="ignore"):  # nothing follows an end
            self.left = np.log10(np.concatenate([[1.0], *left]))
        self.arcs: list[tuple[Keys, np.ndarray, np.ndarray]] = []
        for lower, weight, o, target in ((one, left[0], two, 1 + self.n + np.arange(len(two.hash))), (two, left[1], three, 1 + self.n + three.suffix)):
            p = np.maximum(o.total - DISCOUNT, 0) / np.maximum(lower.total[o.context], 1) + weight[o.context] * p[o.suffix]
            seen = np.flatnonzero(o.total)
            self.arcs.append((Keys(o.hash[seen]), np.log10(p[seen]), target[seen]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state goes on a word, and at what weight."""
        state, gain, to = state.copy(), np.zeros(len(state)), np.full(len(state), -1, np.int64)
        for length in (2, 1):
            at = np.flatnonzero((state > self.n) if length == 2 else (state > 0) & (to < 0))
            if not len(at):
                continue
            keys, weight, target = self.arcs[length - 1]
            arc = keys.find(extended(self.state_hash[state[at]], self.words[word[at]]))
            hit, miss = arc >= 0, at[arc < 0]
            to[at[hit]] = target[arc[hit]]
            gain[at[hit]] += weight[arc[hit]]
            gain[miss] += self.left[state[miss]]
            state[miss] = self.fail[state[miss]]
        at = np.flatnonzero(to < 0)
        gain[at] += self.start[0][word[at]]
        to[at] = self.start[1][word[at]]
        return to, gain

    def read(self, token: np.ndarray, size: np.ndarray, lane: int = LANE) -> np.ndarray:
        """log10 probability of each text; size: tokens of each, at least 1."""
        lanes = -(-size // lane)
        text = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        warm = np.where(nth > 0, min(2, lane), 0)
        begin = (np.cumsum(size) - size)[text] + nth * lane - warm
        length = np.minimum(size[text] - nth * lane, lane) + warm
        order = np.argsort(-length, kind="stable")
        begin, length, warm, text = begin[order], length[order], warm[order], text[order]
        live = len(length) - np.searchsorted(length[::-1], np.arange(int(length.max(initial=0))), side="right")
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for t, k in enumerate(live.tolist()):
            state[:k], gain = self.step(state[:k], token[begin[:k] + t])
            total[:k] += np.where(warm[:k] <= t, gain, 0.0)
        return np.bincount(text, weights=total, minlength=len(size))


def _orders(x: Block, figures: list[tuple[np.ndarray, np.ndarray]]) -> list[Order]:
    """The block's n-grams of each order with (total, types) of each."""
    out, below = [], x.token
    for k, (total, types) in enumerate(figures, 1):
        distinct, at = x.grams(k)
        o = Order(distinct, total, types)
        if k > 1:
            ends = np.flatnonzero(at >= 0)
            o.context, o.suffix = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            o.context[at[ends]], o.suffix[at[ends]] = below[ends - 1], below[ends]
        out.append(o)
        below = at
    return out


def _scored(uri: str, m: Model):
    def run(key: tuple, replies: pa.Table) -> pa.Table:
        block = key[0].as_py()
        x = Block(uri, block)
        replies = replies.sort_by("share")
        figures = [(_whole(replies, "total"), _whole(replies, "types"))]
        for order in (2, 3):
            b = _unpacked(get(uri, f"totals-{order}-{block}"))
            figures.append((unplanes(b["total"][0].as_py()), unplanes(b["types"][0].as_py())))
        c = figures[0][0]
        log_p = Automaton(m, _orders(x, figures)).read(x.token, x.size)
        starts = np.cumsum(x.size) - x.size
        out = pa.table(
            {
                "doc_id": x.ids,
                "held_out": x.held,
                "n_tokens": x.size,
                "n_known": np.add.reduceat((c > 0)[x.token].astype(np.int64), starts),
                "train_tokens": np.full(len(x.size), m.n, np.int64),
                "base_score": np.add.reduceat(m.base(c)[x.token], starts),
                "score": log_p,
            }
        )
        release()
        return out

    return run


def score(docs: DataFrame, *, id: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the documents whose crc32(id as text) mod 10 is not 0.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "lm")
    uri = scratch.path("files")
    rows = only(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    blocks = scratch.save(rows.mapInArrow(_blocks(uri), "block long, n_train long, n long"), "blocks")
    n, tokens, count = (int(x or 0) for x in blocks.agg(F.sum("n_train"), F.sum("n"), F.count("*")).first())
    bits = max(0, (-(-tokens // GRAMS_OF_A_SHARE) - 1).bit_length())
    by_block, by_share = tasks(count), tasks(1 << bits)
    requests = blocks.select("block").repartition(by_block).mapInArrow(_first(uri, bits), REQUEST)
    for order in (3, 2, 1):
        replies = requests.repartition(by_share, "share").groupBy("share").applyInArrow(_totals(order, bits), REPLY)
        replies = scratch.save(replies, f"replies-{order}", free=True)
        scratch.drop(f"replies-{order + 1}")
        if order > 1:
            requests = replies.repartition(by_block, "block").groupBy("block").applyInArrow(_next(uri, order, bits), REQUEST)
    known, once, twice = (int(x or 0) for x in replies.agg(F.sum("known"), F.sum("once"), F.sum("twice")).first())
    discount = min(MOST, max(LEAST, once / (once + 2 * twice))) if once + twice else DISCOUNT
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    mine = replies.where("block >= 0").select("block", "share", "total", "types").repartition(by_block, "block")
    return mine.groupBy("block").applyInArrow(_scored(uri, Model(n, known, discount)), out)
