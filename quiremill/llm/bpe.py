"""BPE encoding and decoding with the tokenizers library, exact, for texts of any length.

Texts of more than LEAF bytes are encoded by tree concatenation: they are cut into halves until these are short, wherever
that falls, all halves of a batch are encoded side by side, and around each join a window that grows to both sides is
encoded anew until it agrees with either half in whole pieces. Pieces end where a cut cannot change a token (see cuts());
each distinct piece of a batch is encoded once and its ids are gathered by index.

A pre-token of more than LONG characters (text that the tokenizer cannot split, so that it is one piece) has its leaves
encoded as rows of their own, by different tasks. There windows agree by tokens: the last one taken over from the left
half, and the first one from the right half. Why one token on each side is enough: a sequence of BPE tokens is the
encoding of its text if and only if each two neighbours are the encoding of theirs. After a join each two neighbours come
from one half or from the window.

Defined results: a null text is empty and has no ids. The special tokens' strings in a text are those tokens, as the
library has it by default; such a text is encoded in one call. Repeated rows are encoded each. Null ids of rows are kept.
Other columns are never read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import only, regroup, small_batches
from .words import text_bytes

#: Characters of a pre-token from which on its leaves are encoded apart, and of each leaf.
LONG = 1 << 12
#: Bytes of a half that is not cut any further.
LEAF = 1 << 11
#: First window on either side of a join, in characters; in pieces, where the text has pieces.
WINDOW = 64
PIECES = 2
#: Distinct pieces that a worker remembers from batch to batch.
KEEP = 600_000
#: Pieces that are encoded in one call.
CALL = 4096

@lru_cache(8)
def tokenizer(path: str, normal: bool = True) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if not normal:
        from tokenizers import normalizers

        t.normalizer = normalizers.Sequence([])
    return t


@lru_cache(8)
def token_bytes(path: str) -> np.ndarray:
    """How many bytes of text each id stands for (byte-level vocabularies: one character of a token is one byte)."""
    t = tokenizer(path)
    out = np.zeros(t.get_vocab_size(with_added_tokens=True), np.int64)
    special = {a.content for a in t.get_added_tokens_decoder().values()}
    for token, i in t.get_vocab(with_added_tokens=True).items():
        out[i] = len(token.encode()) if token in special else len(token.removesuffix("</w>"))
    return out


def encode_one(t: Tokenizer, text: str) -> np.ndarray:
    return np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)


# tree concatenation of one pre-token


def join_halves(path: str, left: str, right: str, a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The ids of left + right, one pre-token, from those of its halves."""
    t, size = tokenizer(path, normal=False), token_bytes(path)
    a_end, b_end = np.cumsum(size[a]), np.cumsum(size[b])
    a_begin, b_begin = a_end - size[a], b_end - size[b]
    cut = int(a_end[-1]) if len(a) else 0
    while True:
        lo, hi = max(0, len(left) - window), min(len(right), window)
        w = encode_one(t, left[lo:] + right[:hi])
        if lo == 0 and hi == len(right):
            return w
        w_end = np.cumsum(size[w]) + len(left[:lo].encode())
        w_begin = w_end - size[w]
        i = j = m = 0
        k = len(b)
        ok = True
        if lo:  # the last token of the left half that the window has as well
            both = {(int(w_begin[x]), int(w[x])): x for x in np.flatnonzero(w_end <= cut)}
            i = next((x for x in range(len(a) - 1, -1, -1) if (int(a_begin[x]), int(a[x])) in both), -1)
            ok = i >= 0 and a_begin[i] >= w_begin[0]
            if ok:
                j = both[(int(a_begin[i]), int(a[i]))] + 1
                i += 1
        m = len(w)
        if ok and hi < len(right):  # the first token of the right half that the window has as well
            both = {(int(w_begin[x]) - cut, int(w[x])): x for x in np.flatnonzero(w_begin >= cut)}
            far = int(w_end[-1]) - cut
            k = next((x for x in range(int(np.searchsorted(b_begin, far))) if (int(b_begin[x]), int(b[x])) in both), -1)
            ok = k >= 0
            if ok:
                m = both[(int(b_begin[k]), int(b[k]))]
        if ok:
            return np.concatenate([a[:i], w[j:m], b[k:]])
        window *= 2


def leaves(text: str, size: int = LONG) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def join_tree(path: str, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
    while len(parts) > 1:
        paired = [(x + y, join_halves(path, x, y, a, b)) for (x, a), (y, b) in zip(parts[::2], parts[1::2])]
        parts = paired + parts[len(parts) & ~1 :]
    return parts[0][1]


def long_runs(path: str, text: str, size: int = LONG) -> tuple[str, list[tuple[int, int]]]:
    """The normalised text, and where in it pre-tokens of more than `size` characters lie, cut by the library itself."""
    t = tokenizer(path)
    if len(text) <= size or any(a.content in text for a in t.get_added_tokens_decoder().values()):
        return text, []
    text = t.normalizer.normalize_str(text) if t.normalizer else text
    cuts = t.pre_tokenizer.pre_tokenize_str(text) if t.pre_tokenizer else [(text, (0, len(text)))]
    runs = [at for _, at in cuts if at[1] - at[0] > size]
    one = lambda s: not t.pre_tokenizer or len(t.pre_tokenizer.pre_tokenize_str(s)) == 1
    return text, [(a, b) for a, b in runs if all(one(x) for x in leaves(text[a:b], size))]


def encode_tree(path: str, text: str, size: int = LONG) -> np.ndarray:
    """Ids of a whole text, its long pre-tokens by tree concatenation, in one process."""
    normal, runs = long_runs(path, text, size)
    if not runs:
        return encode_one(tokenizer(path), text)
    t, out, at = tokenizer(path, normal=False), [], 0
    for a, b in runs:
        out += [encode_one(t, normal[at:a]), join_tree(path, [(x, encode_one(t, x)) for x in leaves(normal[a:b], size)])]
        at = b
    return np.concatenate([*out, encode_one(t, normal[at:])])


# batches


class Encoder:
    """Encodes Arrow text columns: each distinct piece once, remembered within bounds."""

    def __init__(self, path: str) -> None:
        self.path, self.t = path, tokenizer(path)
        self.dtype = np.uint16 if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.drops = not len(encode_one(self.t, " "))  # white space leaves no token
        mark = "\0" if self.drops else "\x0b"
        found = encode_one(self.t, mark)
        symbol = self.t.id_to_token(int(found[0])).removesuffix("</w>") if len(found) == 1 else None
        # a mark between pieces serves only where it is one token that no other token contains
        alone = symbol is not None and sum(symbol in token for token in self.t.get_vocab()) <= 2
        self.mark, self.mark_id = (mark, int(found[0])) if alone else (None, -1)
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.known = pa.array([], pa.string())
        self.ids, self.edge = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and n+1 edges of pieces that are encoded on their own."""
        flat, size = [], []
        glue = f" {self.mark} " if self.drops else self.mark
        for lo in range(0, len(pieces), CALL):
            part = pieces[lo : lo + CALL]
            if self.mark:
                ids = np.array(self.t.encode_batch_fast([glue.join(part)], add_special_tokens=False)[0].ids, self.dtype)
                at = np.flatnonzero(ids == self.mark_id)
                if len(at) == len(part) - 1:
                    flat.append(np.delete(ids, at))
                    size.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
                    continue
            each = [encode_tree(self.path, p) for p in part]
            flat.append(np.concatenate(each).astype(self.dtype))
            size.append(np.array([len(e) for e in each]))
        size_ = np.concatenate(size) if size else np.zeros(0, np.int64)
        return (np.concatenate(flat) if flat else np.zeros(0, self.dtype)), np.concatenate([[0], np.cumsum(size_)])

    def distinct(self, pieces: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, begin, length) of distinct pieces. often: which are worth remembering."""
        where = pc.index_in(pieces, value_set=self.known)
        fresh = np.asarray(where.is_null())
        new = pieces.filter(pa.array(fresh))
        ids, edge = self.many(new.to_pylist())
        begin, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        at = where.drop_null().to_numpy()
        begin[~fresh], size[~fresh] = self.edge[at], np.diff(self.edge)[at]
        begin[fresh], size[fresh] = edge[:-1] + len(self.ids), np.diff(edge)
        every = np.concatenate([self.ids, ids])
        keep = np.flatnonzero(often[fresh])[: max(0, KEEP - len(self.known))]
        if len(keep):
            self.known = pa.concat_arrays([self.known, new.take(pa.array(keep))])
            n = np.diff(edge)[keep]
            self.ids = np.concatenate([self.ids, gather(ids, edge[:-1][keep], n)])
            self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(n)])
        return every, begin, size

    def joined(self, data: np.ndarray, edges: np.ndarray, seams: np.ndarray, rows: np.ndarray, every: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces' ids with those around the joins of halves encoded anew.

        seams: pieces that begin a right half, ascending; rows: pieces that begin a row. begin, size: of pieces in every.
        """
        row = np.searchsorted(rows, seams, side="right")
        first, last = rows[row - 1], rows[row]
        reach = np.full(len(seams), PIECES)
        open_ = np.arange(len(seams))
        found: list[tuple[int, int, np.ndarray]] = []
        while len(open_):
            lo, hi = np.maximum(seams[open_] - reach[open_], first[open_]), np.minimum(seams[open_] + reach[open_], last[open_])
            new = np.append(True, lo[1:] >= np.maximum.accumulate(hi)[:-1])  # windows that meet are one window
            group = np.cumsum(new) - 1
            lo, hi, head, tail = lo[new], np.maximum.reduceat(hi, np.flatnonzero(new)), first[open_][new], last[open_][new]
            flat, at = self.many([data[edges[a] : edges[b]].tobytes().decode() for a, b in zip(lo, hi)])
            again = np.zeros(len(lo), bool)
            for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
                w = flat[at[i] : at[i + 1]]
                x, y = every[begin[a] : begin[a] + size[a]], every[begin[b - 1] : begin[b - 1] + size[b - 1]]
                # at a row's edge there is no half to agree with
                left = a == head[i] or (0 < len(x) <= len(w) and (w[: len(x)] == x).all())
                right = b == tail[i] or (0 < len(y) <= len(w) and (w[len(w) - len(y) :] == y).all())
                again[i] = not (left and right)
            redo = np.isin(head, head[again])  # all windows of such a row: those that grow may meet others
            found += [(int(lo[i]), int(hi[i]), flat[at[i] : at[i + 1]]) for i in np.flatnonzero(~redo)]
            reach[open_[again[group]]] *= 2
            open_ = open_[redo[group]]
        begin, size, base = begin.copy(), size.copy(), len(every)
        for a, b, w in found:
            begin[a], size[a : b] = base, 0
            size[a] = len(w)
            base += len(w)
        return np.concatenate([every, *[w for _, _, w in found]]), begin, size

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all rows and the n+1 row edges."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        n = len(texts)
        special = np.zeros(n, bool)
        for token in self.special:
            special |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        easy = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        data, off = text_bytes(easy)
        seams = halves(data, off)
        cut = np.flatnonzero(cuts(data, np.union1d(off, seams)))
        edges = np.append(cut, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(cut), pa.py_buffer(edges), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        index = coded.indices.to_numpy()
        often = np.bincount(index, minlength=len(coded.dictionary)) > 1
        every, begin, size = self.distinct(coded.dictionary, often)
        begin, size = begin[index], size[index]
        if len(seams):
            every, begin, size = self.joined(data, edges, np.searchsorted(cut, seams), np.searchsorted(cut, off), every, begin, size)
        flat = gather(every, begin, size)
        row = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(cut, off)]
        if special.any():
            parts = [encode_one(self.t, texts[i].as_py()).astype(self.dtype) if special[i] else flat[row[i] : row[i + 1]] for i in range(n)]
            flat, row = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return flat, row


_KIND = np.full(256, 4, np.uint8)  # high bytes
_KIND[:33] = 0
_KIND[127] = 0  # white space, control
_KIND[33:127] = 2  # marks
_KIND[48:58] = 3  # digits
_KIND[65:91] = 1
_KIND[97:123] = 1  # letters


def cuts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes before which a text may be cut without changing a token, whatever lies beyond the next bytes.

    The tokenizers' patterns read runs of letters, digits, marks or white space, a space going with what follows it, and
    read on from each cut as from a text's start. So cuts lie before a space that follows no white space, or that stands
    between white space and something else; between a letter and a mark, but for apostrophes before letters; and
    around a single line feed between a printed character and a letter.
    """
    n = len(data)
    out = np.zeros(n + 1, bool)
    if n:
        kind = _KIND[data]
        after = np.append(kind[1:], 0)
        before = np.insert(kind[:-1], 0, 0)
        printed = (before >= 1) & (before <= 3)
        space = data == 32
        out[:n] = space & (printed | ((before == 4) & (after >= 1) & (after <= 3)))
        # Latin letters of two bytes count as letters; others might be anything
        letter = kind == 1
        last = np.zeros(n, bool)
        last[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        ends = letter | last
        mark = kind == 2
        out[1:n] |= ends[:-1] & mark[1:]
        out[1:n] |= mark[:-1] & (data[:-1] != 39) & letter[1:]
        feed = (data == 10) & printed & (after == 1)
        out[:n] |= feed
        out[1:n] |= feed[:-1]
        out[n] = False
    out[off] = True
    return out[:n]


def halves(data: np.ndarray, off: np.ndarray, leaf: int = 0) -> np.ndarray:
    """Bytes before which the rows of more than `leaf` bytes are cut into halves, and these again; whole characters."""
    out, size = [], np.diff(off)
    for i in np.flatnonzero(size > (leaf or LEAF)):
        parts = 1 << int(-(-int(size[i]) // (leaf or LEAF)) - 1).bit_length()
        out.append(off[i] + size[i] * np.arange(1, parts, dtype=np.int64) // parts)
    if not out:
        return np.zeros(0, np.int64)
    at = np.concatenate(out)
    for _ in range(3):  # on to a character's first byte
        at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    return np.setdiff1d(at, off)


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin : begin + size] of every run, one after another."""
    total = int(size.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((begin - (np.cumsum(size) - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return values[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Decoder:
    """Texts of id rows, as the library decodes them with special tokens kept."""

    def __init__(self, path: str) -> None:
        self.t = tokenizer(path)
        self.tokens = None
        if self.t.decoder is None:  # then tokens are joined by a space
            vocab = self.t.get_vocab(with_added_tokens=True)
            names = [""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                names[i] = token
            self.tokens = pa.array(names, pa.string())

    def column(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        if self.tokens is None:
            return pa.array(self.t.decode_batch([ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:])], skip_special_tokens=False), pa.string())
        rows = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), self.tokens.take(pa.array(ids)))
        return pc.binary_join(rows, " ")


def has_long(text: str) -> object:
    """A column: the text has a stretch without spaces that may hold a long pre-token."""
    return F.coalesce(F.length(text) > LONG, F.lit(False)) & F.exists(F.split(F.col(text), " "), lambda x: F.length(x) > LONG)


def encode(docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", then: Callable | None = None, schema: str = "") -> DataFrame:
    """id and ids (binary: little-endian unsigned 32-bit) of every row.

    then: a step over batches of these, with its schema, that runs in the same worker.
    """
    small_batches(docs.sparkSession)
    rows = only(docs, id=id, text=text)
    kind = rows.schema["id"].dataType.simpleString()
    schema = schema or f"id {kind}, ids binary"

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in regroup(batches):
            flat, edges = e.column(b["text"])
            raw = flat.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([raw[4 * x : 4 * y] for x, y in zip(edges[:-1], edges[1:])], pa.binary())], names=["id", "ids"])

    def piped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(plain(batches)) if then else plain(batches)

    long = _encode_long(rows.where(has_long("text")), path, kind)
    return rows.where(~has_long("text")).mapInArrow(piped, schema).unionByName(long.mapInArrow(then, schema) if then else long)


def _encode_long(rows: DataFrame, path: str, kind: str) -> DataFrame:
    """Texts with long pre-tokens: leaves and the stretches between them by any task, then joined by document."""
    parts = f"row string, id {kind}, run int, part int, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                n, at, run = n + 1, 0, 0
                normal, runs = long_runs(path, text)
                row = f"{task}-{n}"
                if not runs:  # -1: not normalised yet
                    out.append((row, key, -1, 0, text))
                    continue
                for lo, hi in runs:
                    out.append((row, key, run, 0, normal[at:lo]))
                    out += [(row, key, run + 1, i, x) for i, x in enumerate(leaves(normal[lo:hi]))]
                    at, run = hi, run + 2
                out.append((row, key, run, 0, normal[at:]))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], b.schema.field("id").type), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.string())], names=["row", "id", "run", "part", "text"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode_one(tokenizer(path, normal=run < 0), x).astype("<u4").tobytes() for run, x in zip(b["run"].to_pylist(), b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], names=[*b.schema.names, "ids"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("part", "ascending")])
        out: list[np.ndarray] = []
        runs: dict[int, list[tuple[str, np.ndarray]]] = {}
        for run, text, ids in zip(table["run"].to_pylist(), table["text"].to_pylist(), table["ids"].to_pylist()):
            runs.setdefault(run, []).append((text, np.frombuffer(ids, "<u4")))
        for run in sorted(runs):
            out.append(join_tree(path, runs[run]))
        return pa.table({"id": table["id"].slice(0, 1), "ids": pa.array([np.concatenate(out).astype("<u4").tobytes()], pa.binary())})

    spread = rows.mapInArrow(cut, parts).repartition(F.col("row"), F.col("run"), F.col("part"))
    return spread.mapInArrow(each, f"{parts}, ids binary").groupBy("row").applyInArrow(joined, f"id {kind}, ids binary")


def digests(path: str):
    """Batches of (id, ids) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Decoder(path)
        for b in regroup(batches):
            rows = b["ids"].to_pylist()
            edges = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
            texts = d.column(np.frombuffer(b"".join(rows), "<u4"), edges)
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array(np.diff(edges)), pa.array([hashlib.sha256(r).hexdigest() for r in rows]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts.to_pylist()])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return encode(docs, path, then=digests(path), schema=f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
