"""Quality classifier: zstandard dictionaries of good and bad labelled text; compressed sizes become a calibrated score.

A text is cut into pieces of PIECE bytes, each compressed under both dictionaries, so that a long text cannot serve as
its own dictionary. The difference of the two compressed sizes, normalised by the text's own size, is all that the score
looks at: a logistic function of it is fitted on other labelled rows than those in the dictionaries. A short text says
little, so its difference is drawn towards the mean difference, half way at HALF bytes. The sample holds both labels
alike; the fit weighs them by their shares among all labels, so that the score is a probability. Whole texts are scored.

Defined results: a null or empty text scores the share of label 1 among all labels; with labels of one class only, every
text scores that share; without any labelled row, 0.5. A document labelled twice counts with its lower label, one with
several texts with the first of them in binary order. Labels of unknown documents, null labels and null ids are not
learnt from. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, small_batches

PIECE = 512
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
#: The bounded training sample, which the driver holds: so many labelled rows of each class, texts above MAX_TEXT
#: characters left out, and so many bytes of text of each class.
PER_CLASS = 3000
MAX_TEXT = 1 << 16
MAX_BYTES = 32 << 20
#: Bytes of text at which its own difference and the mean difference weigh the same.
HALF = 20


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained zstandard dictionary; the samples' own bytes where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class Sizer:
    """Compressed size under one dictionary, without what an empty frame takes."""

    def __init__(self, raw: bytes) -> None:
        data = zstandard.ZstdCompressionDict(raw) if raw else None
        if data:
            data.precompute_compress(level=LEVEL)
        self.one = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.frame = len(self.one.compress(b""))

    def __call__(self, parts: list[bytes]) -> int:
        compress = self.one.compress
        return sum(len(compress(p)) for p in parts) - self.frame * len(parts)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float]  # intercept and slope
    base: float
    center: float = 0.0

    def sizers(self) -> tuple[Sizer, Sizer]:
        return Sizer(self.good), Sizer(self.bad)

    def score(self, text: str | None, sizers: tuple[Sizer, Sizer]) -> float:
        parts = pieces(text)
        if not parts or not self.weights:
            return self.base
        z = self.weights[0] + self.weights[1] * drawn(*difference(parts, *sizers), self.center)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    def column(self, text: Column) -> Column:
        """The score as a column expression."""
        model = self

        @F.pandas_udf("double")
        def quality(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            sizers = model.sizers()
            for t in texts:
                yield pd.Series([model.score(x, sizers) for x in t], dtype="float64")

        return quality(text)


def difference(parts: list[bytes], good: Sizer, bad: Sizer) -> tuple[float, int]:
    """The normalised difference of the compressed sizes, higher for good text, and the text's size."""
    n = sum(map(len, parts))
    return (bad(parts) - good(parts)) / n, n


def drawn(x: float, size: int, center: float) -> float:
    """A difference's distance from the mean one, less for short texts."""
    return (x - center) * size / (size + HALF)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Newton's method on standardised features and weighted rows; the weights for the plain features."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return [float(w[0] - (w[1:] * mean / sd).sum()), *(float(v) for v in w[1:] / sd)]


def fit_texts(good: list[str], bad: list[str], share: float | None = None) -> QualityModel:
    """Every second text goes into a dictionary, the others calibrate. share: of label 1 among all labels."""
    base = share if share is not None else len(good) / (len(good) + len(bad)) if good or bad else 0.5
    if not good or not bad:
        return QualityModel(b"", b"", [], base)
    dicts = [dictionary([p for t in texts[::2] for p in pieces(t)]) for texts in (good, bad)]
    sizers = Sizer(dicts[0]), Sizer(dicts[1])
    rows = [(*difference(p, *sizers), y) for y, texts in ((1, good), (0, bad)) for t in (texts[1::2] or texts) if (p := pieces(t))]
    y = np.array([r[2] for r in rows], float)
    if len(set(y)) < 2:
        return QualityModel(*dicts, [], base)
    center = float(np.mean([r[0] for r in rows]))
    weight = np.where(y == 1, base / y.mean(), (1 - base) / (1 - y.mean()))
    return QualityModel(*dicts, logistic(np.array([[drawn(x, n, center)] for x, n, _ in rows]), y, weight), base, center)


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", train: Column | None = None, per_class: int = PER_CLASS, max_text: int = MAX_TEXT, max_bytes: int = MAX_BYTES) -> QualityModel:
    """Fit on a bounded sample: at most per_class documents of either label, by a hash of the id, and max_bytes of their texts.

    train: which rows of labels (by their column id) may be learnt from.
    """
    small_batches(docs.sparkSession)
    known = only(labels, id=id, label=label).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    if train is not None:
        known = known.where(train)
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    order = F.xxhash64(F.lit("sample"), F.col("id"))
    picked = known.where("label = 1").orderBy(order, "id").limit(per_class).unionByName(known.where("label = 0").orderBy(order, "id").limit(per_class))
    # at most 2 * per_class ids: the bound that the broadcast needs
    texts = only(docs, id=id, text=text).join(F.broadcast(picked), "id").where(F.length("text") <= max_text)
    texts = texts.groupBy("id", "label").agg(F.min("text").alias("text"))  # one text of each id, however often it occurs
    held = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = texts.withColumn("held", held).where(F.col("held") <= max_bytes).select("id", "label", "text").collect()
    rows = sorted((tuple(r) for r in rows), key=lambda r: (hash_id(r[0]), r))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else None
    return fit_texts([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0], share)


def hash_id(key: object) -> int:
    import zlib

    return zlib.crc32(f"order {key}".encode())


def held_out(id: str, of: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % of == remainder, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns only from labelled rows that are not held out."""
    model = fit(docs, labels, train=~held_out("id", 4, 2))
    return only(docs, doc_id="doc_id", text="text").select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), model.column(F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    model = fit(docs, labels, train=~held_out("id", 4, 2))
    return docs.where(model.column(F.col("text")) >= threshold)
