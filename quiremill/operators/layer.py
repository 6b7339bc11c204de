"""The text layer: words to lines, its quality, whether to trust it, and merging with recognised text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box
from ..functions.text import not_blank, strip, undecodable_count, word_count
from ..sources.tables import PAGE, in_order
from .pagewise import Pages, folded, joined, keyed, low, pagewise


def _fold(keys: list[str], tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, cy_sum, h_sum, n = None, 0, 0.0, 0.0, 0
        for b in batches:
            at = list(zip(*(b[k].to_pylist() for k in keys)))
            y1, y2 = b["y1"].to_numpy(), b["y2"].to_numpy()
            cy, h = ((y1 + y2) / 2).tolist(), (y2 - y1).tolist()
            out = np.empty(b.num_rows, np.int32)
            for i, k in enumerate(at):
                if k != key:
                    key, row, n = k, 0, 0
                if n and abs(cy[i] - cy_sum / n) < tolerance * (h_sum / n):
                    cy_sum, h_sum, n = cy_sum + cy[i], h_sum + h[i], n + 1
                else:
                    row, cy_sum, h_sum, n = row + 1, cy[i], h[i], 1
                out[i] = row
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "row_id"])

    return run


def row_clusters(items: DataFrame, idx: str, keys: list[str] | None = None, tolerance: float = 0.6) -> DataFrame:
    """row_id of every item: by centre-y, an item joins the row at hand within 0.6 of its mean height of its mean centre.

    The mean moves with the row, so this is a fold; it runs over sorted partitions, one pass, page after page.
    """
    keys = keys or PAGE
    order = items.repartition(*keys).sortWithinPartitions(*keys, (F.col("y1") + F.col("y2")) / 2, idx)
    return order.mapInArrow(_fold(keys, tolerance), T.StructType([*items.schema.fields, T.StructField("row_id", T.IntegerType())]))


def grid_rows(items: DataFrame) -> DataFrame:
    """row_id where rows are known to be exact: equal y1 is one row. No Python; only for such input."""
    return items.withColumn("row_id", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("y1")))


def row_text(items: DataFrame, idx: str, keys: list[str] | None = None) -> DataFrame:
    """One line for each row: texts by x1, two spaces between, with the smallest x1 and y1."""
    keys = keys or PAGE
    return items.groupBy(*keys, "row_id").agg(in_order(F.col("text"), F.col("x1"), F.col(idx), separator="  ").alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.count("*").alias("n_items"))


def _rows(p: Pages, idx: str, exact: bool, tolerance: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """(order, row): items by page, row, x1 and place, and the row of each in that order."""
    y1, y2, at = p.numbers("y1"), p.numbers("y2"), low(p.numbers(idx))
    order = np.lexsort((at, low(y1 if exact else (y1 + y2) / 2), p.page))
    page, y1, y2 = p.page[order], y1[order], y2[order]
    if exact:
        y = low(y1)
        row = np.cumsum(np.concatenate([[True], (page[1:] != page[:-1]) | (y[1:] != y[:-1])])) if len(y) else np.empty(0, np.int64)
    else:
        row = folded(page, (y1 + y2) / 2, y2 - y1, tolerance)
    again = np.lexsort((at[order], low(p.numbers("x1"))[order], row, page))
    return order[again], row[again]


def _starts(*parts: np.ndarray) -> np.ndarray:
    new = np.zeros(len(parts[0]), bool)
    new[:1] = True
    for x in parts:
        new[1:] |= x[1:] != x[:-1]
    return new


def _number(x: np.ndarray) -> pa.Array:
    return pa.array(x, from_pandas=True)


PLACEHOLDER = ("please wait", "adobe reader")


def text_runs(words: DataFrame, idx: str = "token_idx", exact_rows: bool = False, wanted: DataFrame | None = None) -> DataFrame:
    """Runs of words: rows, cut where the gap to the word before exceeds 1.5 times the row's mean height.

    line_idx follows y (in steps of 20) and x. Whole pages go through arrays, after one shuffle of packed pages.
    exact_rows: equal y1 is one row, where rows are known to be exact. wanted: pages; each run then tells in wanted whether
    its page is one of them, and in is_placeholder what xfa_placeholder() says of its page: no join moves words or runs.
    """
    kinds, judged = words.schema, wanted is not None

    def step(p: Pages) -> dict[str, pa.Array]:
        order, row = _rows(p, idx, exact_rows)
        page, (x1, y1, x2, y2) = p.page[order], (p.numbers(c)[order] for c in ("x1", "y1", "x2", "y2"))
        new_row = _starts(page, row)
        first = np.flatnonzero(new_row)
        h = y2 - y1
        known = ~np.isnan(h)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.add.reduceat(np.where(known, h, 0.0), first) / np.add.reduceat(known.astype(np.int64), first) if len(first) else np.empty(0)
        mean = np.repeat(np.fmax(1.0, mean), np.diff(np.append(first, len(order))))
        cut = new_row.copy()
        cut[1:] |= x1[1:] - x2[:-1] > 1.5 * mean[1:]
        start = np.flatnonzero(cut)
        text = joined(p.cols["text"], order, start, " ")
        box = [f.reduceat(v, start) if len(start) else v for f, v in ((np.fmin, x1), (np.fmin, y1), (np.fmax, x2), (np.fmax, y2))]
        place = np.lexsort((low(box[0]), low(np.rint(box[1] / 20)), page[start]))
        at = page[start][place]
        top = np.flatnonzero(_starts(at))
        line = np.arange(len(at)) - np.repeat(top, np.diff(np.append(top, len(at))))
        told = {}
        if judged:
            told = {"wanted": pa.array(p.wanted[at]), "is_placeholder": pa.array(np.repeat(_placeholders(joined(text, place, top, " ")), np.diff(np.append(top, len(at)))))}
        return {**told, **keyed(p, PAGE, at), "text": text.take(pa.array(place)), **{c: _number(v[place]) for c, v in zip(("x1", "y1", "x2", "y2"), box)}, "n_words": pa.array(np.diff(np.append(start, len(order)))[place]), "line_idx": pa.array(line)}

    fields = [kinds[k] for k in PAGE] + [kinds["text"]] + [kinds[c] for c in ("x1", "y1", "x2", "y2")]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("n_words", T.LongType()), T.StructField("line_idx", T.IntegerType()), *([T.StructField(c, T.BooleanType()) for c in ("wanted", "is_placeholder")] if judged else [])])
    return pagewise(words, PAGE, [idx, "text", "x1", "y1", "x2", "y2"], step, schema, wanted)


def _placeholders(texts: pa.Array) -> np.ndarray:
    """Texts with both phrases. Arrow finds all that may have them; how they are lower-cased is settled for those alone."""
    low_ = pc.utf8_lower(texts)
    out = np.ones(len(texts), bool)
    for phrase in PLACEHOLDER:
        out &= np.asarray(pc.match_substring(low_, phrase).to_numpy(zero_copy_only=False), bool)
    for i in np.flatnonzero(out).tolist():
        out[i] = all(phrase in texts[i].as_py().lower() for phrase in PLACEHOLDER)
    return out


def row_texts(p: Pages, idx: str) -> dict[str, np.ndarray | pa.Array]:
    """page, row_id, text, x1, y1 and n_items of visual_rows()."""
    order, row = _rows(p, idx, False)
    page, x1, y1 = p.page[order], p.numbers("x1")[order], p.numbers("y1")[order]
    start = np.flatnonzero(_starts(page, row))
    box = [np.fmin.reduceat(v, start) if len(start) else v for v in (x1, y1)]
    return {"page": page[start], "row_id": row[start], "text": joined(p.cols["text"], order, start, "  "), "x1": box[0], "y1": box[1], "n_items": np.diff(np.append(start, len(order)))}


def visual_rows(items: DataFrame, idx: str, keys: list[str] | None = None) -> DataFrame:
    """row_text() of row_clusters(), over whole pages at once."""
    keys = keys or PAGE
    kinds = items.schema

    def step(p: Pages) -> dict[str, pa.Array]:
        r = row_texts(p, idx)
        return {**keyed(p, keys, r["page"]), "row_id": pa.array(r["row_id"]), "text": r["text"], "x1": _number(r["x1"]), "y1": _number(r["y1"]), "n_items": pa.array(r["n_items"])}

    fields = [T.StructField(k, kinds[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField("row_id", T.IntegerType()), *[T.StructField(c, kinds[c].dataType) for c in ("text", "x1", "y1")], T.StructField("n_items", T.LongType())])
    return pagewise(items, keys, [idx, "text", "x1", "y1", "y2"], step, schema)


def layer_quality(words: DataFrame) -> DataFrame:
    """Of each page: kept words, share of characters in words without area, share of undecodable characters."""
    box = Box.of()
    flat = (box.width <= 0) | (box.height <= 0)
    size = F.length(strip(F.col("text")))
    lost, kept = F.sum(F.when(flat, size).otherwise(0)), F.sum(F.when(flat, 0).otherwise(size))
    return words.where(not_blank(F.col("text"))).groupBy(*PAGE).agg(
        F.sum(F.when(flat, 0).otherwise(1)).alias("word_count"),
        F.coalesce(lost / F.nullif(lost + kept, F.lit(0)), F.lit(0.0)).alias("dropped_fraction"),
        F.coalesce(F.sum(undecodable_count(F.col("text"))) / F.nullif(F.sum(F.length("text")), F.lit(0)), F.lit(0.0)).alias("undecodable_fraction"),
    )


def uses_layer(mode: Column, words: Column, dropped: Column, undecodable: Column, min_words: int = 5, max_dropped: float = 0.3, max_undecodable: float = 0.2) -> Column:
    """Whether a page's text layer is its text: bounds are inclusive; a page without a layer has none."""
    auto = (words >= min_words) & (dropped <= max_dropped) & (undecodable <= max_undecodable)
    return F.coalesce(F.when(mode == "Never", F.lit(False)).when(mode == "Always", words > 0).otherwise(auto), F.lit(False))


def xfa_placeholder(lines: DataFrame, first: str = PLACEHOLDER[0], second: str = PLACEHOLDER[1]) -> DataFrame:
    """Of each page, whether its lines, joined by a space, hold both phrases in any case."""
    text = F.lower(in_order(F.col("text"), F.col("line_idx"), separator=" "))
    return lines.groupBy(*PAGE).agg(text.alias("t")).select(*PAGE, (F.col("t").contains(first) & F.col("t").contains(second)).alias("is_placeholder"))


def merge_recognised(layer: DataFrame, recognised: DataFrame, most: float = 0.3) -> DataFrame:
    """Layer lines, then recognised lines that no layer line covers by more than 0.3 of their own area."""
    r, o = Box.of("r"), Box.of("o")
    meet = o.meet(r)
    over = (meet.width > 0) & (meet.height > 0) & (meet.width * meet.height / F.greatest(F.lit(1.0), o.width * o.height) > most)
    same = (F.col("o.doc_id") == F.col("r.doc_id")) & (F.col("o.page_number") == F.col("r.page_number"))
    new = recognised.alias("o").join(layer.alias("r"), same & over, "left_anti")
    cols = [*PAGE, "line_idx", "text", "x1", "y1", "x2", "y2"]
    return layer.select(*cols, F.lit("TextLayer").alias("source")).unionByName(new.select(*cols, F.lit("Ocr").alias("source")))


def confident_words(lines: DataFrame, floor: float = 0.0, by: list[str] | None = None) -> DataFrame:
    return lines.groupBy(*(by or PAGE)).agg(F.sum(F.when(F.col("confidence") >= floor, word_count(F.col("text"))).otherwise(0)).alias("words"))


def widget_lines(widgets: DataFrame) -> DataFrame:
    """Visible widgets with area and their text: own value, else the parent's, else [X] for a state that is not Off."""
    value = F.coalesce(F.nullif(F.trim("value"), F.lit("")), F.nullif(F.trim("parent_value"), F.lit("")), F.when(F.col("as_state") != "Off", "[X]"))
    box = Box.of()
    return widgets.where(~F.col("hidden") & (box.width > 0) & (box.height > 0)).withColumn("text", value).where("text is not null")


def dictionary_fields(widgets: DataFrame) -> DataFrame:
    """Fields of a form dictionary: text with a value, checkboxes checked or not; other kinds are left out."""
    value = F.when(F.col("field_type") == "Checkbox", F.when(F.coalesce("as_state", F.lit("Off")) != "Off", "checked").otherwise("unchecked")).when(F.col("field_type") == "Text", F.nullif(F.trim("value"), F.lit("")))
    return widgets.withColumn("value", value).where("value is not null").withColumn("confidence", F.lit(1.0))
