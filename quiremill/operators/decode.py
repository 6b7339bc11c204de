"""What surrounds a model: shaping its input and decoding its output, in numpy. The models themselves are registered stages."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import PAGE

#: A detector's labels and our region classes.
REGION_OF = {"caption": "Caption", "footnote": "Text", "formula": "Formula", "list item": "ListItem", "page footer": "PageFurniture", "page header": "PageFurniture", "picture": "Figure", "section header": "Title", "table": "Table", "text": "Text", "title": "Title"}


def region_types(detected: DataFrame) -> DataFrame:
    """Detected regions with our class; labels we do not know are Text. A dozen rows, so they are part of the plan."""
    table = F.create_map(*[F.lit(x) for kv in REGION_OF.items() for x in kv])
    return detected.withColumn("type", F.coalesce(F.try_element_at(table, F.lower("raw_label")), F.lit("Text")))


def read_order(lines: DataFrame) -> DataFrame:
    """Recognised lines with line_idx: their place in the page, by rows of twenty, then from the left."""
    place = Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y1") / 20), "x1", "y1")
    return lines.withColumn("line_idx", (F.row_number().over(place) - 1).cast("int"))


def letterbox(image: np.ndarray, size: int = 1024, fill: int = 114) -> tuple[np.ndarray, float, tuple[int, int]]:
    """The image scaled into a square, its scale, and the offset of its corner."""
    h, w = image.shape[:2]
    scale = size / max(h, w)
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    y, x = (np.minimum((np.arange(n) / scale).astype(int), m - 1) for n, m in ((nh, h), (nw, w)))
    out = np.full((size, size, image.shape[2]), fill, image.dtype)
    top, left = (size - nh) // 2, (size - nw) // 2
    out[top : top + nh, left : left + nw] = image[y][:, x]
    return out, scale, (left, top)


def unletterbox(boxes: np.ndarray, scores: np.ndarray, scale: float, offset: tuple[int, int], width: int, height: int, least: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Boxes above the least score in the page's pixels, the most confident first."""
    keep = np.flatnonzero(scores > least)
    keep = keep[np.argsort(-scores[keep], kind="stable")]
    shift = np.array([*offset, *offset])
    limit = np.array([width, height, width, height])
    return np.clip((boxes[keep] - shift) / scale, 0, limit), scores[keep]


def text_boxes(probability: np.ndarray, threshold: float = 0.3, least_score: float = 0.6, least_side: int = 3, grow: float = 1.6) -> list[tuple[int, int, int, int, float]]:
    """Connected parts of a text map as boxes with their mean score, grown by area over perimeter."""
    hot = probability > threshold
    label = np.zeros(hot.shape, np.int64)
    out = []
    h, w = hot.shape
    for y, x in zip(*np.nonzero(hot)):
        if label[y, x]:
            continue
        n = len(out) + 1
        todo, cells = [(y, x)], []
        label[y, x] = n
        while todo:
            cy, cx = todo.pop()
            cells.append((cy, cx))
            for ny, nx in ((cy - 1, cx), (cy + 1, cx), (cy, cx - 1), (cy, cx + 1)):
                if 0 <= ny < h and 0 <= nx < w and hot[ny, nx] and not label[ny, nx]:
                    label[ny, nx] = n
                    todo.append((ny, nx))
        at = np.array(cells)
        y1, x1 = at.min(0)
        y2, x2 = at.max(0) + 1
        score = float(probability[at[:, 0], at[:, 1]].mean())
        if min(y2 - y1, x2 - x1) < least_side or score < least_score:
            out.append(None)
            continue
        pad = int(round((y2 - y1) * (x2 - x1) * grow / (2 * ((y2 - y1) + (x2 - x1)))))
        out.append((max(0, x1 - pad), max(0, y1 - pad), min(w, x2 + pad), min(h, y2 + pad), score))
    return [tuple(map(int, b[:4])) + (b[4],) for b in out if b]


def width_chunks(gaps: np.ndarray, height: int, most: float = 14.0) -> list[tuple[int, int]]:
    """Cuts of a long line into parts of at most 14 times its height, each at the widest run of blank columns near the end."""
    width, limit = len(gaps), max(1, int(most * height))
    out, at = [], 0
    while width - at > limit:
        window = np.flatnonzero(gaps[at + limit // 2 : at + limit])
        if len(window):
            runs = np.split(window, np.flatnonzero(np.diff(window) > 1) + 1)
            best = max(runs, key=lambda r: (len(r), r[-1]))
            cut = at + limit // 2 + int(best[len(best) // 2])
        else:
            cut = at + limit
        out.append((at, cut))
        at = cut
    return [*out, (at, width)]


def table_bands(boxes: np.ndarray, scores: np.ndarray, labels: list[str], least: float = 0.5) -> tuple[list[tuple[float, float]], list[tuple[float, float]]]:
    """Row bands (y) and column bands (x) of a table from a detector's boxes, duplicates merged."""
    from .order import merge_bands

    keep = [i for i in range(len(labels)) if scores[i] >= least]
    rows = [(float(boxes[i][1]), float(boxes[i][3])) for i in keep if labels[i] == "row"]
    cols = [(float(boxes[i][0]), float(boxes[i][2])) for i in keep if labels[i] == "column"]
    return merge_bands(rows), merge_bands(cols)


def span_cells(tokens: list[str]) -> list[tuple[int, int, int, int]]:
    """(row, column, row span, column span) of each cell of an HTML-like token stream, around cells that span into a row."""
    taken: set[tuple[int, int]] = set()
    out, row, spans, inside = [], -1, {"rowspan": 1, "colspan": 1}, False
    for t in tokens:
        if t == "<tr>":
            row += 1
        elif t in ("<td", "<td>", "<td></td>"):
            spans, inside = {"rowspan": 1, "colspan": 1}, True
        elif inside and "span=" in t:
            name, _, value = t.strip().partition("=")
            spans[name] = max(1, int(value.strip('"') or 1))
        if inside and t in (">", "<td>", "<td></td>"):
            col = next(c for c in range(len(taken) + len(out) + 1) if (row, c) not in taken)
            for r in range(spans["rowspan"]):
                for c in range(spans["colspan"]):
                    taken.add((row + r, col + c))
            out.append((row, col, spans["rowspan"], spans["colspan"]))
            inside = False
    return out


@lru_cache(1)
def byte_symbols() -> dict[int, str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD) and not 0x7F <= b <= 0xA0]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def merge_pairs(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-level BPE of one pre-token: the pair of least rank joins first, the leftmost of equals."""
    parts = [byte_symbols()[b] for b in word.encode()]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get((parts[i], parts[i + 1]), len(ranks)), i))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def features(words: list[list[int]], boxes: list[tuple[int, int, int, int]], start: int = 0, size: int = 512, first: int = 0, last: int = 2, pad: int = 1) -> dict[str, list]:
    """A window of token ids with each token's box and word: a first and a last token, the rest padding.

    Only whole words go in; the window ends before the first that does not fit.
    """
    ids, box, of = [first], [(0, 0, 0, 0)], [-1]
    for w in range(start, len(words)):
        if len(ids) + len(words[w]) > size - 1:
            break
        ids += words[w]
        box += [boxes[w]] * len(words[w])
        of += [w] * len(words[w])
    ids, box, of = [*ids, last], [*box, (0, 0, 0, 0)], [*of, -1]
    n = len(ids)
    return {"ids": ids + [pad] * (size - n), "boxes": box + [(0, 0, 0, 0)] * (size - n), "word": of + [-1] * (size - n), "mask": [1] * n + [0] * (size - n)}


def softmax_labels(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best label of each token and its probability."""
    e = np.exp(logits - logits.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)
