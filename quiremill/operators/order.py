"""Reading order of layout regions: duplicates, gap bands, XY-cut and its masked variant, enumerators.

What a window can say (masks, bands, gaps, slot permutation) is DataFrame work; the recursion and the greedy pass run
per page in Python, on a page's few dozen regions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box
from ..functions.text import leading_number
from ..sources.tables import PAGE, spare

MIN_GAP = 12.0
WIDE = 1.3
WIDE_TYPES = ("Title", "Table", "Figure")


def gap_bands(items: DataFrame, idx: str, axis: str = "y", keys: list[str] | None = None, gap: float = MIN_GAP) -> DataFrame:
    """band of every item along an axis: a new one where it starts more than 12 beyond all ends before it."""
    keys = keys or PAGE
    lo, hi = f"{axis}1", f"{axis}2"
    w = Window.partitionBy(*keys).orderBy(lo, idx)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    (new,) = spare(items, "new")
    return items.withColumn(new, F.when(F.col(lo) > reach + gap, 1).otherwise(0)).withColumn("band", F.sum(new).over(w).cast("int")).drop(new)


def widest_gap(items: DataFrame, idx: str, axis: str = "y", keys: list[str] | None = None, gap: float = MIN_GAP) -> DataFrame:
    """The widest gap of each page along an axis; 0 below 12."""
    keys = keys or PAGE
    lo, hi = f"{axis}1", f"{axis}2"
    reach = F.max(hi).over(Window.partitionBy(*keys).orderBy(lo, idx).rowsBetween(Window.unboundedPreceding, -1))
    widest = F.max(F.coalesce(F.col(lo) - F.col("reach"), F.lit(0.0)))
    return items.withColumn("reach", reach).groupBy(*keys).agg(widest.alias("g")).select(*keys, F.when(F.col("g") >= gap, F.col("g")).otherwise(F.lit(0.0)).alias("widest"))


def center_bands(items: DataFrame, idx: str, keys: list[str] | None = None, share: float = 0.8) -> DataFrame:
    """band of every line by centre-y: a new one where centres are more than 0.8 upper-median heights apart."""
    keys = keys or PAGE
    group = Window.partitionBy(*keys)
    heights = F.array_sort(F.collect_list(F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))).over(group))
    middle = F.element_at(heights, F.floor(F.count("*").over(group) / 2).cast("int") + 1)
    cy = (F.col("y1") + F.col("y2")) / 2
    w = group.orderBy(cy, idx)
    step, mid, new = spare(items, "step", "mid", "new")
    i = items.withColumn(step, cy - F.lag(cy).over(w)).withColumn(mid, middle)
    i = i.withColumn(new, F.when(F.col(step) > share * F.col(mid), 1).otherwise(0))
    return i.withColumn("band", F.sum(new).over(w).cast("int")).drop(step, mid, new)


def masked(regions: DataFrame) -> DataFrame:
    """Regions with masked: wide titles, tables and figures that overlap two others in x, on pages of four or more."""
    page = Window.partitionBy(*PAGE)
    wide = F.col("x2") - F.col("x1")
    n, mid = spare(regions, "n", "mid")
    r = regions.withColumn(n, F.count("*").over(page)).withColumn(mid, F.percentile(wide, 0.5).over(page))
    some = r.where((F.col(n) >= 4) & F.col("type").isin(*WIDE_TYPES) & (wide > WIDE * F.col(mid))).select(*PAGE, "region_idx", "x1", "x2")
    a, b = some.alias("a"), regions.select(*PAGE, "region_idx", "x1", "x2").alias("b")
    same = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_number") == F.col("b.page_number")) & (F.col("a.region_idx") != F.col("b.region_idx"))
    over = a.join(b, same & (F.least("a.x2", "b.x2") > F.greatest("a.x1", "b.x1"))).groupBy(*[F.col(f"a.{c}").alias(c) for c in (*PAGE, "region_idx")]).agg(F.count("*").alias("k")).where("k >= 2").withColumn("masked", F.lit(True)).drop("k")
    return regions.join(over, [*PAGE, "region_idx"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


def separator_bands(masks: DataFrame) -> DataFrame:
    """band of every region: for flow regions the number of masked ones strictly above its centre, by one window."""
    cy = (F.col("y1") + F.col("y2")) / 2
    above = Window.partitionBy(*PAGE).orderBy(cy).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.when(F.col("masked"), 1).otherwise(0)).over(above)
    level = F.sum(F.when(F.col("masked"), 1).otherwise(0)).over(Window.partitionBy(*PAGE, cy))
    return masks.withColumn("band", (upto - level).cast("int"))


# per page, in Python

Region = tuple[float, float, float, float, int]  # x1, y1, x2, y2, position


def bands_of(items: list[Region], axis: int, gap: float = MIN_GAP) -> list[list[Region]]:
    out: list[list[Region]] = []
    reach = float("-inf")
    for r in sorted(items, key=lambda r: (r[axis], r[4])):
        if not out or r[axis] > reach + gap:
            out.append([])
        out[-1].append(r)
        reach = max(reach, r[axis + 2])
    return out


def gap_of(items: list[Region], axis: int) -> float:
    best, reach = 0.0, None
    for r in sorted(items, key=lambda r: (r[axis], r[4])):
        if reach is not None:
            best = max(best, r[axis] - reach)
        reach = r[axis + 2] if reach is None else max(reach, r[axis + 2])
    return best if best >= MIN_GAP else 0.0


def by_place(items: list[Region]) -> list[Region]:
    return sorted(items, key=lambda r: (r[1], r[0], r[4]))


def xy_cut(items: list[Region], axis: int = 1) -> list[Region]:
    """Cut along the axis, then along the other, turning at every level; what no gap cuts goes by place."""
    if len(items) <= 1:
        return items
    for first in (axis, 1 - axis):
        parts = bands_of(items, first)
        if len(parts) > 1:
            return [r for p in parts for r in xy_cut(p, 1 - first)]
    return by_place(items)


def widest_cut(items: list[Region]) -> list[Region]:
    """Cut at every level along the axis with the widest gap; along y on a tie."""
    if len(items) <= 1:
        return items
    first = 1 if gap_of(items, 1) >= gap_of(items, 0) else 0
    for axis in (first, 1 - first):
        parts = bands_of(items, axis)
        if len(parts) > 1:
            return [r for p in parts for r in widest_cut(p)]
    return by_place(items)


def masked_cut(items: list[Region], types: list[str]) -> list[Region]:
    """XY-cut around masked wide regions, which split the page into bands."""
    if len(items) <= 1:
        return items
    mask: set[int] = set()
    if len(items) >= 4:
        widths = sorted(r[2] - r[0] for r in items)
        k = len(widths)
        middle = widths[k // 2] if k % 2 else (widths[k // 2 - 1] + widths[k // 2]) / 2
        for r in items:
            if types[r[4]] in WIDE_TYPES and r[2] - r[0] > WIDE * middle and sum(o is not r and min(o[2], r[2]) > max(o[0], r[0]) for o in items) >= 2:
                mask.add(r[4])
    flow = [r for r in items if r[4] not in mask]
    if not flow:
        return by_place(items)
    lines = sorted((r for r in items if r[4] in mask), key=lambda r: (r[1] + r[3], r[0], r[4]))
    bands: list[list[Region]] = [[] for _ in range(len(lines) + 1)]
    for r in flow:
        bands[sum(s[1] + s[3] < r[1] + r[3] for s in lines)].append(r)
    out: list[Region] = []
    for i, b in enumerate(bands):
        out += widest_cut(b) + lines[i : i + 1]
    return out


def suppressed(boxes: list[tuple[float, float, float, float]], labels: list[str], confidence: list[float], most: float = 0.7) -> list[int]:
    """Positions kept, by falling confidence: one goes if a kept one of its label overlaps 0.7 of the smaller."""
    keep: list[int] = []
    area = [max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) for b in boxes]
    for i in sorted(range(len(boxes)), key=lambda i: (-confidence[i], i)):
        a = boxes[i]
        for j in keep:
            b = boxes[j]
            small = min(area[i], area[j])
            meet = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            if labels[i] == labels[j] and small > 0 and meet / small > most:
                break
        else:
            keep.append(i)
    return keep


def _ordered(method: str, suppress: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("region_idx")
        boxes = list(zip(*(t[c].to_pylist() for c in ("x1", "y1", "x2", "y2"))))
        keep = suppressed(boxes, t["raw_label"].to_pylist(), t["confidence"].to_pylist()) if suppress else list(range(len(boxes)))
        items: list[Region] = [(*boxes[i], p) for p, i in enumerate(keep)]
        types = [t["type"][i].as_py() for i in keep]
        order = xy_cut(items) if method == "xycut" else masked_cut(items, types)
        at = [keep[r[4]] for r in order]
        return t.take(pa.array(at, pa.int64())).append_column("reading_rank", pa.array(range(len(at)), pa.int32()))

    return run


def reading_order(regions: DataFrame, method: str = "xycut++", suppress: bool = True) -> DataFrame:
    """reading_rank of every region that stays. regions: doc_id, page_number, region_idx, type, raw_label, confidence, box."""
    schema = T.StructType([*regions.schema.fields, T.StructField("reading_rank", T.IntegerType())])
    return regions.groupBy(*PAGE).applyInArrow(_ordered(method, suppress), schema)


def suppress_duplicates(regions: DataFrame) -> DataFrame:
    """Regions but those that a more confident one of the same label overlaps; rank by confidence."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("region_idx")
        keep = suppressed(list(zip(*(t[c].to_pylist() for c in ("x1", "y1", "x2", "y2")))), t["raw_label"].to_pylist(), t["confidence"].to_pylist())
        return t.take(pa.array(keep, pa.int64())).append_column("kept_rank", pa.array(range(len(keep)), pa.int32()))

    return regions.groupBy(*PAGE).applyInArrow(run, T.StructType([*regions.schema.fields, T.StructField("kept_rank", T.IntegerType())]))


def enumerators(ordered: DataFrame) -> DataFrame:
    """reading_rank after numbered regions take each other's places in numeric order.

    ordered: reading_rank, top_text (topmost row). Only pages with three or more numbered regions, numbered 1 to k.
    """
    page = Window.partitionBy(*PAGE)
    number, slots, acts = spare(ordered, "number", "slots", "acts")
    r = ordered.withColumn(number, leading_number(F.col("top_text")))
    n, kinds = F.count(number).over(page), F.size(F.collect_set(number).over(page))
    whole = (n >= 3) & (F.min(number).over(page) == 1) & (F.max(number).over(page) == n) & (kinds == n)
    # the i-th number takes the i-th slot of its page
    held = F.array_sort(F.collect_list(F.when(F.col(number).isNotNull(), F.col("reading_rank"))).over(page))
    r = r.withColumn(slots, held).withColumn(acts, whole & F.col(number).isNotNull())
    return r.withColumn("reading_rank", F.when(F.col(acts), F.get(slots, F.col(number) - 1)).otherwise(F.col("reading_rank"))).drop(number, slots, acts)


def merge_bands(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Detected rows or columns by midpoint; one that overlaps half of the smaller of it and the last is merged."""
    out: list[tuple[float, float]] = []
    for lo, hi in sorted(spans, key=lambda s: s[0] + s[1]):
        if out:
            a, b = out[-1]
            small = min(b - a, hi - lo)
            if small > 0 and (min(b, hi) - max(a, lo)) / small > 0.5:
                out[-1] = (min(a, lo), max(b, hi))
                continue
        out.append((lo, hi))
    return out
