"""Operators that no query reaches, on small inputs worked out by hand; reading order and pages against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiremill.operators import compose, forms, order, packs, pixels, routing, verify
from quiremill.plans.inputs import Data
from quiremill.sources.tables import spare

BOX = "x1 double, y1 double, x2 double, y2 double"


def test_form_packs(spark):
    rows = packs.rows()
    assert len({r[0] for r in rows}) == 9 and len(rows) == 61 and [r[2] for r in rows if r[0] == "SF-33 solicitation"] == list(range(17))
    assert len(packs.rows("us-virginia")) == 8 and packs.rows("us-virginia")[0][1] == 0
    specs, names = packs.profiles(spark)
    line = lambda i, t, x, y: (1, 1, i, t, float(x), float(y), float(x + 100), float(y + 20))
    lines = spark.createDataFrame([line(0, "2. CONTRACT NO.", 10, 10), line(1, "W52-7", 12, 35), line(2, "1. DATE OF ORDER", 200, 10), line(3, "3/4/2024", 205, 35), line(4, "ISSUING OFFICE", 400, 10)], f"doc_id long, page_number int, line_idx int, text string, {BOX}")
    got = {(r.profile, r.name, r.value) for r in forms.geometric_fields(lines, specs, names).collect()}
    assert got == {("OF-347 order", "contract_number", "W52-7"), ("OF-347 order", "date_of_order", "3/4/2024")}


def test_nearby_words(spark):
    value = lambda i, x, y: (1, 1, i, float(x), float(y), float(x + 50), float(y + 10))
    word = lambda i, t, x, y, inside=False: (1, 1, i, t, inside, float(x), float(y), float(x + 8 * len(t)), float(y + 10))
    values = spark.createDataFrame([value(0, 200, 0), value(1, 200, 100), value(2, 600, 300)], f"doc_id long, page_number int, span_idx int, {BOX}")
    words = spark.createDataFrame(
        [word(0, "far", 0, 0), word(1, "Ship", 110, 1), word(2, "date:", 150, 0), word(3, "77", 192, 0), word(4, "taken", 160, 0, True)]
        + [word(5, "Head", 190, 80), word(6, "above.", 230, 81), word(7, "higher", 200, 66)],
        f"doc_id long, page_number int, word_idx int, text string, in_value boolean, {BOX}",
    )
    assert {r.span_idx: r.near for r in forms.nearby_words(values, words).collect()} == {0: "Ship date", 1: "Head above"}


def test_grids(spark):
    rows = spark.createDataFrame([(1, 1, 0, r, float(10 * r), float(10 * r + 9)) for r in (0, 1)], "doc_id long, page_number int, region_idx int, row int, y1 double, y2 double")
    cols = spark.createDataFrame([(1, 1, 0, c, float(50 * c), float(50 * c + 49)) for c in (0, 1, 2)], "doc_id long, page_number int, region_idx int, col int, x1 double, x2 double")
    g = compose.grid(rows, cols)
    assert g.count() == 6 and tuple(g.where("row = 1 and col = 2").first())[3:] == (1, 10.0, 19.0, 2, 100.0, 149.0)
    n = lambda *v: spark.createDataFrame([(1, 1, i, x) for i, x in v], "doc_id long, page_number int, region_idx int, n_lines int")
    got = {r.region_idx: r.grid for r in compose.prefer_leaves(n((0, 3), (1, 3), (2, 1)), n((0, 3), (1, 4), (3, 0))).collect()}
    assert got == {0: "model", 1: "leaves", 2: "model", 3: "leaves"}


def test_adapted_runs(spark):
    runs = spark.createDataFrame([(1, 1, 0, "a", 10.0, 700.0, 30.0, 12.0, True), (1, 1, 1, "b", 1.0, 2.0, 3.0, 4.0, False)], "doc_id long, page_number int, run_idx int, text string, x double, y double, width double, font_size double, is_ocr_layer boolean")
    assert [tuple(r)[3:] for r in routing.adapt_run(runs).orderBy("run_idx").collect()] == [("a", 10.0, 700.0, 40.0, 712.0, "Ocr"), ("b", 1.0, 2.0, 4.0, 6.0, "TextLayer")]


def test_columns_of_ours_do_not_clash(spark):
    assert spare(spark.createDataFrame([(1, 2)], "New int, _new int"), "new", "other") == ["__new", "other"]
    names = ["cy", "new", "mid", "step", "mid_h", "n", "number", "slots", "acts", "k", "low", "top", "kinds"]
    r = spark.createDataFrame([(1, 1, i, "Text", f"{3 - i}. x", i, False, 0.0, 20.0 * i, 10.0, 20.0 * i + 10) for i in range(3)], f"doc_id long, page_number int, region_idx int, type string, top_text string, reading_rank int, masked boolean, {BOX}").withColumns({n: F.lit(n) for n in names})
    for out in (order.center_bands(r, "region_idx"), order.gap_bands(r, "region_idx"), order.separator_bands(r), order.masked(r.drop("masked")), order.enumerators(r)):
        assert set(r.columns) <= set(out.columns) and all(out.first()[n] == n for n in names)
    assert [x.reading_rank for x in order.enumerators(r).orderBy("region_idx").collect()] == [2, 1, 0]


def test_blank_pages_of_any_white_space(spark):
    runs = spark.createDataFrame([(1, 1, 0, 0.0, 700.0, 10.0, 10.0, 0.25, " \t　", False), (1, 2, 0, 0.0, 700.0, 10.0, 10.0, 0.25, "x", False)], "doc_id long, page_number int, run_idx int, x double, y double, width double, font_size double, space_width_em double, text string, is_ocr_layer boolean")
    assert [r.page_number for r in routing.prose(runs).collect()] == [2]


def test_page_words_is_quality_and_recall(spark, sf):
    from quiremill.operators import layer

    d = Data(spark, sf)
    kept = (F.col("doc_id") * 31 + F.col("token_idx")) % 17 != 0
    one = {(r.doc_id, r.page_number): r for r in verify.page_words(d.words(), kept).collect()}
    q = {(r.doc_id, r.page_number): r for r in layer.layer_quality(d.words()).collect()}
    w = {(r.doc_id, r.page_number): r for r in verify.word_recall(d.words(), d.twin()).collect()}
    assert set(one) == set(q) == set(w)
    for k, r in one.items():
        assert (r.word_count, r.dropped_fraction, r.undecodable_fraction) == (q[k].word_count, q[k].dropped_fraction, q[k].undecodable_fraction)
        assert (r.truth_words, r.truth_found, r.recall_pct) == (w[k].truth_words, w[k].truth_found, w[k].recall_pct)


# pixels


def page_of_rows():
    image = np.full((400, 600, 4), 255, np.uint8)
    for y in range(40, 360, 24):
        image[y : y + 8, 60:540, :3] = 0
    return image


@pytest.mark.parametrize("angle", [-5.0, -1.5, 2.0, 6.0])
def test_deskew(angle):
    skewed = pixels.turn(page_of_rows(), angle)
    assert abs(pixels.skew_degrees(skewed) - angle) < 0.3
    level, skew = pixels.deskew(skewed)
    assert abs(skew - angle) < 0.3 and abs(pixels.skew_degrees(level)) < 0.3
    assert level.shape == skewed.shape and pixels.deskew(page_of_rows())[1] == 0.0


def test_turning_and_steps():
    image = np.arange(9 * 9 * 4, dtype=np.uint8).reshape(9, 9, 4)
    assert (pixels.turn(image, 0) == image).all() and (pixels.turn(image, 90) == pixels.rotate(image, 90)).all()
    steps = pixels.in_turn(lambda x: pixels.fade(x, 0.5), lambda x: pixels.blur(x))
    assert (steps(image) == pixels.blur(pixels.fade(image, 0.5))).all()


def test_cubic_upscale():
    flat = np.full((5, 7, 4), 90, np.uint8)
    assert (pixels.upscale(flat, 2.5) == 90).all() and pixels.upscale(flat, 2.5).shape == (12, 18, 4) and pixels.upscale(flat, 1.0) is flat
    ramp = np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[None, :, None], 4, 0).repeat(4, 2)
    inner = pixels.upscale(ramp, 2)[4, 6:-6, 0].astype(float)
    assert np.abs(np.diff(inner) - 5).max() <= 1  # a cubic keeps a straight line
    edge = np.zeros((8, 8, 4), np.uint8)
    edge[:, 4:] = 200
    up = pixels.upscale(edge, 4)[16, :, 0].astype(int)
    assert up.max() > 200 and (np.diff(up[10:22]) >= -12).all()  # sharper than linear: it overshoots


# reading order, by a plain version written from the rules alone


def plain_bands(boxes, a, b):
    out, reach = [], None
    for r in sorted(boxes, key=lambda r: (r[a], r["i"])):
        if reach is None or r[a] > reach + 12:
            out.append([])
        out[-1].append(r)
        reach = r[b] if reach is None else max(reach, r[b])
    return out


def plain_gap(boxes, a, b):
    ends, best = [], 0
    for r in sorted(boxes, key=lambda r: (r[a], r["i"])):
        if ends:
            best = max(best, r[a] - max(ends))
        ends.append(r[b])
    return best if best >= 12 else 0


X, Y = ("x1", "x2"), ("y1", "y2")


def plain_xycut(boxes, axis=Y):
    if len(boxes) < 2:
        return boxes
    for first, second in ((axis, X if axis == Y else Y), (X if axis == Y else Y, axis)):
        parts = plain_bands(boxes, *first)
        if len(parts) > 1:
            return [r for p in parts for r in plain_xycut(p, second)]
    return sorted(boxes, key=lambda r: (r["y1"], r["x1"], r["i"]))


def plain_widest(boxes):
    if len(boxes) < 2:
        return boxes
    axes = (Y, X) if plain_gap(boxes, *Y) >= plain_gap(boxes, *X) else (X, Y)
    for axis in axes:
        parts = plain_bands(boxes, *axis)
        if len(parts) > 1:
            return [r for p in parts for r in plain_widest(p)]
    return sorted(boxes, key=lambda r: (r["y1"], r["x1"], r["i"]))


def plain_xycutpp(boxes):
    if len(boxes) < 2:
        return boxes
    middle = float(np.median([r["x2"] - r["x1"] for r in boxes]))
    crosses = lambda r: sum(min(o["x2"], r["x2"]) > max(o["x1"], r["x1"]) for o in boxes if o is not r) >= 2
    mask = [r for r in boxes if len(boxes) >= 4 and r["type"] in ("Title", "Table", "Figure") and r["x2"] - r["x1"] > 1.3 * middle and crosses(r)]
    flow = [r for r in boxes if r not in mask]
    if not flow:
        return sorted(boxes, key=lambda r: (r["y1"], r["x1"], r["i"]))
    mask.sort(key=lambda r: (r["y1"] + r["y2"], r["x1"], r["i"]))
    out = []
    for k in range(len(mask) + 1):
        out += plain_widest([r for r in flow if sum(m["y1"] + m["y2"] < r["y1"] + r["y2"] for m in mask) == k]) + mask[k : k + 1]
    return out


def plain_kept(rows):
    keep = []
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    for r in sorted(rows, key=lambda r: (-r["confidence"], r["region_idx"])):
        meet = lambda k: max(0, min(k["x2"], r["x2"]) - max(k["x1"], r["x1"])) * max(0, min(k["y2"], r["y2"]) - max(k["y1"], r["y1"]))  # noqa: B023, E731
        if not any(k["raw_label"] == r["raw_label"] and meet(k) > 0.7 * min(area(k), area(r)) for k in keep):
            keep.append(r)
    return [{**r, "i": i} for i, r in enumerate(keep)]


def regions(spark, sf):
    """The regions of all pages, and of a page of each of 300 random layouts."""
    rnd = np.random.Generator(np.random.PCG64(6))
    made = []
    for d in range(300):
        for i in range(rnd.integers(1, 14)):
            x, y, w = rnd.integers(0, 12) * 50, rnd.integers(0, 20) * 30, rnd.integers(1, 14) * 50
            made.append((-1 - d, 1, i, "t", str(rnd.choice(["Text", "Title", "Table", "Figure"])), float(rnd.integers(0, 100)) / 100, float(x), float(y), float(x + w), float(y + rnd.integers(1, 5) * 14)))
    r = Data(spark, sf).regions()
    return r.unionByName(spark.createDataFrame(made, f"doc_id long, page_number int, region_idx int, raw_label string, type string, confidence double, {BOX}"))


@pytest.mark.parametrize(("method", "plain"), [("xycut", plain_xycut), ("xycut++", plain_xycutpp)])
def test_reading_order(spark, sf, method, plain):
    r = regions(spark, sf)
    pages: dict = {}
    for x in r.collect():
        pages.setdefault(x.doc_id, []).append(x.asDict())
    got: dict = {}
    for x in order.reading_order(r, method).orderBy("doc_id", "reading_rank").collect():
        got.setdefault(x.doc_id, []).append(x.region_idx)
    assert got == {d: [o["region_idx"] for o in plain(plain_kept(rows))] for d, rows in pages.items()}


def plain_rows(lines):
    """Rows of lines by a running mean of their centres."""
    rows = []
    for l in sorted(lines, key=lambda l: ((l["y1"] + l["y2"]) / 2, l["line_idx"])):
        c = (l["y1"] + l["y2"]) / 2
        if rows and abs(c - np.mean([(o["y1"] + o["y2"]) / 2 for o in rows[-1]])) < 0.6 * np.mean([o["y2"] - o["y1"] for o in rows[-1]]):
            rows[-1].append(l)
        else:
            rows.append([l])
    return [("  ".join(o["text"] for o in sorted(r, key=lambda o: (o["x1"], o["line_idx"]))), min(o["y1"] for o in r)) for r in rows]


def test_page_markdown(spark, sf):
    """Whole pages composed anew: claim, rows, titles, furniture, orphans."""
    from quiremill.plans import catalog

    d = Data(spark, sf)
    lines, ordered = [x.asDict() for x in catalog._page_lines(d).collect()], [x.asDict() for x in order.reading_order(d.regions()).collect()]
    want = {}
    for doc in {o["doc_id"] for o in ordered}:
        blocks, regs = [], sorted((o for o in ordered if o["doc_id"] == doc), key=lambda o: o["reading_rank"])
        mine: dict = {}
        for l in (l for l in lines if l["doc_id"] == doc):
            cx, cy = (l["x1"] + l["x2"]) / 2, (l["y1"] + l["y2"]) / 2
            hold = [r for r in regs if r["x1"] <= cx <= r["x2"] and r["y1"] <= cy <= r["y2"]]
            hold.sort(key=lambda r: ({"Table": 0, "Title": 1}.get(r["type"], 2), r["reading_rank"]))
            mine.setdefault(hold[0]["region_idx"] if hold else None, []).append(l)
        for r in regs:
            own = mine.get(r["region_idx"], [])
            if own and r["type"] != "PageFurniture":
                flat = " ".join(l["text"] for l in sorted(own, key=lambda l: l["line_idx"]))
                blocks.append((r["y1"], f"## {flat}" if r["type"] == "Title" else "\n".join(t for t, _ in plain_rows(own))))
        for text, y in plain_rows(mine.get(None, [])):
            at = next((i for i, b in enumerate(blocks) if b[0] > y), len(blocks))
            blocks.insert(at, (y, text))
        if blocks:
            want[doc] = "".join(f"{t}\n\n" for _, t in blocks)
    assert {r.doc_id: r.markdown for r in catalog.QUERIES["page_markdown"](spark, sf).collect()} == want
