"""Operators on hand-made pages, where the result can be told by eye."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiremill import runs as runs_module
from quiremill.engine import Engine, Options
from quiremill.functions import text as X
from quiremill.functions.hardware import attributes, quantity
from quiremill.operators import compose, forms, layer, order, pixels, routing, signals, specs, verify
from quiremill.sources import tables
from quiremill.streaming import pages as streaming


def boxes(*items):
    return [(*map(float, b), i) for i, b in enumerate(items)]


def at(items):
    return [r[4] for r in items]


def test_xy_cut_reads_columns_after_a_header():
    page = boxes((0, 0, 500, 20), (300, 50, 500, 70), (0, 50, 200, 70), (0, 90, 200, 110), (300, 90, 500, 110))
    assert at(order.xy_cut(page)) == [0, 2, 1, 3, 4]
    assert at(order.xy_cut(boxes((0, 40, 10, 50), (0, 0, 10, 10)))) == [1, 0]
    assert order.xy_cut([]) == []


def test_widest_cut_prefers_the_wider_gap():
    page = boxes((0, 0, 200, 50), (300, 0, 500, 50), (0, 65, 200, 115), (300, 65, 500, 115))
    assert at(order.widest_cut(page)) == [0, 2, 1, 3]  # columns are 100 apart, rows 15


def test_mask_splits_the_page():
    page = boxes((0, 0, 200, 50), (300, 0, 500, 50), (0, 100, 500, 150), (0, 200, 200, 250), (300, 200, 500, 250))
    types = ["Text", "Text", "Table", "Text", "Text"]
    assert at(order.masked_cut(page, types)) == [0, 1, 2, 3, 4]
    assert at(order.masked_cut(page[:1], types)) == [0]


def test_duplicates_go_only_under_a_kept_box():
    b = [(0, 0, 10, 10), (1, 0, 11, 10), (4, 0, 14, 10), (0, 0, 10, 10)]
    assert order.suppressed(b, ["a", "a", "a", "b"], [0.9, 0.8, 0.7, 0.6]) == [0, 2, 3]


def test_merge_bands():
    assert order.merge_bands([(0, 10), (2, 11), (20, 30)]) == [(0, 11), (20, 30)]


def words(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, float(x), float(y), float(x + w), float(y + h)) for i, (t, x, y, w, h) in enumerate(rows)], "doc_id long, page_number int, token_idx int, text string, x1 double, y1 double, x2 double, y2 double")


def test_rows_follow_a_running_mean(spark):
    # each word sits 8 lower: neighbours are near, but the fourth is too far from the mean of the row
    drift = words(spark, [("a", 0, 0, 10, 20), ("b", 20, 8, 10, 20), ("c", 40, 14, 10, 20), ("d", 60, 21, 10, 20)])
    got = {r.text: r.row_id for r in layer.row_clusters(drift, "token_idx").collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 2}


def test_runs_split_at_wide_gaps(spark):
    w = words(spark, [("left", 0, 0, 40, 20), ("side", 50, 0, 40, 20), ("right", 200, 0, 50, 20), ("below", 0, 60, 50, 20)])
    assert [r.text for r in layer.text_runs(w).orderBy("line_idx").collect()] == ["left side", "right", "below"]


def test_layer_decision_bounds(spark):
    rows = [("Auto", 5, 0.3, 0.2), ("Auto", 4, 0.0, 0.0), ("Auto", 9, 0.31, 0.0), ("Always", 1, 1.0, 1.0), ("Never", 9, 0.0, 0.0), ("Auto", None, None, None)]
    df = spark.createDataFrame(rows, "m string, w int, d double, u double")
    got = [r[0] for r in df.select(layer.uses_layer(F.col("m"), F.col("w"), F.col("d"), F.col("u"))).collect()]
    assert got == [True, False, False, True, False, False]


def test_widgets(spark):
    rows = [(1, 1, "Text", "v ", None, None, False, 0.0, 0.0, 5.0, 5.0), (1, 1, "Text", " ", "p", None, False, 0.0, 0.0, 5.0, 5.0), (1, 1, "Checkbox", None, None, "Yes", False, 0.0, 0.0, 5.0, 5.0), (1, 1, "Checkbox", None, None, "Off", False, 0.0, 0.0, 5.0, 5.0), (1, 1, "Text", "h", None, None, True, 0.0, 0.0, 5.0, 5.0), (1, 1, "Text", "flat", None, None, False, 0.0, 0.0, 5.0, 0.0), (1, 1, "Signature", "s", None, None, True, 0.0, 0.0, 5.0, 5.0)]
    w = spark.createDataFrame(rows, "doc_id long, page_number int, field_type string, value string, parent_value string, as_state string, hidden boolean, x1 double, y1 double, x2 double, y2 double")
    assert [r.text for r in layer.widget_lines(w).collect()] == ["v", "p", "[X]"]
    assert [r.value for r in layer.dictionary_fields(w).collect()] == ["v", "checked", "unchecked", "h", "flat"]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(X.alnum_upper(lit("straße-1 é"))) == "STRAßE1É"
    assert one(X.alnum_lower(lit("Ab-9"))) == "ab9"
    assert one(X.word_count(lit(" a b　c "))) == 3
    assert one(X.undecodable_count(lit("a\x07�\tb\n"))) == 2
    assert one(X.form_designation(lit("see STANDARD FORM 1449a now"))) == "1449A"
    assert one(X.form_designation(lit("SF 30"))) is None
    assert one(X.revision_year(lit("(REV. 2/2012)"))) == "2012"
    assert one(X.leading_number(lit("12) x"))) == 12
    assert one(X.leading_number(lit("1.5 x"))) is None and one(X.leading_number(lit("200. x"))) is None
    assert one(X.is_echo(lit("ORDER number:"), lit("Order Number")))
    assert not one(X.is_echo(lit("x"), lit("Order Number")))
    assert one(X.is_meaningful(lit("a1"))) and one(X.is_meaningful(lit("12"))) and not one(X.is_meaningful(lit("1")))
    assert not one(X.has_value_char(lit("xX-."))) and one(X.has_value_char(lit("xa")))
    assert one(X.trigrams(lit("a b"))) == ["ab"] and one(X.trigrams(lit(""))) == []
    assert one(X.set_recall(F.array().cast("array<string>"), F.array(lit("a")))) == 1.0
    assert one(X.cap(lit("abcdef"), 3)) == "abc …[truncated]"
    assert one(X.similarity(lit("abcd"), lit("abce"))) == 0.75
    assert one(quantity(lit("about 12 or 1234567"))) == 12


def test_hardware_attributes(spark):
    def of(t):
        return [(a.category, a.value, a.unit) for a in spark.range(1).select(attributes(F.lit(t))).first()[0]]

    assert of("Xeon 64-core 2.4GHz, 512gb DDR4 RAM") == [("Processor", "64-core, 2.4 GHz", None), ("Memory", "512 GB", "DDR4")]
    assert of("sata and nvme storage 8TB") == [("Storage", "8 TB", "NVMe")]
    assert of("3U tower") == [("FormFactor", "3U", None)]
    assert of("tower") == [("FormFactor", None, None)]
    assert of("10 GB of documents") == []
    assert of("3-year support under warranty") == [("Warranty", "3-year", None)]


def test_components_merge(spark):
    a = "array<struct<category:string,raw:string,value:string,unit:string>>"
    rows = [(1, 1, 1, "Xeon  box", 2, None, None, [("Processor", "r", "x", None)]), (1, 2, 1, "xeon box", None, "P1", None, [("Processor", "longer", "x", None), ("Memory", "m", None, None)]), (1, 2, 2, "other", None, None, None, [])]
    c = spark.createDataFrame(rows, f"doc_id long, strategy int, seq long, description string, quantity int, part_number string, unit_of_issue string, attributes {a}")
    got = {r.description: (r.quantity, r.part_number, [x.category for x in r.attributes]) for r in specs.merge_components(c).collect()}
    assert got == {"Xeon  box": (2, "P1", ["Processor", "Memory"]), "other": (None, None, [])}


LINE = "doc_id long, page_number int, line_idx int, text string, x1 double, y1 double, x2 double, y2 double"
REGION = "doc_id long, page_number int, region_idx int, type string, raw_label string, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_page_composition(spark):
    regions = spark.createDataFrame([(1, 1, 0, "Title", "h1", 0.9, 0.0, 0.0, 200.0, 30.0), (1, 1, 1, "Text", "p", 0.9, 0.0, 60.0, 200.0, 90.0), (1, 1, 2, "PageFurniture", "nav", 0.9, 0.0, 500.0, 200.0, 520.0), (1, 1, 3, "Caption", "c", 0.9, 0.0, 120.0, 200.0, 140.0)], REGION)
    lines = spark.createDataFrame([(1, 1, 0, "Head", 0.0, 5.0, 50.0, 25.0), (1, 1, 1, "one", 0.0, 65.0, 30.0, 85.0), (1, 1, 2, "two", 50.0, 65.0, 80.0, 85.0), (1, 1, 3, "page 1", 0.0, 502.0, 50.0, 518.0), (1, 1, 4, "lost", 400.0, 100.0, 450.0, 115.0), (1, 1, 5, "cap", 0.0, 122.0, 40.0, 138.0)], LINE)
    page = Engine(spark).pages(lines, regions).first()
    assert page.markdown == "## Head\n\none  two\n\nlost\n\n*cap*\n\n"
    numbered = Engine(spark, Options(enumerator_order=True)).pages(lines, regions).first()
    assert numbered.markdown == page.markdown


def test_two_cells_at_one_place_are_an_error(spark):
    c = spark.createDataFrame([(1, 1, 0, 0, 0, "a"), (1, 1, 0, 0, 0, "b")], "doc_id long, page_number int, region_idx int, row int, col int, text string")
    with pytest.raises(Exception, match="two cells"):
        compose.grid_markdown(c).collect()


def test_collapsed_rows_split(spark):
    cells = [(1, 1, 0, r, c, "", c * 100.0, r * 50.0, c * 100.0 + 90, r * 50.0 + 48) for r in range(2) for c in range(2)]
    lines = [(1, 1, 0, i, t, x, y, x + 20, y + 15) for i, (t, x, y) in enumerate([("h", 5.0, 5.0), ("a1", 5.0, 52.0), ("b1", 105.0, 52.0), ("a2", 5.0, 78.0), ("b2", 105.0, 78.0)])]
    c = spark.createDataFrame(cells, "doc_id long, page_number int, region_idx int, row int, col int, text string, x1 double, y1 double, x2 double, y2 double")
    l = spark.createDataFrame(lines, "doc_id long, page_number int, region_idx int, line_idx int, text string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.row, r.part, r.col): r.text for r in compose.expand_rows(c, l).collect()}
    assert got == {(0, 0, 0): "", (0, 0, 1): "", (1, 0, 0): "a1", (1, 0, 1): "b1", (1, 1, 0): "a2", (1, 1, 1): "b2"}
    assert compose.grid_markdown(compose.numbered_rows(compose.expand_rows(c, l))).first().markdown.count("\n") == 3


def test_template_binding_is_greedy(spark):
    e = spark.createDataFrame([(1, 1, 0, "Text", "first", None, 0.0, 0.0, 0.2, 0.2), (1, 1, 1, "Text", "second", None, 0.02, 0.0, 0.22, 0.2), (1, 1, 2, "Checkbox", "yes", "grp", 0.5, 0.5, 0.6, 0.6)], "doc_id long, page_number int, element_idx int, kind string, label string, grp string, x1 double, y1 double, x2 double, y2 double")
    w = spark.createDataFrame([(1, 1, 0, "a", False, 0.01, 0.0, 0.21, 0.2), (1, 1, 1, " ", False, 0.03, 0.0, 0.23, 0.2), (1, 1, 2, "", True, 0.5, 0.5, 0.6, 0.6)], "doc_id long, page_number int, widget_idx int, value string, is_on boolean, x1 double, y1 double, x2 double, y2 double")
    assert [(r.name, r.value) for r in forms.bind_template(e, w).orderBy("element_idx").collect()] == [("first", "a"), ("grp", "yes")]


def test_labels_are_inherited_in_a_chain(spark):
    rows = [("t", i, "Text", 1, label, 0.1, y, 0.3, y + 0.02) for i, (label, y) in enumerate([("head", 0.0), ("", 0.2), ("", 0.4), ("", 0.9)])]
    e = spark.createDataFrame(rows, "template_id string, element_idx int, kind string, page int, label string, x1 double, y1 double, x2 double, y2 double")
    assert [r.label for r in forms.inherit_labels(e).orderBy("element_idx").collect()] == ["head", "head", "head", ""]
    twice = e.unionByName(e.withColumn("element_idx", F.col("element_idx") + 10).withColumn("label", F.concat("label", F.lit("!"))))
    assert sorted(r.label for r in forms.one_element_each(twice).collect()) == ["!", "!", "!", "head!"]


def test_template_rules(spark):
    r = spark.createDataFrame([("SF30-16", "16"), ("SF30", "16"), ("SF30-16", "20")], "t string, p string")
    assert [x[0] for x in r.select(forms.revision_floor(forms.template_revision(F.col("t")), F.col("p"))).collect()] == [0.15, 0.6, None]


def test_first_extractor_that_yields(spark):
    f = spark.createDataFrame([(1, 1, 1, "b"), (1, 1, 0, "a"), (1, 2, 1, "c")], "doc_id long, page_number int, priority int, name string")
    assert sorted(r.name for r in forms.first_that_yields(f).collect()) == ["a", "c"]


def test_windows_keep_the_inner_reading(spark):
    r = spark.createDataFrame([(1, 1, 5, "O", 0.9, 1), (1, 1, 5, "B-KEY", 0.6, 40)], "doc_id long, page_number int, word_idx int, label string, prob double, interior int")
    assert forms.merge_windows(r).first().label == "B-KEY"


def test_order_fidelity_and_tau(spark):
    truth = spark.createDataFrame([(1, 1, i, f"word{i:02d}") for i in range(12)], "doc_id long, page_number int, token_idx int, text string")
    mixed = spark.createDataFrame([(1, 1, i, f"word{w:02d}") for i, w in enumerate([0, 1, 2, 3, 4, 5, 6, 7, 11, 10, 9, 8])], "doc_id long, page_number int, token_idx int, text string")
    r = verify.order_fidelity(truth, mixed).first()
    assert (r.anchors, r.in_order, r.order_pct) == (12, 9, 75.0)
    one = spark.createDataFrame([(1, 0, 5)], "doc_id long, ord int, pos int")
    assert verify.kendall_tau(one, ["doc_id"]).first().tau == 1.0


def test_recall_is_null_without_truth(spark):
    w = spark.createDataFrame([(1, 1, "ab")], "doc_id long, page_number int, text string")
    r = verify.word_recall(w, w).first()
    assert (r.truth_words, r.truth_found, r.recall_pct) == (0, 0, None)


def test_classify_fills_pages_as_the_reference_does(spark):
    docs = spark.createDataFrame([(1, "Failed", False, 4), (2, "Processed", False, 4), (3, "Processed", True, 4), (4, "Processed", False, 2), (5, "Failed", False, 0), (6, "Failed", False, None)], "doc_id long, status string, has_xfa boolean, page_count long")
    signals = spark.createDataFrame([(1, 2, "form", 0.5, 3), (2, 1, "form", 0.5, 3), (2, 4, "other", 0.25, 0), (3, 3, "form", 0.75, 1), (5, 1, "form", 0.5, 2)], "doc_id long, page_number int, class string, confidence double, rulings int")
    got = sorted(tuple(r) for r in routing.classify(docs, signals).collect())
    assert got == [
        *[(1, n, "Unprocessable", 1.0, 0) for n in (1, 2, 3, 4)],
        (2, 1, "FormPage", 0.5, 3),
        (2, 4, "Mixed", 0.25, 0),
        (3, 3, "Mixed", 0.75, 1),
        (4, 1, "Mixed", 1.0, 0),
        (4, 2, "Mixed", 1.0, 0),
        (5, 1, "Unprocessable", 1.0, 0),
    ]


def test_lane_rules(spark):
    rows = [(1, 1, "DigitalText", 0.6, 0), (1, 2, "DigitalText", 0.59, 0), (2, 1, "TableOrComplexLayout", 0.9, 0), (3, 1, "Unprocessable", 0.9, 0), (3, 2, "DigitalText", 0.9, 0)]
    p = spark.createDataFrame(rows, "doc_id long, page_number int, kind string, confidence double, rulings int")
    got = {(r.doc_id, r.page_number): r.lane for r in routing.lane_plan(p).collect()}
    assert got == {(1, 1): "Fast", (1, 2): "Heavy", (2, 1): "Heavy", (3, 1): "Stop", (3, 2): "Stop"}
    assert {r.lane for r in Engine(spark).plan(p).collect()} == {"Heavy", "Stop"}
    assert Engine(spark, Options(pages=(2,))).plan(p).count() == 2
    merged = spark.createDataFrame([(1, 1, "structure"), (1, 2, "pixels")], "doc_id long, page_number int, produced_by string")
    assert routing.provenance(merged).first().engines == {1: "structure", 2: "pixels"}


def test_prose_breaks(spark):
    rows = [(1, 1, 0, 0.0, 700.0, 50.0, 10.0, 0.25, "Hello", False), (1, 1, 1, 53.0, 700.0, 40.0, 10.0, 0.25, "world", False), (1, 1, 2, 0.0, 688.0, 40.0, 10.0, 0.25, "next", False), (1, 1, 3, 0.0, 650.0, 40.0, 10.0, 0.25, "para", False), (1, 1, 4, 0.0, 640.0, 40.0, 10.0, 0.25, "ghost", True)]
    r = spark.createDataFrame(rows, "doc_id long, page_number int, run_idx int, x double, y double, width double, font_size double, space_width_em double, text string, is_ocr_layer boolean")
    assert routing.prose(r).first().markdown == "Hello world\nnext\n\npara"


def test_markings(spark):
    m = lambda t: spark.range(1).select(*[c.alias(n) for c, n in zip(signals.marking(F.lit(t)), "rm")]).first()
    assert tuple(m("TOP SECRET//SI")) == (5, "TOP SECRET//SI")
    assert m("Secret").r is None and m("the secret to success").r is None and m("CIRCUIT").r is None
    assert tuple(m("U//CUI")) == (2, "U//CUI")
    assert tuple(m("Distribution Statement D. " + "x" * 100)) == (1, "DISTRIBUTION STATEMENT D")
    assert m("Distribution Statement A").r is None


def paper(h, w):
    return np.full((h, w, 4), 255, np.uint8)


def test_pixels():
    page = paper(200, 200)
    page[20:40, 20:40, :3] = 0
    page[25:35, 25:35, :3] = 255
    assert not pixels.is_checked(page, (0.1, 0.1, 0.2, 0.2), inset=0.3)
    page[28:32, 28:32, :3] = 0
    assert pixels.is_checked(page, (0.1, 0.1, 0.2, 0.2), inset=0.3)
    grid = paper(120, 160)
    grid[[0, 60, 119], :, :3] = 0
    grid[:, [0, 80, 159], :3] = 0
    leaves = pixels.ruled_leaves(grid)
    assert len(leaves) == 4 and [(r, c) for r, c, _ in pixels.leaf_grid(leaves)] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert pixels.ruled_leaves(paper(120, 160)) is None
    assert pixels.ink_trim(page, (0.0, 20.0, 100.0, 40.0)) == (20.0, 20.0, 40.0, 40.0)
    assert pixels.ink_trim(paper(50, 50), (1.0, 1.0, 40.0, 20.0)) == (1.0, 1.0, 40.0, 20.0)
    flat = paper(100, 100)
    flat[..., :3] = 120
    flat[::2, :, :3] = 160
    out, did = pixels.stretch_contrast(flat)
    assert did and out[..., 0].min() < 10 and out[..., 0].max() == 255
    dots = paper(100, 100)
    dots[10:90:10, 10:90:10, :3] = 0
    out, did = pixels.despeckle(dots)
    assert did and (out == 255).all()
    lines = paper(600, 600)
    for y in range(50, 550, 25):
        for x in range(600):
            lines[int(y + x * np.tan(np.radians(2.0))) % 600, x, :3] = 0
    assert abs(pixels.skew_degrees(lines) - 2.0) <= 0.1
    assert pixels.rotate(page, 360).tobytes() == page.tobytes()
    assert pixels.upscale(page, 1.0) is page and pixels.upscale(page, 2.0).shape == (400, 400, 4)
    assert pixels.ctc_greedy(np.eye(4)[[1, 1, 0, 1, 2]], "abc") == ("aab", 1.0)
    assert pixels.row_split(page, (0, 0, 200, 200)) == [(20, 40)]
    stroke = paper(300, 300)
    for i in range(30, 270):
        stroke[i, i : i + 12, 2] = 255
        stroke[i, i : i + 12, :2] = 60
    out, did = pixels.suppress_watermark(stroke)
    assert did and (out == 255).all()
    ruled = paper(60, 100)
    ruled[:, 80, :3] = 0
    ruled[25:35, 60:78, :3] = 0
    assert pixels.flush_with_ruling(ruled, (50.0, 20.0, 79.0, 40.0))
    assert not pixels.flush_with_ruling(paper(60, 100), (50.0, 20.0, 79.0, 40.0))
    for degraded in (pixels.fade(page, 0.5), pixels.noise(page, 5.0), pixels.blur(page)):
        assert degraded.shape == page.shape
    assert pixels.downscale(page, 2).shape == (100, 100, 4)


def test_stages(spark):
    page = paper(64, 64)
    df = spark.createDataFrame([(1, 1, 64, 64, bytearray(page.tobytes()))], "doc_id long, page_number int, width int, height int, pixels binary")
    assert pixels.apply_stage(df, "preprocess").first().skew == 0.0
    engine = Engine(spark)
    engine.register_stage("brightness", lambda image: {"mean": float(pixels.luma(image).mean())}, "mean double")
    assert abs(engine.stage(df, "brightness").first()["mean"] - 255) < 1e-6
    assert "brightness" in engine.health()["stages"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    assert tables.document_bytes(spark, str(tmp_path)).first().length == 4
    d = spark.createDataFrame([(1, 3), (2, 0)], "doc_id long, page_count int")
    assert tables.page_numbers(d).count() == 3 and tables.page_numbers(d, [9, 2, 2]).count() == 1
    (tmp_path / "t.template.json").write_text('{"TemplateId": "T", "Name": "n", "Fingerprint": "f", "Elements": [{"Rect": {"Y1": 0.2, "X1": 0.1, "Y2": 0.4, "X2": 0.3}, "Label": "l", "Page": 1, "Kind": "Text"}]}')
    t = tables.templates(spark, str(tmp_path / "t.template.json")).first()
    assert (t.template_id, t.kind, t.x2, t.grp) == ("T", "Text", 0.3, None)
    (tmp_path / "s.csv").write_text('pdf,page,name\n"a, b.pdf", 1 ,"say ""x"""\n')
    assert tuple(tables.truth_sheet(spark, str(tmp_path / "s.csv")).first()) == ("a, b.pdf", "1", 'say "x"')
    tables.write_ledger(d, str(tmp_path / "ledger"))
    tables.write_jsonl(d, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 2
    p = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c")], "doc_id long, page_number int, markdown string")
    assert tables.document_markdown(p).first().markdown.count("---") == 2
    assert tables.merged_markdown(p).first().markdown == "a\n\nc"


def test_engine_documents(spark):
    words_ = words(spark, [("one", 0, 0, 30, 20), ("two", 40, 0, 30, 20)])
    e = Engine(spark, Options(hardware_specs=True))
    assert e.lines(words_).first().text == "one two"
    assert not e.uses_layer(words_).first().uses_layer
    pages = spark.createDataFrame([(1, 1, "body")], "doc_id long, page_number int, markdown string")
    a = "array<struct<category:string,raw:string,value:string,unit:string>>"
    c = spark.createDataFrame([(1, 1, 1, "Xeon server", 2, None, None, [("Processor", "Xeon server", None, None)])], f"doc_id long, strategy int, seq long, description string, quantity int, part_number string, unit_of_issue string, attributes {a}")
    md = e.documents(pages, c).first().markdown
    assert md.startswith("<!-- page 1 -->") and "a server (total quantity 2)" in md


def test_runs(spark, tmp_path):
    r = runs_module.Runs(spark)
    pages = spark.createDataFrame([(1, 1, "body", None, 99.0, False)], "doc_id long, page_number int, markdown string, marking string, recall_pct double, needs_review boolean")
    ok, bad = r.start(lambda run: pages, str(tmp_path / "p"), 1), r.start(lambda run: 1 / 0, str(tmp_path / "q"), 1)
    for _ in range(200):
        if ok.ended and bad.ended:
            break
        time.sleep(0.1)
    assert (r.status(ok.id).status, r.status(bad.id).status) == ("Completed", "Failed") and "division" in bad.error
    assert r.result(ok.id).count() == 1
    with pytest.raises(RuntimeError):
        r.result(bad.id)
    with pytest.raises(ValueError):
        r.start(lambda run: pages, "x", runs_module.MAX_PAGES + 1)
    assert threading.active_count() >= 1


PAGES = "doc_id long, page_number int, kind string, confidence double, rulings int, page_count int, ts timestamp"


def test_streams(spark, tmp_path):
    rows = [(1, 1, "DigitalText", 0.9, 0, 2, 0), (1, 2, "Mixed", 0.9, 0, 2, 60), (1, 2, "Mixed", 0.9, 0, 2, 60), (2, 1, "DigitalText", 0.9, 0, 3, 120)]
    src = str(tmp_path / "in")
    df = spark.createDataFrame(rows, PAGES.replace("ts timestamp", "s long")).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
    df.coalesce(1).write.parquet(src)
    s = streaming.page_stream(spark, src, PAGES)
    streaming.route_batches(s.drop("page_count", "ts"), str(tmp_path / "plan"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 4

    def drained(stream, mode, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(90)
        return spark.table(name).collect()

    assert len(drained(streaming.once(streaming.page_stream(spark, src, PAGES)), "append", "once")) == 3
    assert sum(r.pages for r in drained(streaming.windowed_counts(streaming.page_stream(spark, src, PAGES)), "complete", "counts")) == 4
    done = drained(streaming.completed(streaming.page_stream(spark, src, PAGES)), "append", "done")
    assert [(r.doc_id, r.pages_seen, r.complete) for r in done] == [(1, 2, True)]
