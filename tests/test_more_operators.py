"""Decoders, the template library and corpus reports on small inputs."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiremill.operators import decode, harness, library


def test_letterbox_round_trip():
    page = np.zeros((100, 200, 3), np.uint8)
    square, scale, at = decode.letterbox(page, 64)
    assert square.shape == (64, 64, 3) and at == (0, 16) and scale == 0.32
    boxes, scores = decode.unletterbox(np.array([[0, 16, 32, 32], [0, 16, 64, 48], [0, 0, 1, 1.0]]), np.array([0.5, 0.9, 0.2]), scale, at, 200, 100)
    assert boxes.tolist() == [[0, 0, 200, 100], [0, 0, 100, 50]] and scores.tolist() == [0.9, 0.5]


def test_text_boxes():
    p = np.zeros((40, 60))
    p[10:20, 10:40] = 0.9
    p[30:32, 5:7] = 0.9  # too small
    p[30:36, 20:30] = 0.4  # too weak
    (x1, y1, x2, y2, score), = decode.text_boxes(p)
    assert x1 < 10 and y1 < 10 and x2 > 40 and y2 > 20 and abs(score - 0.9) < 1e-9


def test_width_chunks():
    gaps = np.zeros(100, bool)
    gaps[60:64] = True
    assert decode.width_chunks(gaps, 5) == [(0, 62), (62, 100)]
    assert decode.width_chunks(gaps, 10) == [(0, 100)]


def test_table_decoders():
    rows, cols = decode.table_bands(np.array([[0, 0, 9, 10], [0, 1, 9, 10], [0, 12, 9, 20], [0, 0, 4, 20]]), np.array([0.9, 0.8, 0.9, 0.4]), ["row", "row", "row", "column"])
    assert rows == [(0.0, 10.0), (12.0, 20.0)] and cols == []
    tokens = ["<tr>", "<td", ' rowspan="2"', ">", "</td>", "<td></td>", "</tr>", "<tr>", "<td></td>", "</tr>"]
    assert decode.span_cells(tokens) == [(0, 0, 2, 1), (0, 1, 1, 1), (1, 1, 1, 1)]


def test_bpe_features():
    ranks = {("a", "b"): 0, ("ab", "c"): 1}
    assert decode.merge_pairs("abcab", ranks) == ["abc", "ab"]
    assert len(set(decode.byte_symbols().values())) == 256
    f = decode.features([[5, 6], [7], [8, 9, 10]], [(1, 1, 2, 2)] * 3, size=6)
    assert f["ids"] == [0, 5, 6, 7, 2, 1] and f["word"] == [-1, 0, 0, 1, -1, -1] and f["mask"] == [1, 1, 1, 1, 1, 0]
    label, p = decode.softmax_labels(np.array([[0.0, 2.0], [3.0, 0.0]]))
    assert label.tolist() == [1, 0] and (p > 0.8).all()


def test_library(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path / "templates"))
    assert lib.get("T") is None and not lib.delete("T")
    assert lib.register("T", "name", json.dumps([])) == 1
    with pytest.raises(ValueError):
        lib.register("T", "again", "[]")
    assert lib.update("T", "newer", "[]") == 2 and lib.get("T").name == "newer"
    with pytest.raises(KeyError):
        lib.update("U", "x", "[]")
    assert lib.delete("T") and lib.templates().count() == 0
    assert lib.register("T", "back", "[]") == 4


def test_draft(spark):
    w = spark.createDataFrame([("T", 1, 1, 0, "Text", "", 0.3, 0.1, 0.5, 0.12), ("T", 1, 1, 1, "Text", "", 0.3, 0.2, 0.5, 0.22), ("T", 1, 1, 2, "Text", "", 0.3, 0.2, 0.3, 0.22)], "template_id string, doc_id long, page_number int, widget_idx int, kind string, value string, x1 double, y1 double, x2 double, y2 double")
    l = spark.createDataFrame([(1, 1, 0, "Name", 0.1, 0.1, 0.2, 0.12)], "doc_id long, page_number int, line_idx int, text string, x1 double, y1 double, x2 double, y2 double")
    e, prints = library.draft(w, l)
    assert [r.label for r in e.orderBy("element_idx").collect()] == ["Name", "Name"]
    assert len(prints.first().fingerprint) == 64


def test_assets(spark):
    raw = b"weights"
    files = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"bad"))], "name string, content binary")
    want = spark.createDataFrame([("a", hashlib.sha256(raw).hexdigest().upper(), 7), ("b", hashlib.sha256(raw).hexdigest(), 7), ("c", "0", 1)], "name string, sha256 string, bytes int")
    assert {r.name: (r.found, r.intact) for r in library.verified_assets(files, want).collect()} == {"a": (True, True), "b": (True, False), "c": (False, False)}


def test_reports(spark):
    words = spark.createDataFrame([(1, 1, "alpha"), (1, 1, "beta"), (1, 2, "gamma")], "doc_id long, page_number int, text string")
    said = spark.createDataFrame([(1, 1, 100.0, False), (1, 2, 100.0, False)], "doc_id long, page_number int, recall_pct double, needs_review boolean")
    got = {r.page_number: (r.recall_pct, r.silent_empty) for r in harness.honest_recall(words.where("text = 'alpha'"), words, said).collect()}
    assert got == {1: (50.0, False), 2: (0.0, True)}
    p = spark.createDataFrame([("a", 5, 100, True, False, None), ("a", 7, 200, False, True, "n")], "corpus string, words int, dpi int, low_resolution boolean, needs_review boolean, notice string")
    assert {r.corpus: (r.pages, r.mean_dpi) for r in harness.scan_census(p).collect()} == {"a": (2, 150.0), None: (2, 150.0)}
    rot = spark.createDataFrame([(0, 99.0), (0, 98.0), (90, None)], "rotation int, recall_pct double")
    assert {r.rotation: r.avg_recall for r in harness.orientation_report(rot).collect()} == {0: 98.5, 90: None}
    v = [r[0] for r in spark.createDataFrame([("signDate",), ("vendor_zip",), ("misc",)], "n string").select(harness.filled_value(F.col("n"))).collect()]
    assert v[0].startswith("2024-0") and v[1].startswith("9021") and v[2].startswith("value ")
    w = spark.createDataFrame([(1, 1, 0, "Checkbox", "X", "ok", 0.0, 0.0, 1.0, 1.0)], "doc_id long, page_number int, widget_idx int, kind string, value string, name string, x1 double, y1 double, x2 double, y2 double")
    assert harness.label_set(w, ["clean", "blur"]).where("checked").count() == 2
    f = spark.createDataFrame([(1, 1, 1, "b", "2"), (1, 1, 0, "a", "1")], "doc_id long, page_number int, field_idx int, name string, value string")
    assert [x.name for x in harness.key_value_set(f).first().fields] == ["a", "b"]
    md = spark.createDataFrame([(1, 1, "m")], "doc_id long, page_number int, markdown string")
    assert harness.scan_pairs(md, md).first().degraded == "m"
    r = spark.createDataFrame([(1, 1, 0, 2), (1, 1, 1, None)], "doc_id long, page_number int, region_idx int, gold_rank int")
    assert harness.reading_order_set(r.drop("gold_rank"), r).count() == 1


def test_region_types(spark):
    d = spark.createDataFrame([("Section Header",), ("odd",)], "raw_label string")
    assert [r.type for r in decode.region_types(d).collect()] == ["Title", "Text"]
    l = spark.createDataFrame([(1, 1, 10.0, 9.0), (1, 1, 0.0, 12.0)], "doc_id long, page_number int, x1 double, y1 double")
    assert [r.x1 for r in decode.read_order(l).collect()] == [10.0, 0.0]
