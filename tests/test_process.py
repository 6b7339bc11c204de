"""Processing from front to back: every option changes a row somewhere, and each kind of page comes out as it should."""

import inspect
import re
from dataclasses import fields as fields_of

import pytest
from pyspark.sql import functions as F

import quiremill.process as module
from quiremill.engine import Engine
from quiremill.process import Corpus, Options, process, process_routed

BOX = "x1 double, y1 double, x2 double, y2 double"
KEY = "doc_id long, page_number int"


def words_of(doc, page, rows):
    """Words of lines: (text, x, y)."""
    out = []
    for text, x, y in rows:
        for w in text.split(" "):
            out.append((doc, page, len(out), w, float(x), float(y), float(x + 10 * len(w)), float(y + 20)))
            x += 10 * (len(w) + 1)
    return out


@pytest.fixture(scope="module", autouse=True)
def small(spark, tmp_path_factory):
    """Two partitions, and a folder where what many steps read is kept."""
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cut")))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.fixture(scope="module")
def make(spark):
    def df(schema, rows):
        return spark.createDataFrame(rows, f"{KEY}, {schema}" if not schema.startswith("!") else schema[1:])

    def corpus(**rows):
        schemas = {
            "pages": "width_px int, height_px int",
            "words": f"token_idx int, text string, {BOX}",
            "readings": f"rotation int, attempt_no int, prepared boolean, line_idx int, text string, confidence double, {BOX}",
            "regions": f"region_idx int, type string, raw_label string, confidence double, {BOX}",
            "cells": f"region_idx int, row int, col int, {BOX}",
            "images": "image_idx int, placed_w double, placed_h double, sample_w int, sample_h int, page_w double, page_h double",
            "widgets": f"widget_idx int, field_type string, kind string, value string, parent_value string, as_state string, hidden boolean, name string, {BOX}",
            "profiles": "!profile string, spec_idx int, name string, label string, kind string, anchor string",
            "profile_order": "!profile string, profile_idx int",
            "signatures": "token string",
            "template_tokens": "!template_id string, template_idx int, page int, token string",
            "elements": f"!template_id string, page int, element_idx int, kind string, label string, grp string, {BOX}",
            "documents": "!doc_id long, status string, has_xfa boolean, page_count int",
            "signals": "class string, confidence double, rulings int, trust double",
            "runs": "run_idx int, x double, y double, width double, font_size double, space_width_em double, text string, is_ocr_layer boolean",
            "fields": "field_idx int, qualified_name string, partial_name string, label string, field_type string, value string, is_checked boolean",
        }
        return Corpus(**{k: df(schemas[k], v) for k, v in rows.items()})

    return corpus


def page(result, doc=1, number=1):
    return result.pages.where((F.col("doc_id") == doc) & (F.col("page_number") == number)).first()


TEXT = [("2. second point of it all", 10, 10), ("1. first point of it all", 10, 110), ("3. third point of it all", 10, 210)]


def region(i, y, kind="Text", conf=0.9, x=0.0, doc=1):
    return (doc, 1, i, kind, kind.lower(), conf, x, float(y), x + 500.0, float(y + 40))


@pytest.fixture(scope="module")
def layered(make):
    """A page with a sound text layer of three numbered regions, a banner, and a scan of low resolution behind it."""
    rows = [*TEXT, ("CUI", 10, 1170)]
    return make(
        pages=[(1, 1, 1000, 1200), (1, 2, 1000, 1200)],
        words=[*words_of(1, 1, rows), *words_of(1, 2, [("odd \x07\x07\x07\x07\x07", 0, 0)])],
        regions=[region(0, 0), region(1, 100), region(2, 200), region(3, 1160, "PageFurniture")],
        readings=[(1, 1, 0, 0, True, 0, "only in the picture", 0.9, 600.0, 600.0, 900.0, 620.0), (1, 1, 0, 0, False, 1, "plain reading", 0.9, 600.0, 700.0, 900.0, 720.0)],
        images=[(1, 1, 0, 100.0, 120.0, 300, 300, 200.0, 200.0)],
    )


def test_text_layer_page(layered):
    p = page(process(layered))
    assert p.source == "TextLayer" and p.markdown.startswith("2. second point of it all\n\n1. first") and "CUI" not in p.markdown
    assert p.lines_recovered == 1 and p.notice == "Mixed page: lines found in images: 1." and "only in the picture" in p.markdown
    assert (p.truth_words, p.truth_found, p.recall_pct, p.lines_lost, p.sensitivity) == (10, 10, 100.0, 0, "CUI")
    q = page(process(layered), number=2)
    assert q.source == "Ocr" and q.needs_review and q.truth_words == 0  # a layer of undecodable characters is no truth


@pytest.mark.parametrize(
    ("changes", "sees"),
    [
        ({"text_layer": "Never"}, lambda k: not k.from_layer),
        ({"min_layer_words": 50}, lambda k: not k.from_layer),
        ({"max_dropped": -1.0}, lambda k: not k.from_layer),
        ({"max_undecodable": -1.0}, lambda k: not k.from_layer),
        ({"recover_image_text": False}, lambda k: k.from_layer and not k.image_suspected),
        ({"min_image_coverage": 0.5}, lambda k: k.from_layer and not k.image_suspected),
    ],
    ids=lambda v: next(iter(v)) if isinstance(v, dict) else "",
)
def test_option_of_sources(layered, changes, sees):
    known = lambda o: module._known(layered, o).where("page_number = 1").first()
    assert known(Options()).from_layer and known(Options()).image_suspected and sees(known(Options(**changes)))


def test_options_of_text_pages(layered):
    p = page(process(layered, Options(preprocess_scans=False, detect_markings=False, verify=False, enumerator_order=True, dpi=200)))
    assert "plain reading" in p.markdown and "picture" not in p.markdown and p.markdown.startswith("1. first point of it all\n\n2. second")
    assert (p.sensitivity, p.truth_words, p.recall_pct, p.render_dpi) == (None, 0, None, 200)


def test_page_subset(layered):
    c = module._wanted(layered, Options(pages=(2, 7)))
    assert [(r.doc_id, r.page_number) for r in c.pages.collect()] == [(1, 2)] and c.readings.count() == 0 and c.words.count() == 2


LONG = "these are the many words of a page that was read the right way up so that it has more than a hundred letters"


@pytest.fixture(scope="module")
def scanned(make):
    """Page 1: low resolution, each attempt reads more. Page 2: right only when turned. Page 3: nothing."""
    line = lambda n, rot, att, text, conf: (1, n, rot, att, True, 0, text, conf, 0.0, 0.0, 900.0, 20.0)
    return make(
        pages=[(1, n, 1000, 1200) for n in (1, 2, 3)],
        readings=[line(1, 0, 0, "murky", 0.9), line(1, 0, 1, "murky words", 0.9), line(1, 0, 2, "three clear words", 0.6), line(2, 0, 0, "umop apisdn", 0.3), line(2, 180, 0, LONG, 0.9)],
        images=[(1, 1, 0, 200.0, 200.0, 330, 330, 200.0, 200.0)],
    )


def test_scanned_pages(scanned):
    r = process(scanned)
    p, q, e = page(r), page(r, number=2), page(r, number=3)
    assert (p.source, p.low_resolution, p.effective_dpi, p.retried, p.render_dpi) == ("Ocr", True, 119, True, 600)
    assert p.markdown.strip() == "three clear words" and p.notice == "Low-resolution scan (about 119 DPI): text found by rendering at 600 DPI."
    assert q.orientation == 180 and q.markdown.strip() == LONG
    assert e.needs_review and e.notice == "Scan without any text found; needs review." and e.flag == e.notice
    assert r.documents.first().markdown.startswith("<!-- page 1 -->\n\nthree clear words")


@pytest.mark.parametrize(
    ("changes", "number", "text", "also"),
    [
        ({"min_scan_dpi": 100}, 1, "murky", {"retried": False}),
        ({"retry_low_resolution": False}, 1, "murky", {"retried": False}),
        ({"retry_min_words": 2}, 1, "murky words", {"render_dpi": 300, "recovered_via": "enlarging 2 times"}),
        ({"retry_min_confidence": 0.7}, 1, "murky words", {}),
        ({"upscale_factor": 3.0, "retry_min_words": 2}, 1, "murky words", {"recovered_via": "enlarging 3 times"}),
        ({"upscale_factor": 1.0, "retry_min_words": 2}, 1, "three clear words", {"render_dpi": 600}),
        ({"upscale": True, "retry_low_resolution": False}, 1, "murky words", {"retried": False}),
        ({"dpi": 600}, 1, "murky words", {"render_dpi": 600}),
        ({"detect_orientation": False}, 2, "umop apisdn", {"orientation": 0}),
    ],
    ids=lambda v: "-".join(v) if isinstance(v, dict) else "",
)
def test_option_of_scans(scanned, changes, number, text, also):
    o = Options(**changes)
    lines, figures = module._scanned(module._readings(scanned, o), module._known(scanned, o), o)
    assert [r.text for r in lines.where(F.col("page_number") == number).collect()] == [text]
    f = figures.where(F.col("page_number") == number).first()
    assert {k: f[k] for k in also} == also


@pytest.fixture(scope="module")
def formed(make):
    """A form whose widgets carry a template's signature, and whose lines print a profile's labels; a table; an XFA page."""
    lines = [("Order No A-17", 10, 10), ("Name of Buyer", 10, 60), ("Jo Smith", 10, 90), ("- Intel Xeon processor 16-core", 10, 300)]
    return make(
        pages=[(d, 1, 1000, 1000) for d in (1, 2, 3, 4)],
        words=[*words_of(1, 1, lines), *words_of(4, 1, [("FOUO", 10, 10), ("and some words of the page", 10, 500)]), *words_of(2, 1, [("Please wait... If this is not replaced get Adobe Reader now", 0, 0)]), *words_of(3, 1, [("STANDARD FORM 30 of a kind", 0, 0), ("Qty", 10, 105), ("Item description", 210, 105), ("4", 10, 145), ("64 GB memory", 210, 145)])],
        regions=[(1, 1, 0, "Text", "text", 0.9, 0.0, 0.0, 900.0, 400.0), (3, 1, 0, "Table", "table", 0.9, 0.0, 100.0, 900.0, 190.0)],
        cells=[(3, 1, 0, r, c, 200.0 * c, 100.0 + 40 * r, 200.0 * c + 200 * (1 + 2 * c), 139.0 + 40 * r) for r in (0, 1) for c in (0, 1)],
        widgets=[(1, 1, 0, "Text", "Text", "A-17", None, None, False, "order", 100.0, 8.0, 200.0, 32.0), (1, 1, 1, "Checkbox", "Checkbox", None, None, "Yes", False, "rush", 300.0, 8.0, 320.0, 32.0)],
        profiles=[("order", 0, "order_no", "Order No", "Text", "Right"), ("order", 1, "buyer", "Name of Buyer", "Text", "Below")],
        profile_order=[("order", 0)],
        signatures=[(1, 1, t) for t in "abcdefghi"],
        template_tokens=[("T", 0, 1, t) for t in "abcdefghij"],
        elements=[("T", 1, 0, "Text", "Order number", None, 0.1, 0.008, 0.2, 0.032), ("T", 1, 1, "Checkbox", "Rush", None, 0.3, 0.008, 0.32, 0.032)],
    )


def test_forms(formed):
    r = process(formed)
    assert [(f.name, f.value, f.origin) for f in r.fields.orderBy("field_idx").collect()] == [("Order number", "A-17", "template"), ("Rush", "Rush", "template")]
    assert "- [x] **Rush** Rush\n- **Order number:** A-17" in page(r).markdown
    x = page(r, 2)
    assert x.markdown.startswith("<!-- This form") and not x.needs_review and x.flag == x.notice
    t = page(r, 3)
    assert "| Qty | Item description |\n|---|---|\n| 4 | 64 GB memory |" in t.markdown
    assert "Hardware" not in "".join(d.markdown for d in r.documents.collect())


def test_option_of_forms(formed):
    r = process(formed, Options(template_routing=False, form_fields=True, hardware_specs=True, block_marked=True))
    assert page(r, 4).markdown == "[withheld: page marked 'FOUO']" and page(r, 4).sensitivity == "FOUO"
    assert "**Order number:**" not in page(r).markdown
    assert {(f.value, f.origin) for f in r.fields.collect()} == {("A-17", "dictionary"), ("checked", "dictionary")}
    docs = {d.doc_id: d.markdown for d in r.documents.collect()}
    assert "- Intel Xeon processor 16-core" in docs[1].split("## Hardware specifications")[1] and "**Qty 4** — 64 GB memory" in docs[3]
    assert module._templated(formed, Options(template_match=0.95)).count() == 0 and module._templated(formed, Options()).count() == 2
    from dataclasses import replace

    lines, _ = module._characters(formed, module._known(formed, Options()), Options())
    labels = module._fields(replace(formed, widgets=None), Options(form_fields=True), lines, None).collect()
    assert {(f.name, f.value, f.origin) for f in labels} == {("order_no", "A-17", "labels"), ("buyer", "Jo Smith", "labels")}


@pytest.fixture(scope="module")
def routed(make):
    run = lambda doc, n, i, text, y=700.0: (doc, n, i, 10.0, y, 8.0 * len(text), 10.0, 0.25, text, False)
    return make(
        pages=[(1, n, 1000, 1200) for n in (1, 2, 3, 4, 5)] + [(2, n, 1000, 1200) for n in (1, 2, 3)],
        documents=[(1, "Processed", False, 5), (2, "Processed", False, 3)],
        signals=[(1, 1, "digital_text", 0.9, 0, 0.9), (1, 2, "digital_text", 0.55, 0, 0.9), (1, 3, "table_or_complex", 0.9, 3, 0.9), (1, 4, "form", 0.9, 0, 0.9), (1, 5, "digital_text", 0.9, 0, 0.4)]
        + [(2, 1, "digital_text", 0.9, 0, 0.9), (2, 2, "scanned_image", 0.9, 0, 0.9), (2, 3, "scanned_image", 0.9, 0, 0.9)],
        runs=[run(1, 1, 0, "prose of five words here"), *[run(1, 2, i, f"w{i}", 700.0 - 20 * i) for i in range(4)], *[run(1, 3, i, f"cell {i} of it", 700.0 - 30 * i) for i in range(4)], run(1, 4, 0, "x"), run(1, 5, 0, "text that decodes badly though long"), *[run(2, 1, i, f"t{i}") for i in range(3)]],
        fields=[(1, 4, 0, "name", None, None, "Text", "Jo", False)],
        readings=[(d, n, 0, 0, True, 0, f"pixels of {d} {n} here", 0.9, 0.0, 0.0, 400.0, 20.0) for d, n in [(1, k) for k in range(1, 6)] + [(2, k) for k in range(1, 4)]],
    )


def lanes(result):
    return {(r.doc_id, r.page_number): r.produced_by for r in result.pages.collect()}


def test_routed(routed):
    seen = []
    r = process_routed(routed, Options(fast_lane=True), lambda plan: seen.append(plan.count()))
    assert seen == [8]
    assert {k[1]: v for k, v in lanes(r).items() if k[0] == 1} == {1: "structure", 2: "pixels", 3: "pixels", 4: "structure", 5: "pixels"}
    docs = {d.doc_id: d.markdown for d in r.documents.collect()}
    assert re.sub("\n+", "\n", docs[1]).strip() == "prose of five words here\npixels of 1 2 here\npixels of 1 3 here\n- **name:** Jo\npixels of 1 5 here"
    assert {(p.doc_id, p.page_number): p.lane for p in r.plan.collect()}[1, 5] == "Fast"  # planned, but given up


def test_on_plan_may_fail(routed):
    def broken(plan):
        raise ValueError("broken")

    with pytest.warns(UserWarning, match="on_plan: broken"):
        process_routed(routed, Options(fast_lane=True), broken)


@pytest.mark.parametrize(
    ("changes", "key", "lane", "abstain"),
    [
        ({}, (1, 5), "Fast", True),
        ({"min_fast_confidence": 0.5}, (1, 2), "Fast", False),
        ({"ruling_threshold": 4}, (1, 3), "Fast", False),
        ({"min_decode_trust": 0.3}, (1, 5), "Fast", False),
        ({"escalation_share": 0.6}, (2, 1), "Heavy", None),
        ({"min_fast_confidence": 0.5, "min_trust_runs": 3}, (1, 2), "Fast", True),
        ({"min_fast_confidence": 0.5, "min_trust_runs": 3, "min_fast_words": 2}, (1, 2), "Fast", False),
    ],
    ids=lambda v: "-".join(v) if isinstance(v, dict) else "",
)
def test_option_of_lanes(routed, changes, key, lane, abstain):
    o = Options(fast_lane=True, **changes)
    plan = module.planned(routed, o)
    mine = (F.col("doc_id") == key[0]) & (F.col("page_number") == key[1])
    assert plan.where(mine).first().lane == lane
    fast = module._fast(routed, plan.where("lane = 'Fast'"), o).where(mine).first()
    assert (fast.abstain if fast else None) == abstain


def test_engine_and_every_option_is_read(spark, routed):
    assert Engine(spark).process(routed).plan is None and Engine(spark, Options(fast_lane=True)).process(routed).plan is not None
    text = inspect.getsource(module)
    for f in fields_of(Options):
        assert f"o.{f.name}" in text, f.name


def test_nothing_at_all(make):
    r = process(make(pages=[]))
    assert r.pages.collect() == [] and r.documents.collect() == [] and r.fields.collect() == [] and r.lines.collect() == []
