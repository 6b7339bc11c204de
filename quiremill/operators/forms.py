"""Form fields: by printed labels, by widgets, by templates, by learned spans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box
from ..functions.text import MARK_GLYPH, alnum_lower, distinctive_tokens, has_alnum, is_echo, is_meaningful
from ..sources.tables import PAGE, in_order
from .compose import _on

#: (profile, name, label, kind, anchor): invented examples of what a form pack holds.
PROFILES = [
    ("order-form", "order_no", "Order No", "Text", "Right"),
    ("order-form", "buyer", "Name of Buyer", "Text", "Below"),
    ("order-form", "total", "Total Amount", "Text", "RightThenBelow"),
    ("order-form", "rush", "Rush Delivery", "Checkbox", "Mark"),
    ("grant-form", "grant_no", "Grant Number", "Text", "Right"),
    ("grant-form", "office", "Awarding Office", "Text", "Below"),
]


# profiles


def labels_found(lines: DataFrame, specs: DataFrame) -> DataFrame:
    """Line that prints each label on each page: the shortest whose normalised text has it, first on ties.

    specs is a dimension of a few dozen rows, so it is sent to every task.
    """
    s = specs.withColumn("key", alnum_lower(F.col("label"))).where("key <> ''")
    hit = lines.withColumn("norm", alnum_lower(F.col("text"))).join(F.broadcast(s), F.contains(F.col("norm"), F.col("key")))
    cols = ["line_idx", "text", "x1", "y1", "x2", "y2"]
    return hit.groupBy(*PAGE, "profile", "spec_idx", "name", "label", "kind", "anchor").agg(F.min_by(F.struct(*cols), F.struct(F.length("norm"), "line_idx")).alias("l")).select(*PAGE, "profile", "spec_idx", "name", "label", "kind", "anchor", *[F.col(f"l.{c}").alias(c) for c in cols])


def best_profile(found: DataFrame, order: DataFrame, least: int = 2) -> DataFrame:
    """The profile of each page with the most labels, first in order on ties; two at least. order: profile, profile_idx."""
    n = found.groupBy(*PAGE, "profile").agg(F.count("*").alias("hits")).join(F.broadcast(order), "profile")
    best = n.groupBy(*PAGE).agg(F.max_by(F.struct("profile", "hits"), F.struct("hits", -F.col("profile_idx"))).alias("b"))
    return best.where(F.col("b.hits") >= least).select(*PAGE, F.col("b.profile").alias("profile"), F.col("b.hits").alias("hits"))


def inline_pattern(label: Column) -> Column:
    """A pattern that finds what follows a label's words on its line."""
    w = F.filter(F.transform(F.split(label, r"\s+"), lambda x: F.regexp_replace(x, r"[^\p{L}\p{Nd}]", "")), lambda x: x != "")
    return F.concat(F.lit("(?i)"), F.array_join(w, r"\W+"), F.lit(r"\W*(.+)$"))


def inline_value(text: Column, label: Column) -> Column:
    v = F.trim(F.call_function("regexp_extract", text, inline_pattern(label), F.lit(1)))
    return F.when((v != "") & has_alnum(v), v)


def _near(anchor: DataFrame, lines: DataFrame, key: list[str], condition: Column, order: Column, value: str) -> DataFrame:
    """For each row of anchor (alias a), the text of the line (alias l) of its page that fits, smallest by order."""
    m = anchor.alias("a").join(lines.alias("l"), _on("a", "l", PAGE) & condition)
    return m.groupBy(*[F.col(f"a.{k}").alias(k) for k in key]).agg(F.min_by(F.col("l.text"), F.struct(order, F.col("l.line_idx"))).alias(value))


def geometric_fields(lines: DataFrame, specs: DataFrame, order: DataFrame) -> DataFrame:
    """Fields of each page's best profile: inline value, else nearest to the right, else below, as the anchor allows;
    checkboxes by a mark left of the label. confidence 0.8."""
    found = labels_found(lines, specs).join(best_profile(labels_found(lines, specs), order).select(*PAGE, "profile"), [*PAGE, "profile"])
    key = [*PAGE, "spec_idx"]
    a, b = Box.of("a"), Box.of("l")
    h = F.greatest(F.lit(1.0), a.height)
    other = F.col("a.line_idx") != F.col("l.line_idx")
    row = F.abs(b.cy - a.cy) < 0.6 * h
    right = _near(found, lines, key, other & row & (b.x1 >= a.x2 - 2) & has_alnum(F.col("l.text")), b.x1, "right")
    below = _near(found, lines, key, other & (b.y1 >= a.y2 - 1) & (b.y1 - a.y2 < 2.5 * h) & (F.least(b.x2, a.x2) > F.greatest(b.x1, a.x1)) & has_alnum(F.col("l.text")), b.y1, "below")
    marked = found.where((F.col("kind") == "Checkbox") | (F.col("anchor") == "Mark")).alias("a").join(lines.alias("l"), _on("a", "l", PAGE) & row & (b.x2 <= a.x1 + 0.5 * h) & (a.x1 - b.x2 < 12 * h) & F.col("l.text").rlike(MARK_GLYPH), "left_semi").select(*[F.col(k) for k in key], F.lit(True).alias("marked"))
    f = found.join(right, key, "left").join(below, key, "left").join(marked, key, "left")
    box = (F.col("kind") == "Checkbox") | (F.col("anchor") == "Mark")
    anchored = F.coalesce(inline_value(F.col("text"), F.col("label")), F.when(F.col("anchor").isin("Right", "RightThenBelow"), F.col("right")), F.when(F.col("anchor").isin("Below", "RightThenBelow"), F.col("below")))
    value = F.when(box, F.when(F.coalesce("marked", F.lit(False)), "checked").otherwise("unchecked")).otherwise(F.nullif(F.trim(anchored), F.lit("")))
    return f.withColumn("value", value).where("value is not null").select(*PAGE, "profile", "spec_idx", "name", F.when(box, "Checkbox").otherwise("Text").alias("kind"), "value", F.lit(0.8).alias("confidence"))


def first_that_yields(fields: DataFrame) -> DataFrame:
    """Of several extractors' fields (priority), those of the first that gave any, page by page."""
    best = F.min("priority").over(Window.partitionBy(*PAGE))
    return fields.withColumn("best", best).where("priority = best").drop("best")


# widgets


def widget_labels(widgets: DataFrame, lines: DataFrame) -> DataFrame:
    """Label of each widget: a checkbox's right neighbour first, else the closest left, else the closest above; or ''.

    Lines in a widget's box, and lines without a letter, are no labels.
    """
    w, l = Box.of("a"), Box.of("l")
    inside = lines.alias("x").join(widgets.alias("y"), _on("x", "y", PAGE) & Box.of("y").holds_center(Box.of("x")), "left_anti")
    labels = inside.where(F.col("text").rlike(r"\p{L}"))
    key = [*PAGE, "widget_idx"]
    h = F.greatest(F.lit(1.0), w.height)
    row = F.abs(l.cy - w.cy) < 0.7 * h
    right = _near(widgets, labels, key, (F.col("a.kind") == "Checkbox") & row & (l.x1 >= w.x2 - 0.5 * h), l.x1, "right")
    left = _near(widgets, labels, key, row & (l.x2 <= w.x1 + 0.5 * h), -l.x2, "left")
    above = _near(widgets, labels, key, (l.y2 <= w.y1 + 0.5 * h) & (w.y1 - l.y2 < 2.5 * h) & (F.least(l.x2, w.x2) > F.greatest(l.x1, w.x1)), -l.y2, "above")
    j = widgets.join(right, key, "left").join(left, key, "left").join(above, key, "left")
    return j.withColumn("label", F.coalesce(F.trim("right"), F.trim("left"), F.trim("above"), F.lit(""))).drop("right", "left", "above")


# templates


def signature_match(pages: DataFrame, templates: DataFrame, least: float = 0.85) -> DataFrame:
    """Template page whose token set is most alike each page's by Jaccard, 0.85 at least; first on ties.

    pages: doc_id, page_number, token; templates: template_id, template_idx, page, token. An equi-join on tokens counts
    the intersections; empty sides have no tokens and so match nothing.
    """
    p, t = pages.distinct(), templates.distinct()
    n_p = p.groupBy(*PAGE).agg(F.count("*").alias("np"))
    n_t = t.groupBy("template_id", "template_idx", "page").agg(F.count("*").alias("nt"))
    both = p.join(t, "token").groupBy(*PAGE, "template_id", "template_idx", "page").agg(F.count("*").alias("k"))
    j = both.join(n_p, PAGE).join(n_t, ["template_id", "template_idx", "page"])
    j = j.withColumn("score", F.col("k") / (F.col("np") + F.col("nt") - F.col("k"))).where(F.col("score") >= least)
    best = F.struct("score", -F.col("template_idx"), -F.col("page"))
    return j.groupBy(*PAGE).agg(F.max_by(F.struct("template_id", "page", "score"), best).alias("b")).select(*PAGE, F.col("b.template_id").alias("template_id"), F.col("b.page").alias("template_page"), F.col("b.score").alias("score"))


def anchor_check(elements: DataFrame, lines: DataFrame, least: float | Column = 0.6, near: float = 0.05, anchors: int = 6) -> DataFrame:
    """Share of a template page's printed labels that a line of the page has at their place; aligned from six labels on.

    elements: template_id, element_idx, label and box fractions, beside the page (doc_id, page_number) tried; lines: cx, cy fractions.
    """
    e = elements.withColumn("tokens", distinctive_tokens(F.col("label"))).where(F.size("tokens") > 0)
    key = [*PAGE, "template_id", "element_idx"]
    a = Box.of("e")
    at = (F.abs(F.col("l.cx") - a.cx) <= near) & (F.abs(F.col("l.cy") - a.cy) <= near)
    hit = e.alias("e").join(lines.withColumn("up", F.upper("text")).alias("l"), _on("e", "l", PAGE) & at & F.exists(F.col("e.tokens"), lambda t: F.contains(F.col("l.up"), t)), "left_semi")
    n = e.groupBy(*PAGE, "template_id").agg(F.count("*").alias("n_anchors"))
    k = hit.select(*key).distinct().groupBy(*PAGE, "template_id").agg(F.count("*").alias("k"))
    j = n.join(k, [*PAGE, "template_id"], "left").withColumn("aligned", F.coalesce("k", F.lit(0))).drop("k")
    share = F.col("aligned") / F.col("n_anchors")
    return j.withColumn("share", share).withColumn("is_match", (F.col("n_anchors") >= anchors) & (share >= least))


def revision_floor(template_revision: Column, page_revision: Column) -> Column:
    """Share of labels a designated template needs: 0.15 for equal revisions, 0.6 if one is unknown, null if different."""
    return F.when(template_revision.isNull() | page_revision.isNull(), 0.6).when(template_revision == page_revision, 0.15)


def template_revision(template_id: Column) -> Column:
    return F.nullif(F.regexp_extract(template_id, r"-(\d{2})", 1), F.lit(""))


def by_designation(forms: DataFrame, registry: DataFrame) -> DataFrame:
    """Template whose id is SF and the designation, up to the end or a character that is no letter or digit; first wins."""
    want, up = F.concat(F.lit("SF"), F.upper("designation")), F.upper("template_id")
    after = F.substr(up, F.length(want) + 1, F.lit(1))
    hit = forms.join(F.broadcast(registry), F.startswith(up, want) & ~after.rlike(r"[\p{L}\p{Nd}]"))
    return hit.groupBy("doc_id", "designation").agg(F.min_by("template_id", "template_idx").alias("template_id"))


def scanned_fields(elements: DataFrame, lines: DataFrame) -> DataFrame:
    """Fields of text elements: each line goes to the element that holds its centre, the nearest centre if several do.

    Lines in order of place; those that only repeat the label are left out; a value needs some meaning; one field for
    each label and value. lines: cx, cy fractions, y1, x1.
    """
    e = elements.where("kind <> 'Checkbox'")
    b = Box.of("e")
    d = (F.col("l.cx") - b.cx) ** 2 + (F.col("l.cy") - b.cy) ** 2
    m = lines.alias("l").join(e.alias("e"), _on("l", "e", PAGE) & b.holds(F.col("l.cx"), F.col("l.cy")))
    one = m.groupBy(*[F.col(f"l.{k}").alias(k) for k in (*PAGE, "line_idx", "text", "y1", "x1")]).agg(F.min_by(F.struct(F.col("e.element_idx").alias("element_idx"), F.col("e.label").alias("label")), F.struct(d, F.col("e.element_idx"))).alias("e"))
    one = one.withColumn("element_idx", F.col("e.element_idx")).withColumn("label", F.when(F.col("e.label") == "", "(unlabeled)").otherwise(F.col("e.label")))
    v = one.where(~is_echo(F.col("text"), F.col("label"))).groupBy(*PAGE, "element_idx", "label").agg(in_order(F.col("text"), F.col("y1"), F.col("x1"), F.col("line_idx"), separator=" ").alias("value"))
    v = v.withColumn("value", F.trim(F.regexp_replace("value", r"\s+", " "))).where(is_meaningful(F.col("value")))
    first = F.row_number().over(Window.partitionBy(*PAGE, F.lower("label"), F.lower("value")).orderBy("element_idx"))
    return v.withColumn("i", first).where("i = 1").select(*PAGE, "element_idx", F.col("label").alias("name"), "value")


def _bound(t: pa.Table) -> pa.Table:
    e = [r for r in t.to_pylist() if r["is_element"]]
    w = [r for r in t.to_pylist() if not r["is_element"]]
    e.sort(key=lambda r: r["idx"])
    w.sort(key=lambda r: r["idx"])
    c = lambda r: ((r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2)
    inside = lambda box, p, pad=0.01: box["x1"] - pad <= p[0] <= box["x2"] + pad and box["y1"] - pad <= p[1] <= box["y2"] + pad
    used: set[int] = set()
    out: list[dict] = []
    for x in e:
        near = [(((c(x)[0] - c(y)[0]) ** 2 + (c(x)[1] - c(y)[1]) ** 2), k) for k, y in enumerate(w) if k not in used and (inside(x, c(y)) and inside(y, c(x)))]
        if not near:
            continue
        k = min(near)[1]
        used.add(k)
        y = w[k]
        box = x["kind"] == "Checkbox"
        if (box and not y["is_on"]) or (not box and not (y["value"] or "").strip()):
            continue
        name = (x["grp"] or x["label"] or "(unlabeled)") if box else (x["label"] or "(unlabeled)")
        out.append({"doc_id": x["doc_id"], "page_number": x["page_number"], "element_idx": x["idx"], "widget_idx": y["idx"], "kind": x["kind"], "name": name, "value": (x["label"] or "(unlabeled)") if box else y["value"].strip()})
    cols = [("doc_id", pa.int64()), ("page_number", pa.int32()), ("element_idx", pa.int32()), ("widget_idx", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("value", pa.string())]
    return pa.table({n: pa.array([o[n] for o in out], k) for n, k in cols})


def bind_template(elements: DataFrame, widgets: DataFrame) -> DataFrame:
    """Elements in template order each take the nearest free widget that overlaps them; greedy, one to one, per page."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), "x1", "y1", "x2", "y2"]
    e = elements.select(*cols, F.lit(True).alias("is_element"), F.col("element_idx").cast("int").alias("idx"), "kind", "label", "grp", F.lit(None).cast("string").alias("value"), F.lit(False).alias("is_on"))
    w = widgets.select(*cols, F.lit(False).alias("is_element"), F.col("widget_idx").cast("int").alias("idx"), F.lit("").alias("kind"), F.lit("").alias("label"), F.lit(None).cast("string").alias("grp"), "value", "is_on")
    return e.unionByName(w).groupBy(*PAGE).applyInArrow(_bound, "doc_id long, page_number int, element_idx int, widget_idx int, kind string, name string, value string")


def one_element_each(elements: DataFrame, grid: int = 1000) -> DataFrame:
    """Elements of one kind, page and rounded centre: the longest label stays, first on ties."""
    b = Box.of()
    key = Window.partitionBy("template_id", "kind", "page", F.bround(b.cx * grid), F.bround(b.cy * grid))
    return elements.withColumn("slot", F.min("element_idx").over(key)).withColumn("i", F.row_number().over(key.orderBy(F.desc(F.length("label")), "element_idx"))).where("i = 1").withColumn("element_idx", F.col("slot")).drop("i", "slot")


def _inherited(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["element_idx"])
    for r in rows:
        if r["kind"] == "Text" and not r["label"]:
            cx, cy = (r["x1"] + r["x2"]) / 2, (r["y1"] + r["y2"]) / 2
            best = None
            for o in rows:
                if o["kind"] == "Text" and o["label"] and o["page"] == r["page"] and abs((o["x1"] + o["x2"]) / 2 - cx) <= 0.03:
                    dy = cy - (o["y1"] + o["y2"]) / 2
                    if 0 < dy <= 0.25 and (best is None or dy < best[0]):
                        best = (dy, o["label"])
            if best:
                r["label"] = best[1]  # the next may inherit it from here
    return pa.Table.from_pylist(rows, schema=t.schema)


def inherit_labels(elements: DataFrame) -> DataFrame:
    """Blank text elements take the label of the nearest labelled one above in their column; in list order, in place."""
    return elements.groupBy("template_id").applyInArrow(_inherited, elements.schema)


def fingerprint(elements: DataFrame) -> DataFrame:
    """SHA-256 of each template's sorted tokens (page, kind, rounded centre)."""
    b = Box.of()
    token = F.concat_ws(":", F.col("page").cast("string"), "kind", F.bround(b.cx * 1000).cast("int").cast("string"), F.bround(b.cy * 1000).cast("int").cast("string"))
    return elements.groupBy("template_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(token)), "|"), 256).alias("fingerprint"))


def merge_registries(bundled: DataFrame, customer: DataFrame) -> DataFrame:
    """Templates of both, the customer's in place of a bundled one with the same id in any case."""
    b, c = (d.select(F.lower("template_id").alias("k"), F.struct("template_id", "name", "version").alias(n)) for d, n in ((bundled, "b"), (customer, "c")))
    return b.join(c, "k", "full_outer").select(F.coalesce("c", "b").alias("t"), F.when(F.col("c").isNotNull(), "customer").otherwise("bundled").alias("origin")).select("t.*", "origin")


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The template store after new versions: the newest row of each id. Deletion is a row with deleted = true."""
    every = store.unionByName(new)
    i = F.row_number().over(Window.partitionBy("template_id").orderBy(F.desc("version")))
    return every.withColumn("i", i).where("i = 1 and not deleted").drop("i")


# learned spans


def pair_values(spans: DataFrame, page_width: float, most: float = 0.35, words: DataFrame | None = None) -> DataFrame:
    """Nearest key of each value: left of it by the gap, or above by the gap and a quarter of the shift; within 0.35 of
    the page's width. A key may serve several values. A value without one takes the printed words near it, where words
    are given (see nearby_words()); else it stays, with a null key.

    spans: span_idx, kind (Key or Value), text, confidence, box.
    """
    k, v = Box.of("k"), Box.of("v")
    row = (k.cy >= v.y1 - v.height) & (k.cy <= v.y2 + v.height) & (k.x2 <= v.x1 + 0.25 * v.width)
    above = (k.y2 <= v.y1 + 0.5 * v.height) & (k.x2 >= v.x1 - k.width) & (k.x1 <= v.x2)
    zero = F.lit(0.0)
    d = F.when(row, F.greatest(zero, v.x1 - k.x2)).when(above, F.greatest(zero, v.y1 - k.y2) + 0.25 * F.abs(k.x1 - v.x1))
    keys, values = spans.where("kind = 'Key'"), spans.where("kind = 'Value'")
    m = values.alias("v").join(keys.alias("k"), _on("v", "k", PAGE) & (d <= most * page_width))
    best = m.groupBy(*[F.col(f"v.{c}").alias(c) for c in (*PAGE, "span_idx")]).agg(F.min_by(F.struct(F.col("k.text").alias("key"), F.col("k.confidence").alias("kc")), F.struct(d, F.col("k.span_idx"))).alias("b"))
    j = values.join(best, [*PAGE, "span_idx"], "left").withColumn("key", F.col("b.key"))
    if words is not None:
        near = nearby_words(j.where("b is null").select(*PAGE, "span_idx", "x1", "y1", "x2", "y2"), words)
        j = j.drop("key").join(near, [*PAGE, "span_idx"], "left").withColumn("key", F.coalesce("b.key", "near")).drop("near")
    return j.select(*PAGE, "span_idx", "key", F.col("text").alias("value"), F.coalesce(F.least("confidence", "b.kc"), F.col("confidence")).alias("confidence"))


def nearby_words(values: DataFrame, words: DataFrame, most: int = 10) -> DataFrame:
    """near: the printed name of each value, by place: the run of words left of it in its row, gaps of at most two
    heights between; else the nearest row above it. At most ten words, without colon, stop or dash at the end.

    words: word_idx, text, in_value, box; those in a value, or without a letter, name nothing. A value's words are few:
    they are one array a value, on which the run is taken.
    """
    v, w = Box.of("v"), Box.of("w")
    h = F.greatest(F.lit(1.0), v.height)
    left = (F.abs(w.cy - v.cy) <= 0.8 * F.greatest(h, w.height)) & (w.x2 <= v.x1 + 0.25 * h)
    above = (w.y2 <= v.y1 + 0.5 * h) & (w.x2 >= v.x1 - 2 * h) & (w.x1 <= v.x2 + 2 * h) & (v.y1 - w.y2 <= 3.5 * h)
    names = words.where(~F.col("in_value") & F.col("text").rlike(r"\p{L}"))
    m = values.alias("v").join(names.alias("w"), _on("v", "w", PAGE) & (left | above))
    rest = [F.col("w.x1").alias("x1"), F.col("w.x2").alias("x2"), F.col("w.y2").alias("y2"), F.col("w.text").alias("text")]
    word = lambda order: F.struct(order.alias("o"), F.col("w.word_idx").alias("i"), *rest)
    g = m.groupBy(*[F.col(f"v.{c}").alias(c) for c in (*PAGE, "span_idx")], v.x1.alias("edge"), h.alias("h")).agg(
        F.array_sort(F.collect_list(F.when(left, word(-w.x2)))).alias("ls"),
        F.array_sort(F.collect_list(F.when(above, word(-w.y2)))).alias("above"),
    )
    kind = g.schema["ls"].dataType.simpleString()
    start = F.struct(F.col("edge").alias("edge"), F.lit(True).alias("goes"), F.array().cast(kind).alias("run"))

    def step(acc: Column, x: Column) -> Column:
        goes = acc["goes"] & (acc["edge"] - x["x2"] <= 2 * F.col("h"))
        return F.struct(F.when(goes, x["x1"]).otherwise(acc["edge"]).alias("edge"), goes.alias("goes"), F.when(goes, F.concat(F.array(x), acc["run"])).otherwise(acc["run"]).alias("run"))

    g = g.withColumn("run", F.aggregate("ls", start, step, lambda acc: acc["run"]))
    row = F.filter("above", lambda x: F.element_at("above", 1)["y2"] - x["y2"] <= 0.8 * F.col("h"))
    row = F.transform(F.array_sort(F.transform(row, lambda x: F.struct(x["x1"].alias("x1"), x["o"].alias("o"), x["i"].alias("i"), x["text"].alias("text")))), lambda x: x["text"])
    chosen = F.when(F.size("run") > 0, F.transform("run", lambda x: x["text"])).otherwise(F.when(F.size("above") > 0, row).otherwise(F.array().cast("array<string>")))
    text = F.regexp_replace(F.trim(F.array_join(F.slice(chosen, 1, most), " ")), r"[:.\-]+$", "")
    return g.select(*PAGE, "span_idx", F.nullif(text, F.lit("")).alias("near"))


def bio_spans(labels: DataFrame) -> DataFrame:
    """Spans of labelled words: kind, first and last word, number of words, mean probability.

    labels: word_idx, label (B-KEY, I-KEY, B-VALUE, I-VALUE, KEY, VALUE, O), prob. A word goes on with the span before it
    if it follows a span of its kind with tag I, or is a bare VALUE right after a VALUE.
    """
    w = Window.partitionBy(*PAGE).orderBy("word_idx")
    tag = F.when(F.col("label") == "O", "O").when(F.col("label").rlike("^[BI]-"), F.substring("label", 1, 1)).otherwise("B")
    kind = F.when(F.upper("label").endswith("KEY"), "Key").otherwise("Value")
    l = labels.withColumn("tag", tag).withColumn("kind", F.when(F.col("label") != "O", kind))
    near = F.lag("word_idx").over(w) == F.col("word_idx") - 1
    same = near & (F.lag("kind").over(w) == F.col("kind"))
    goes_on = F.coalesce(same & ((F.col("tag") == "I") | (F.col("label") == "VALUE")), F.lit(False))
    l = l.withColumn("span", F.sum(F.when(goes_on, 0).otherwise(1)).over(w)).where("kind is not null")
    return l.groupBy(*PAGE, "span", "kind").agg(F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"), F.count("*").alias("n_words"), F.avg("prob").alias("confidence")).drop("span")


def word_boxes(lines: DataFrame) -> DataFrame:
    """Boxes of a line's words, its width shared by characters (one for each space between)."""
    w = lines.withColumn("w", F.filter(F.split("text", " "), lambda x: x != "")).where(F.size("w") > 0)
    total = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)) + F.size("w") - 1
    unit = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")) / F.greatest(F.lit(1), total)
    w = w.withColumn("unit", unit).select("*", F.posexplode("w").alias("word_idx", "word"))
    before = F.aggregate(F.slice("w", 1, F.col("word_idx")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    x1 = F.col("x1") + before * F.col("unit")
    return w.select(*PAGE, "line_idx", "word_idx", F.col("word").alias("text"), x1.alias("x1"), "y1", F.least(x1 + F.length("word") * F.col("unit"), F.col("x2")).alias("x2"), "y2")


def token_windows(counts: DataFrame, size: int = 512, overlap: float = 0.25) -> DataFrame:
    """Windows over each page's words, a quarter shared: doc_id, page_number, window, first_word, last_word."""
    step = max(1, int(size * (1 - overlap)))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.col("n_words") - size) / step)).cast("int"))
    w = counts.where("n_words > 0").select(*PAGE, "n_words", F.explode(starts).alias("window"))
    return w.select(*PAGE, "window", (F.col("window") * step).alias("first_word"), (F.least(F.col("window") * step + size, F.col("n_words")) - 1).cast("int").alias("last_word"))


def merge_windows(readings: DataFrame) -> DataFrame:
    """One label for each word from overlapping windows: the most interior reading, then the likeliest."""
    return readings.groupBy(*PAGE, "word_idx").agg(F.max_by(F.struct("label", "prob"), F.struct("interior", "prob")).alias("b")).select(*PAGE, "word_idx", "b.label", "b.prob")


def _paired(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: (-r["bucket"], -int(r["value_match"]), -r["overlap"], r["truth_idx"], r["pred_idx"]))
    seen_t, seen_p, out = set(), set(), []
    for r in rows:
        if r["truth_idx"] not in seen_t and r["pred_idx"] not in seen_p:
            seen_t.add(r["truth_idx"])
            seen_p.add(r["pred_idx"])
            out.append(r)
    return pa.Table.from_pylist(out, schema=t.schema)


def pair_truth(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth fields and predictions, one to one: pairs by overlap in steps of 0.05, value match, overlap; greedy.

    truth: truth_idx, value, box; predicted: pred_idx, value, box.
    """
    a, b = Box.of("t"), Box.of("p")
    over = a.overlap_of_smaller(b)
    j = truth.alias("t").join(predicted.alias("p"), _on("t", "p", PAGE) & (over > 0))
    tv, pv = alnum_lower(F.col("t.value")), alnum_lower(F.col("p.value"))
    match = (tv != "") & (pv != "") & (F.contains(tv, pv) | F.contains(pv, tv))
    pairs = j.select(F.col("t.doc_id").alias("doc_id"), F.col("t.page_number").alias("page_number"), "truth_idx", "pred_idx", over.alias("overlap"), F.floor(over / 0.05).cast("int").alias("bucket"), match.alias("value_match"))
    return pairs.groupBy(*PAGE).applyInArrow(_paired, pairs.schema)


