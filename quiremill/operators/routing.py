"""Which lane a page takes: rules, whole-document rules, abstention, merging with provenance, and fast-lane text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import not_blank
from ..sources.tables import PAGE, in_order, spare

FAST_KINDS = ("FormPage", "DigitalText", "Empty")
PIXEL_KINDS = ("ScannedImageOnly", "ScannedWithOcr", "Mixed")
KIND_OF_CLASS = {"digital_text": "DigitalText", "form": "FormPage", "empty": "Empty", "table_or_complex": "TableOrComplexLayout", "scanned_image": "ScannedImageOnly", "scanned_ocr": "ScannedWithOcr", "mixed": "Mixed", "unprocessable": "Unprocessable"}


def page_kind(cls: Column) -> Column:
    """An engine's page class as our kind; unknown ones are Mixed."""
    table = F.create_map(*[F.lit(x) for kv in KIND_OF_CLASS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, cls), F.lit("Mixed"))


def classify(documents: DataFrame, signals: DataFrame) -> DataFrame:
    """doc_id, page_number, kind, confidence, rulings of every page.

    documents: doc_id, status, has_xfa, page_count. Not processed: pages 1 to page_count, all Unprocessable. No classified
    page: the same, all Mixed. Else just the classified pages; XFA makes them Mixed. A page_count that is not set is the
    number of classified pages. Filled pages have confidence 1 and no rulings, whatever a signal says.
    """
    n = signals.groupBy("doc_id").agg(F.count("*").alias("n"))
    d = documents.join(n, "doc_id", "left").select("doc_id", "status", "has_xfa", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("page_count", F.lit(0)).alias("page_count"))
    stopped = F.col("status") != "Processed"
    every = stopped | (F.col("n") == 0)
    count = F.when(F.col("page_count") > 0, F.col("page_count")).otherwise(F.col("n")).cast("int")
    filled = d.where(every).withColumn("count", count).where("count > 0").select("doc_id", "status", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("page_number"))
    filled = filled.select(*PAGE, F.when(stopped, "Unprocessable").otherwise("Mixed").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(0).alias("rulings"))
    own = d.where(~every).select("doc_id", "has_xfa").join(signals, "doc_id")
    own = own.select(*PAGE, F.when(F.col("has_xfa"), "Mixed").otherwise(page_kind(F.col("class"))).alias("kind"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("rulings", F.lit(0)).alias("rulings"))
    return filled.unionByName(own)


def lane_of(kind: Column, confidence: Column, rulings: Column, min_confidence: float = 0.6, ruling_threshold: int = 0) -> Column:
    table = F.when(rulings < ruling_threshold, "Fast").otherwise("Heavy")
    return F.when(kind == "Unprocessable", "Stop").when(kind.isin(*FAST_KINDS), F.when(confidence < min_confidence, "Heavy").otherwise("Fast")).when(kind == "TableOrComplexLayout", table).otherwise("Heavy")


def with_lanes(pages: DataFrame, min_confidence: float = 0.6, ruling_threshold: int = 0, escalation_share: float = 0.8) -> DataFrame:
    """The pages with all their columns, and lane, reason, stopped and escalated; see lane_plan()."""
    own, share = spare(pages, "own", "share")
    doc = Window.partitionBy("doc_id")
    p = pages.withColumn(own, lane_of(F.col("kind"), F.col("confidence"), F.col("rulings"), min_confidence, ruling_threshold))
    p = p.withColumn("stopped", F.max(F.col("kind") == "Unprocessable").over(doc)).withColumn(share, F.avg(F.when(F.col(own) == "Heavy", 1.0).otherwise(0.0)).over(doc))
    p = p.withColumn("escalated", ~F.col("stopped") & (F.col(share) >= escalation_share))
    lane = F.when(F.col("stopped"), "Stop").when(F.col("escalated"), "Heavy").otherwise(F.col(own))
    reason = (
        F.when(F.col("stopped"), "document stopped")
        .when(F.col("escalated"), "whole document escalated")
        .when(F.col("kind").isin(*FAST_KINDS), F.when(F.col(own) == "Heavy", "low confidence").otherwise("answered by structure"))
        .when(F.col("kind") == "TableOrComplexLayout", F.when(F.col(own) == "Fast", "few rulings: read as text").otherwise("table needs pixels"))
        .when(F.col("kind").isin(*PIXEL_KINDS), "needs pixels")
        .otherwise("unknown kind")
    )
    return p.withColumn("lane", lane).withColumn("reason", reason).drop(own, share)


def lane_plan(pages: DataFrame, min_confidence: float = 0.6, ruling_threshold: int = 0, escalation_share: float = 0.8) -> DataFrame:
    """lane and reason of every page; one Unprocessable page stops its document, a heavy share of 0.8 escalates it.

    Document rules are window aggregates over doc_id: one shuffle.
    """
    return with_lanes(pages, min_confidence, ruling_threshold, escalation_share).select(*PAGE, "kind", "confidence", "rulings", "lane", "reason", "stopped", "escalated")


def lane_summary(plan: DataFrame) -> DataFrame:
    """Of each document: pages by lane, heavy page list, escalation share (0 without pages), stopped, escalated."""
    count = [F.count_if(F.col("lane") == x).alias(f"n_{x.lower()}") for x in ("Fast", "Heavy", "Stop")]
    heavy = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("lane") == "Heavy", F.col("page_number")))), lambda x: x.cast("string")), ",")
    return plan.groupBy("doc_id").agg(*count, heavy.alias("heavy_pages"), F.avg(F.when(F.col("lane") == "Heavy", 1.0).otherwise(0.0)).alias("escalation_share"), F.max("stopped").alias("stopped"), F.max("escalated").alias("escalated"))


def abstains(kind: Column, fields: Column, words: Column, runs: Column, trust: Column, min_words: int = 5, min_runs: int = 10, min_trust: float = 0.5) -> Column:
    """The fast lane gives a page up: a form without fields and words; untrusted decoding; structure without words."""
    form = (F.coalesce(fields, F.lit(0)) == 0) & (words < min_words)
    return F.when(kind == "FormPage", form).otherwise((trust < min_trust) | ((words < min_words) & (runs >= min_runs)))


def merge_lanes(plan: DataFrame, fast: DataFrame, heavy: DataFrame) -> DataFrame:
    """Every page once, the fast result where it stands, with the engine it came from.

    fast: doc_id, page_number, markdown, abstain; heavy: doc_id, page_number, markdown (only pages it was given).
    """
    f = fast.where(~F.col("abstain")).select(*PAGE, F.col("markdown").alias("fast_md"), F.lit(True).alias("has_fast"))
    h = heavy.select(*PAGE, F.col("markdown").alias("heavy_md"), F.lit(True).alias("has_heavy"))
    p = plan.join(f, PAGE, "left").join(h, PAGE, "left")
    use_fast = (F.col("lane") == "Fast") & F.col("has_fast").isNotNull()
    return p.select(*PAGE, "lane", F.when(use_fast, F.col("fast_md")).otherwise(F.col("heavy_md")).alias("markdown"), F.when(use_fast, "structure").when(F.col("has_heavy").isNotNull(), "pixels").alias("produced_by"))


def provenance(merged: DataFrame) -> DataFrame:
    """doc_id, map of page to engine."""
    pages = F.array_sort(F.collect_list(F.struct("page_number", "produced_by")))
    return merged.groupBy("doc_id").agg(F.map_from_entries(pages).alias("engines"))


def prose(runs: DataFrame, idx: str = "run_idx") -> DataFrame:
    """Markdown of each page from positioned runs (y up): lines, paragraphs and spaces by geometry.

    A run stays on the line within 0.6 of the larger font below the run before; beyond 1.8 a paragraph ends. A space
    goes between runs of a line where the gap exceeds half a space's width and neither side has white space.
    """
    r = runs.where(~F.col("is_ocr_layer") & not_blank(F.col("text")))
    page = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "x", idx)
    font = F.when(F.col("font_size") > 0, F.col("font_size"))
    known = F.coalesce(font, F.last(font, ignorenulls=True).over(page), F.lit(10.0))
    r = r.withColumn("font", known).withColumn("prev_font", F.coalesce(F.lag("font").over(page), F.col("font"))).withColumn("dy", F.lag("y").over(page) - F.col("y"))
    big = F.greatest("font", "prev_font")
    r = r.withColumn("brk", F.when(F.col("dy").isNull(), 0).when(F.col("dy") <= 0.6 * big, 0).when(F.col("dy") > 1.8 * big, 2).otherwise(1))
    r = r.withColumn("line", F.sum(F.when(F.col("brk") > 0, 1).otherwise(0)).over(page))
    line = Window.partitionBy(*PAGE, "line").orderBy("x", F.desc("y"), idx)
    size = F.coalesce(F.when(F.lag("font_size").over(line) > 0, F.lag("font_size").over(line)), font, F.lit(1.0))
    em = F.when(F.lag("space_width_em").over(line) > 0, F.lag("space_width_em").over(line)).otherwise(0.25)
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(line)
    tight = F.lag("text").over(line).rlike(r"\s$") | F.col("text").rlike(r"^\s")
    r = r.withColumn("piece", F.concat(F.when(~tight & (gap > 0.5 * em * size), " ").otherwise(""), F.col("text"))).withColumn("i", F.row_number().over(line))
    lines = r.groupBy(*PAGE, "line").agg(in_order(F.col("piece"), F.col("i"), separator="").alias("t"), F.max("brk").alias("brk"))
    lead = F.when(F.col("brk") == 2, "\n\n").when(F.col("brk") == 1, "\n").otherwise("")
    return lines.groupBy(*PAGE).agg(F.trim(in_order(F.concat(lead, F.col("t")), F.col("line"), separator="")).alias("markdown"))


def field_line(name: Column, value: Column, kind: Column) -> Column:
    shown = F.when(kind == "Checkbox", F.when(value == "checked", "[x]").otherwise("[ ]")).otherwise(value)
    return F.concat(F.lit("- **"), name, F.lit(":** "), shown)


def form_markdown(fields: DataFrame, idx: str = "field_idx") -> DataFrame:
    """A bullet for each field of a page: name, value or box."""
    return fields.groupBy(*PAGE).agg(in_order(field_line(F.col("name"), F.col("value"), F.col("kind")), F.col(idx), separator="\n").alias("markdown"))


def adapt_field(fields: DataFrame) -> DataFrame:
    """An engine's fields as ours: qualified, else partial name, else label; buttons checked or not; blank text goes."""
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("qualified_name", "partial_name", "label")], F.lit("(unnamed)"))
    value = F.when(F.col("field_type") == "Button", F.when(F.col("is_checked"), "checked").otherwise("unchecked")).otherwise(F.nullif(F.trim("value"), F.lit("")))
    return fields.withColumn("name", name).withColumn("value", value).withColumn("kind", F.when(F.col("field_type") == "Button", "Checkbox").otherwise("Text")).where("value is not null")


def adapt_run(runs: DataFrame) -> DataFrame:
    """An engine's runs as lines: box from origin, width and font size."""
    return runs.select(*PAGE, "run_idx", "text", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("font_size")).alias("y2"), F.when(F.col("is_ocr_layer"), "Ocr").otherwise("TextLayer").alias("source"))


def route_census(plan: DataFrame, corpus: str = "source") -> DataFrame:
    """Documents, pages and lane shares by corpus, and over all (corpus null)."""
    lanes = [F.count_if(F.col("lane") == x).alias(f"n_{x.lower()}") for x in ("Fast", "Heavy", "Stop")]
    share = F.count_if(F.col("lane") == "Heavy") / F.count("*")
    return plan.rollup(corpus).agg(F.count("*").alias("pages"), *lanes, share.alias("heavy_share"), F.count_if(F.col("kind") == "TableOrComplexLayout").alias("n_tables"))
