"""What a service returns of results: windows, caps, redaction, summaries, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cap, was_capped
from ..sources.tables import in_order

WINDOW_PAGES, PAGE_CHARS, SUMMARY_CHARS, FIELDS = 20, 20_000, 40_000, 200


def redacted(markdown: Column, marking: Column, block: bool) -> Column:
    """The body, or a notice in its place where the page is marked and marked pages are blocked."""
    body = F.coalesce(markdown, F.lit(""))
    if not block:
        return body
    return F.when(marking.isNotNull(), F.concat(F.lit("[withheld: page marked '"), marking, F.lit("']"))).otherwise(body)


def page_window(pages: DataFrame, start: int = 1, count: int = 10, block: bool = False, content: bool = True) -> DataFrame:
    """Rows of at most twenty pages of each document from a page on; start and count are clamped."""
    doc = Window.partitionBy("doc_id")
    count = min(max(count, 1), WINDOW_PAGES)
    md = redacted(F.col("markdown"), F.col("marking"), block)
    body = [cap(md, PAGE_CHARS).alias("markdown"), was_capped(md, PAGE_CHARS).alias("truncated")] if content else [F.lit(None).cast("string").alias("markdown"), F.lit(False).alias("truncated")]
    # bodies are cut before they are shuffled and sorted
    p = pages.select("doc_id", "page_number", *body, F.bround("recall_pct", 1).alias("recall_pct"), "needs_review", "marking").withColumn("total_pages", F.count("*").over(doc))
    p = p.withColumn("from_page", F.least(F.greatest(F.lit(start), F.lit(1)), F.greatest(F.lit(1), F.col("total_pages"))))
    p = p.where("page_number >= from_page").withColumn("i", F.row_number().over(doc.orderBy("page_number"))).where(F.col("i") <= count)
    return p.select("doc_id", "page_number", "total_pages", "from_page", "markdown", "truncated", "recall_pct", "needs_review", "marking")


def summary(pages: DataFrame, block: bool = False) -> DataFrame:
    """One row for each document: capped Markdown, average recall, pages for review, marked pages, seconds."""
    md = in_order(redacted(F.col("markdown"), F.col("marking"), block), F.col("page_number"), separator="\n\n")
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("page_number")))), lambda x: x.cast("string")), ",")
    s = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), md.alias("md"), F.bround(F.avg("recall_pct"), 1).alias("avg_recall"), listed(F.col("needs_review")).alias("review_pages"), listed(F.col("marking").isNotNull()).alias("marked_pages"), F.bround(F.sum("seconds"), 2).alias("seconds"))
    return s.withColumn("markdown", cap(F.col("md"), SUMMARY_CHARS)).withColumn("truncated", was_capped(F.col("md"), SUMMARY_CHARS)).drop("md")


def capped_fields(fields: DataFrame, most: int = FIELDS) -> DataFrame:
    """The first fields of each document, in order."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "field_idx"))
    return fields.withColumn("i", i).where(F.col("i") <= most).drop("i")


def top_offenders(pages: DataFrame, n: int = 10) -> DataFrame:
    """Pages with the least recall."""
    return pages.where("recall_pct is not null").orderBy("recall_pct", "doc_id", "page_number").limit(n)


def seeded_sample(items: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n items by a hash of key and seed: the same at every run."""
    return items.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(n)
