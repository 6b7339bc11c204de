"""Reports and datasets about whole corpora: censuses of scans, honest recall, orientation, filled forms, label sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import PAGE
from .verify import word_recall

#: Values that a form filler writes, by words in a field's name; the first that fits holds.
FILLERS = [("date", "2024-0{0}-1{0}"), ("phone|fax|tel", "555-010{0}"), ("zip|postal", "9021{0}"), ("email|mail", "person{0}@example.org"), ("amount|total|price|cost", "{0}{0}50.00"), ("name|officer|signer", "Pat Example {0}"), ("city", "Springfield {0}"), ("state", "VA"), ("number|no$|id$", "A-{0}{0}{0}"), ("title", "Manager {0}")]


def honest_recall(degraded: DataFrame, original: DataFrame, reported: DataFrame) -> DataFrame:
    """Recall of a degraded copy against the original's words, beside what the copy says of itself.

    A page without a word in the copy, though the original has some and the page is not flagged, is silently empty.
    """
    r = word_recall(original, degraded)
    n = degraded.groupBy(*PAGE).agg(F.count("*").alias("words"))
    j = r.join(n, PAGE, "left").join(reported.select(*PAGE, F.col("recall_pct").alias("reported_pct"), "needs_review"), PAGE, "left")
    return j.withColumn("silent_empty", (F.coalesce("words", F.lit(0)) == 0) & (F.col("truth_words") > 0) & ~F.coalesce("needs_review", F.lit(False)))


def scan_census(pages: DataFrame) -> DataFrame:
    """Of each corpus: pages, words, mean resolution, low-resolution pages, flagged and noticed pages; then over all."""
    return pages.rollup("corpus").agg(
        F.count("*").alias("pages"), F.sum("words").alias("words"), F.bround(F.avg("dpi"), 1).alias("mean_dpi"), F.count_if("low_resolution").alias("low_resolution"), F.count_if("needs_review").alias("needs_review"), F.count("notice").alias("notices")
    )


def orientation_report(pages: DataFrame) -> DataFrame:
    """Pages and mean recall by the rotation applied."""
    return pages.groupBy("rotation").agg(F.count("*").alias("pages"), F.bround(F.avg("recall_pct"), 1).alias("avg_recall"))


def filled_value(name: Column, seed: int = 0) -> Column:
    """The value a filler writes into a field, by its name; digits follow from a hash of the name."""
    digit = (F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(9)) + 1).cast("string")
    value = None
    for words, shape in FILLERS:
        hit = F.lower(name).rlike(words)
        text = F.replace(F.lit(shape), F.lit("{0}"), digit)
        value = F.when(hit, text) if value is None else value.when(hit, text)
    return value.otherwise(F.concat(F.lit("value "), digit))


def label_set(widgets: DataFrame, variants: list[str]) -> DataFrame:
    """A training row for each widget and variant of its page: box, kind, value, checked, name."""
    v = F.explode(F.array(*map(F.lit, variants))).alias("variant")
    return widgets.select(*PAGE, "widget_idx", "kind", "value", (F.col("value") == "X").alias("checked"), "name", "x1", "y1", "x2", "y2", v)


def reading_order_set(regions: DataFrame, ranks: DataFrame) -> DataFrame:
    """Regions with the rank a reader gives them, for pages that have one."""
    return regions.join(ranks.where("gold_rank is not null").select(*PAGE, "region_idx", "gold_rank"), [*PAGE, "region_idx"])


def key_value_set(fields: DataFrame) -> DataFrame:
    """Named fields of each page as one row, names and values in order."""
    f = F.transform(F.array_sort(F.collect_list(F.struct("field_idx", "name", "value"))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return fields.groupBy(*PAGE).agg(f.alias("fields"))


def scan_pairs(clean: DataFrame, degraded: DataFrame) -> DataFrame:
    """Each page's text in the clean and in the degraded reading."""
    return clean.select(*PAGE, F.col("markdown").alias("clean")).join(degraded.select(*PAGE, F.col("markdown").alias("degraded")), PAGE)
