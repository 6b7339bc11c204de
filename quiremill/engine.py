"""The front door: an engine over a session, with the options that change results as keyword arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compose, forms, layer, order, routing, shape, signals, specs, verify
from .operators.pixels import STAGES, apply_stage, register
from .process import Corpus, Options, Result, process, process_routed
from .sources import tables


@dataclass
class Engine:
    spark: SparkSession
    options: Options = field(default_factory=Options)

    def process(self, corpus: Corpus, on_plan: Callable[[DataFrame], None] | None = None) -> Result:
        """Documents of a corpus, by lanes where fast_lane is on."""
        return process_routed(corpus, self.options, on_plan) if self.options.fast_lane else process(corpus, self.options)

    def with_options(self, **changes: object) -> Engine:
        return Engine(self.spark, replace(self.options, **changes))

    def register_stage(self, name: str, stage: Callable, schema: str) -> None:
        register(name, stage, schema)

    def stage(self, rasters: DataFrame, name: str) -> DataFrame:
        return apply_stage(rasters, name)

    def wanted(self, pages: DataFrame) -> DataFrame:
        """The page subset, before any stage that Catalyst cannot look into."""
        o = self.options
        return pages if o.pages is None else pages.where(F.col("page_number").isin(sorted(set(o.pages))))

    def plan(self, pages: DataFrame) -> DataFrame:
        o = self.options
        planned = routing.lane_plan(self.wanted(pages), o.min_fast_confidence, o.ruling_threshold, o.escalation_share)
        return planned if o.fast_lane else planned.withColumn("lane", F.when(F.col("lane") == "Stop", "Stop").otherwise("Heavy"))

    def lines(self, words: DataFrame) -> DataFrame:
        return layer.text_runs(self.wanted(words))

    def uses_layer(self, words: DataFrame) -> DataFrame:
        o = self.options
        q = layer.layer_quality(self.wanted(words))
        return q.withColumn("uses_layer", layer.uses_layer(F.lit(o.text_layer), F.col("word_count"), F.col("dropped_fraction"), F.col("undecodable_fraction"), o.min_layer_words, o.max_dropped, o.max_undecodable))

    def pages(self, lines: DataFrame, regions: DataFrame, table_markdown: DataFrame | None = None) -> DataFrame:
        """Composed pages: duplicates out, order, claim, render, orphans."""
        ordered = order.reading_order(self.wanted(regions))
        if self.options.enumerator_order:
            claimed = compose.claim(lines, ordered)
            top = claimed.where("region_idx is not null").groupBy(*compose.TABLE).agg(F.min_by("text", F.struct("y1", "x1", "line_idx")).alias("top_text"))
            ordered = order.enumerators(ordered.join(top, compose.TABLE, "left")).drop("top_text")
        return compose.compose_pages(self.wanted(lines), ordered, table_markdown)

    def documents(self, pages: DataFrame, components: DataFrame | None = None) -> DataFrame:
        """Documents of pages; with hardware specifications appended where asked for."""
        docs = tables.document_markdown(pages)
        return specs.append_section(docs, specs.section(components)) if self.options.hardware_specs and components is not None else docs

    def markings(self, lines: DataFrame) -> DataFrame:
        return signals.sensitivity(lines)

    def recall(self, truth: DataFrame, output: DataFrame) -> DataFrame:
        return verify.word_recall(truth, output)

    def fields(self, lines: DataFrame, profiles: DataFrame, names: DataFrame) -> DataFrame:
        return forms.geometric_fields(lines, profiles, names)

    def window(self, pages: DataFrame, start: int = 1, count: int = 10) -> DataFrame:
        return shape.page_window(pages, start, count, self.options.block_marked)

    def summary(self, pages: DataFrame) -> DataFrame:
        return shape.summary(pages, self.options.block_marked)

    def health(self) -> dict[str, object]:
        return {"spark": self.spark.version, "stages": sorted(STAGES), "options": self.options}
