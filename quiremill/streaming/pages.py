"""Documents that arrive: the same per-page transforms as in batch, and a document-level step once all pages are there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.routing import lane_plan


def page_stream(spark: SparkSession, path: str, schema: str, files: int = 8) -> DataFrame:
    """Page rows from Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(pages: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each page once, however often it is delivered within the delay."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["doc_id", "page_number"])


def windowed_counts(pages: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Pages and documents by window of arrival; late ones count until the watermark passes."""
    return pages.withWatermark(time, delay).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("pages"), F.approx_count_distinct("doc_id").alias("docs")).select(F.col("w.start").alias("start"), "pages", "docs")


def _complete(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, of = state.get if state.exists else ([], 0)
    seen = list(seen)
    if not state.hasTimedOut:
        for b in batches:
            seen += b["page_number"].tolist()
            of = max(of, int(b["page_count"].max()))
    done = len(set(seen)) >= of > 0
    if done or state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"doc_id": [key[0]], "pages_seen": [len(set(seen))], "page_count": [of], "complete": [done]})
    else:
        state.update((sorted(set(seen)), of))
        state.setTimeoutDuration(3_600_000)


def completed(pages: DataFrame) -> DataFrame:
    """One row for each document once all its pages have come, or an hour has passed without the rest."""
    return pages.select("doc_id", "page_number", "page_count").groupBy("doc_id").applyInPandasWithState(
        _complete, "doc_id long, pages_seen int, page_count int, complete boolean", "seen array<int>, page_count int", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def route_batches(pages: DataFrame, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lane_plan):
    """Write each micro-batch's plan to its own folder of the table, batch=number: a batch that is played again ends in the
    same files. Files must hold whole documents."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return pages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
