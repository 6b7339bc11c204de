"""From raw documents to packed sequences: STAGES in order, each over what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import neardup, packing, quality, secrets, substring
from quiremill.llm.common import Scratch
from quiremill.llm.queries import vocabulary


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars after texts have changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.7 go; the rest stays with all columns.

    A null or empty text scores the share of label 1, as every text does without labels of both classes. Repeated rows
    are decided alike, each for itself. An empty table stays empty; without a labelled row all scores are 0.5, so all go.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8: of each group the document with the smallest id stays, with all its rows.

    Null and empty texts and null ids link with nothing and stay. Repeated rows of an id that stays all stay.
    """
    return neardup.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that start earlier too go from the texts; no document goes.

    Earlier is the smaller (id, start); null ids come last. Rows with one id and text lose the same words. Null, empty
    and shorter texts stay as they are; a text that loses words keeps the others joined by one space.
    """
    return _resized(substring.without_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret becomes its kind in brackets; no document goes. Spans come from a ledger of distinct texts.

    Null texts stay null, copies change alike, overlapping spans become one under the first one's kind.
    """
    return _resized(secrets.redact(docs))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens. A null or empty text is its end id alone; repeated rows and null ids are
    packed each; an empty table gives no piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_neardup", minhash_neardup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("curve_packing", curve_packing),
]

#: Classifier, MinHash, repeats and tokenizer are beyond SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is written and read again, which cuts the lineage."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"{i}-{name}")
            if i:
                scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
