"""The template library: a table of versions with register, update, get, list and delete, and drafts from blank forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forms import fingerprint, inherit_labels, one_element_each, widget_labels

SCHEMA = "template_id string, version long, name string, fingerprint string, elements string, deleted boolean"


class Library:
    """Versions are only ever added, as Parquet; the newest of an id holds, and a deletion is a version too."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _add(self, id: str, name: str | None, print_: str | None, elements: str | None, deleted: bool) -> int:
        version = (self._all().where(F.col("template_id") == id).agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(id, version, name, print_, elements, deleted)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return version

    def _all(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], SCHEMA)

    def templates(self) -> DataFrame:
        """The newest version of every template that is not deleted."""
        newest = self._all().groupBy("template_id").agg(F.max_by(F.struct("version", "name", "fingerprint", "elements", "deleted"), "version").alias("t"))
        return newest.select("template_id", "t.*").where(~F.col("deleted")).drop("deleted")

    def register(self, id: str, name: str, elements: str, print_: str | None = None) -> int:
        """A new template, its elements as JSON. An id that is taken is an error."""
        if self.get(id) is not None:
            raise ValueError(f"template {id} exists")
        return self._add(id, name, print_, elements, False)

    def update(self, id: str, name: str, elements: str, print_: str | None = None) -> int:
        if self.get(id) is None:
            raise KeyError(id)
        return self._add(id, name, print_, elements, False)

    def delete(self, id: str) -> bool:
        if self.get(id) is None:
            return False
        self._add(id, None, None, None, True)
        return True

    def get(self, id: str):
        return self.templates().where(F.col("template_id") == id).first()


def draft(widgets: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, fingerprints) of blank forms: a labelled element for each widget, one for each place, blanks inherited.

    widgets: template_id with page fractions; doc_id and page_number tell its pages apart.
    """
    w = widgets.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    labelled = widget_labels(w, lines)
    e = labelled.select("template_id", F.col("widget_idx").alias("element_idx"), "kind", F.col("page_number").alias("page"), "label", "x1", "y1", "x2", "y2")
    return inherit_labels(one_element_each(e)), fingerprint(e)


def verified_assets(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Which cached model files are what the catalogue says: name, found, intact (by SHA-256 and size).

    files: name, content; catalog: name, sha256, bytes.
    """
    f = files.select("name", F.sha2("content", 256).alias("got"), F.length("content").alias("size"))
    return catalog.join(f, "name", "left").select("name", F.col("got").isNotNull().alias("found"), F.coalesce((F.lower("sha256") == F.col("got")) & (F.col("bytes") == F.col("size")), F.lit(False)).alias("intact"))


