"""Scans and sinks: documents as bytes, word geometry from text, templates, truth sheets, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import not_blank, words

PAGE = ["doc_id", "page_number"]
TOKENS_PER_ROW, ROWS_PER_PAGE, CHAR, ROW, LINE = 10, 40, 10, 30, 20
PAGE_HEIGHT = 1200


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores: for small inputs whose rows grow many-fold.

    A large table has more splits than that already and is left alone.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= n else df.repartition(n)


def document_bytes(spark: SparkSession, path: str, glob: str = "*.pdf", stream: bool = False) -> DataFrame:
    """path, modificationTime, length, content of every matching file; stream: as they arrive."""
    reader = spark.readStream if stream else spark.read
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.format("binaryFile").option("pathGlobFilter", glob).load(path)


def page_numbers(docs: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """doc_id, page_number for 1..page_count, or for those of the wanted pages that exist."""
    every = docs.select("doc_id", F.explode(F.sequence(F.lit(1), F.greatest("page_count", F.lit(1)))).alias("page_number"), "page_count").where("page_number <= page_count").drop("page_count")
    return every if pages is None else every.where(F.col("page_number").isin(sorted(set(pages))))


def token_boxes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words with boxes on a fixed grid: ten words a row, forty rows a page, a gutter in every third document.

    Row by row: no window. Boxes are whole numbers.
    """
    rows = spread(docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t"))).select("doc_id", words(F.col("t")).alias("w")).where(F.size("w") > 0)
    count = F.ceil(F.size("w") / TOKENS_PER_ROW).cast("int")
    rows = rows.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda r: F.slice("w", r * TOKENS_PER_ROW + 1, TOKENS_PER_ROW))).alias("row", "w"))
    rows = rows.select("doc_id", "row", "w", F.posexplode("w").alias("i", "text"))
    # characters before a word, one for each space: no lambda, so it stays in generated code
    before = F.length(F.array_join(F.slice("w", 1, F.col("i")), " ")) + F.when(F.col("i") > 0, 1).otherwise(0)
    gutter = F.when((F.col("doc_id") % 3 == 0) & (F.col("i") >= 5), 200).otherwise(0)
    x1 = (before * CHAR + gutter).cast("double")
    y1 = (F.col("row") % ROWS_PER_PAGE * ROW).cast("double")
    return rows.select(
        "doc_id",
        (F.floor(F.col("row") / ROWS_PER_PAGE) + 1).cast("int").alias("page_number"),
        (F.col("row") * TOKENS_PER_ROW + F.col("i")).cast("int").alias("token_idx"),
        "text",
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + F.length("text") * CHAR).alias("x2"),
        (y1 + LINE).alias("y2"),
    )


def degraded(tokens: DataFrame) -> DataFrame:
    """The tokens a poor reading would give: every seventeenth or so is missing, the rest has a confidence."""
    t = tokens.where((F.col("doc_id") * 31 + F.col("token_idx")) % 17 != 0)
    return t.withColumn("confidence", ((F.col("token_idx") * 7) % 100) / F.lit(100.0))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """template_id, name, fingerprint, element_idx, kind, page, label, grp and box fractions from template JSON files."""
    schema = "TemplateId string, Name string, Fingerprint string, Elements array<struct<Kind: string, Page: int, Label: string, `Group`: string, Rect: struct<X1: double, Y1: double, X2: double, Y2: double>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    e = F.col("e")
    return raw.select("TemplateId", "Name", "Fingerprint", F.posexplode("Elements").alias("element_idx", "e")).select(
        F.col("TemplateId").alias("template_id"), F.col("Name").alias("name"), F.col("Fingerprint").alias("fingerprint"), "element_idx",
        e["Kind"].alias("kind"), e["Page"].alias("page"), e["Label"].alias("label"), e["Group"].alias("grp"), *[e["Rect"][c.upper()].alias(c) for c in ("x1", "y1", "x2", "y2")],
    )


def truth_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV truth sheet with quoted fields, all columns trimmed strings."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return df.select([F.trim(c).alias(c.strip()) for c in df.columns])


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that the table does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def page_json(pages: DataFrame, indent: bool = False) -> DataFrame:
    """doc_id and one JSON array of its pages, in page order: camel case, nulls left out."""
    body = F.struct(*[F.col(c).alias(camel(c)) for c in pages.columns if c != "doc_id"])
    ordered = F.array_sort(F.collect_list(F.struct("page_number", body.alias("p"))))
    options = {"pretty": "true"} if indent else {}
    return pages.groupBy("doc_id").agg(F.to_json(F.transform(ordered, lambda x: x["p"]), options).alias("json"))


def in_order(value: Column, *order: Column, separator: str) -> Column:
    """Aggregate: values joined by order; a null value is left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v"))))), lambda x: x["v"]), separator)


def document_markdown(pages: DataFrame) -> DataFrame:
    """doc_id, markdown: a comment and the body of each page, a rule between pages."""
    body = F.concat(F.when(F.col("first"), "").otherwise("---\n\n"), F.lit("<!-- page "), F.col("page_number").cast("string"), F.lit(" -->\n\n"), F.coalesce("markdown", F.lit("")))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number")) == 1
    return pages.withColumn("first", first).groupBy("doc_id").agg(in_order(body, F.col("page_number"), separator="\n").alias("markdown"))


def merged_markdown(pages: DataFrame) -> DataFrame:
    """doc_id, markdown: bodies that are not blank, a blank line between them, no page comments."""
    body = F.when(not_blank(F.col("markdown")), F.col("markdown"))
    return pages.groupBy("doc_id").agg(in_order(body, F.col("page_number"), separator="\n\n").alias("markdown"))


def write_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
