"""Hardware specifications: tables, bullets and key-value lines to components, a merged profile and its section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hardware as H
from ..functions.text import collapse, lines_of

HEADERS = {
    "description": H.any_of(["component", "description", "item", "nomenclature", "services", "specification", "supplies"]),
    "quantity": H.any_of(["qty", "quantity"]),
    "part": H.any_of(["manufacturer", "model", "nsn", "p/?n", "part (?:#|no|number)?"]),
    "unit": H.any_of(["ea", "u/?i", "unit", "unit of issue", "uom"]),
}
PHRASE = {"Processor": "processor", "Memory": "memory", "Storage": "storage", "Graphics": "graphics", "Display": "display", "Network": "network", "PowerSupply": "power supply", "FormFactor": "form factor", "Motherboard": "motherboard", "OperatingSystem": "operating system", "Warranty": "warranty", "Quantity": "quantity", "PartNumber": "part number"}
SHEET = "System (spec sheet)"
COMPONENT = ["doc_id", "strategy", "seq", "description", "quantity", "part_number", "unit_of_issue", "attributes"]


def composed_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, line_no, text of each page's Markdown."""
    return pages.select("doc_id", "page_number", F.posexplode(lines_of(F.col("markdown"))).alias("line_no", "text"))


def _bullet_texts(lines: DataFrame) -> DataFrame:
    body = F.regexp_extract("text", H.BULLET, 1)
    b = lines.where((body != "") & ~F.col("text").rlike(H.KEY_VALUE)).withColumn("t", collapse(body))
    return b.select("doc_id", F.lit(2).alias("strategy"), _at().alias("seq"), *_place("page_number", "line_no"), F.col("t").alias("text"), F.col("t").alias("description"), *_no_scalars(), *_no_label())


def _keyed_texts(lines: DataFrame) -> DataFrame:
    label, value = F.trim(F.regexp_extract("text", H.KEY_VALUE, 1)), F.trim(F.regexp_extract("text", H.KEY_VALUE, 2))
    k = lines.withColumn("label", label).withColumn("value", value).withColumn("category", H.label_category(F.col("label"))).where("label <> '' and category is not null")
    return k.select("doc_id", F.lit(3).alias("strategy"), _at().alias("seq"), *_place("page_number", "line_no"), F.col("value").alias("text"), F.lit(SHEET).alias("description"), *_no_scalars(), "label", "category")


def _at() -> Column:
    """A line's place in its document."""
    return (F.col("page_number") * 1_000_000 + F.col("line_no")).cast("long")


def _place(page: str, line: str) -> tuple[Column, ...]:
    """Both parts of a place by themselves: seq joins them, and a line number of a million or more reaches the next page's."""
    return (F.col(page).cast("long").alias("part"), F.col(line).cast("long").alias("line"))


def _no_scalars() -> tuple[Column, ...]:
    return (F.lit(None).cast("int").alias("quantity"), F.lit(None).cast("string").alias("part_number"), F.lit(None).cast("string").alias("unit_of_issue"))


def _no_label() -> tuple[Column, ...]:
    return (F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("category"))


def _labelled(found: Column) -> Column:
    """The attribute of a labelled value: the recogniser's own for that category, else the plain value."""
    own = F.get(F.filter(found, lambda a: a["category"] == F.col("category")), F.lit(0))
    plain = F.struct(F.col("category"), F.concat("label", F.lit(": "), "text").alias("raw"), F.col("text").alias("value"), F.lit(None).cast("string").alias("unit"))
    return F.coalesce(own, plain)


def bullets(lines: DataFrame) -> DataFrame:
    """Components of bullet lines that are no key-value lines and name hardware."""
    return _bullet_texts(lines).withColumn("attributes", H.attributes(F.col("text"))).where(F.size("attributes") > 0).select(*COMPONENT)


def key_values(lines: DataFrame) -> DataFrame:
    """One attribute for each line with a known label: the recogniser's own for that category, else the plain value."""
    k = _keyed_texts(lines).withColumn("found", H.attributes(F.col("text")))
    return k.select("doc_id", F.col("part").cast("int").alias("page_number"), F.col("line").cast("int").alias("line_no"), "category", _labelled(F.col("found")).alias("attribute"))


def spec_sheets(keyed: DataFrame, least: int = 2) -> DataFrame:
    """One component for each document with two labelled fields or more."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line_no", "attribute"))), lambda x: x["attribute"])
    s = keyed.groupBy("doc_id").agg(ordered.alias("attributes")).where(F.size("attributes") >= least)
    return s.select("doc_id", F.lit(3).alias("strategy"), F.lit(0).cast("long").alias("seq"), F.lit(SHEET).alias("description"), F.lit(None).cast("int").alias("quantity"), F.lit(None).cast("string").alias("part_number"), F.lit(None).cast("string").alias("unit_of_issue"), "attributes")


def _table_texts(cells: DataFrame) -> DataFrame:
    """What describes each table row below the header, by one window over the table's cells."""
    table = Window.partitionBy("doc_id", "table_id")
    c = cells.select("doc_id", "table_id", "row", "col", F.coalesce("text", F.lit("")).alias("text"))
    some = F.col("text").rlike("|".join(HEADERS.values()))
    header = F.min(F.when((F.col("row") < 4) & some, F.col("row"))).over(table)
    c = c.withColumn("n_rows", F.max("row").over(table) + 1).withColumn("header", header).where("n_rows >= 2")
    fits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in HEADERS.items()]))
    heads = F.array_sort(F.collect_list(F.when(F.col("row") == F.col("header"), F.struct("col", fits.alias("fits")))).over(table))
    c = c.withColumn("heads", heads).where(F.col("row") > F.coalesce("header", F.lit(-1)))

    # left to right, a cell takes the first free kind it fits
    def take(acc: Column, x: Column) -> Column:
        free = F.filter(x["fits"], lambda k: ~F.array_contains(F.map_keys(acc), k))
        return F.when(F.size(free) > 0, F.map_concat(acc, F.map_from_arrays(F.array(F.get(free, F.lit(0))), F.array(x["col"].cast("int"))))).otherwise(acc)

    r = c.groupBy("doc_id", "table_id", "row").agg(F.first("heads").alias("heads"), F.collect_list(F.struct("col", F.trim("text").alias("text"), F.length("text").alias("n"))).alias("cs"))
    r = r.withColumn("m", F.aggregate("heads", F.from_json(F.lit("{}"), "map<string,int>"), take))
    at = lambda k: F.try_element_at("m", F.lit(k))
    text = lambda k: F.array_max(F.transform(F.filter("cs", lambda x: x["col"] == at(k)), lambda x: x["text"]))
    longest = F.array_max(F.transform("cs", lambda x: F.struct(x["n"].alias("n"), (-x["col"]).alias("c"), x["text"].alias("text"))))["text"]
    r = r.withColumn("d", F.when(at("description").isNull(), longest).otherwise(F.coalesce(text("description"), F.lit("")))).where("d <> ''")
    some_of = lambda k: F.nullif(text(k), F.lit(""))
    seq = (F.col("table_id") * 1_000_000 + F.col("row")).cast("long")
    return r.select("doc_id", F.lit(1).alias("strategy"), seq.alias("seq"), *_place("table_id", "row"), F.col("d").alias("text"), collapse(F.col("d")).alias("description"), H.quantity(text("quantity")).alias("quantity"), some_of("part").alias("part_number"), some_of("unit").alias("unit_of_issue"), *_no_label())


def table_rows(cells: DataFrame) -> DataFrame:
    """Components of table rows below the header that name hardware.

    cells: doc_id, table_id, row, col, text. The header is the first of rows 0 to 3 with a known heading; the first
    cell of each kind wins, a cell counting for the first kind it fits. Without a description column the longest cell
    of the row describes it.
    """
    return _table_texts(cells).withColumn("attributes", H.attributes(F.col("text"))).where(F.size("attributes") > 0).select(*COMPONENT)


def components(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Components of tables, bullets and spec sheets, not merged yet: the union of the three strategies.

    The recogniser's expression is large, so it stands once, over the texts of all three. They are spread by document
    before, which keeps it from being copied into each of them and is what all later groupings need.
    """
    texts = _table_texts(cells).unionByName(_bullet_texts(lines)).unionByName(_keyed_texts(lines)).repartition("doc_id")
    sheet = F.col("strategy") == 3
    found = texts.withColumn("found", H.attributes(F.col("text")))
    found = found.withColumn("attributes", F.when(sheet, F.array(_labelled(F.col("found")))).otherwise(F.col("found")))
    none = F.lit(0).cast("long")
    place = [F.when(sheet, none).otherwise(F.col(c)).alias(c) for c in ("seq", "part", "line")]
    one = found.groupBy("doc_id", "strategy", *place).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("part").alias("p"), F.col("line").alias("l"), "attributes"))), lambda x: x["attributes"])).alias("attributes"),
        *[F.max(c).alias(c) for c in ("description", "quantity", "part_number", "unit_of_issue")],
    )
    return one.where(F.size("attributes") >= F.when(sheet, 2).otherwise(1)).select(*COMPONENT)


def merge_components(components: DataFrame) -> DataFrame:
    """Components of one normalised description become one: longest text, first scalars, attributes united.

    Components fold in order of strategy, then place. Attributes unite on (category, value) only where both sides have
    some; duplicates within one side stay, as does a side that stands alone.
    """
    norm = F.lower(collapse(F.col("description")))
    c = components.withColumn("norm", norm).groupBy("doc_id", "norm").agg(F.array_sort(F.collect_list(F.struct("strategy", "seq", "description", "quantity", "part_number", "unit_of_issue", "attributes"))).alias("all"))
    same = lambda a, b: (a["category"] == b["category"]) & a["value"].eqNullSafe(b["value"])

    def unite(acc, x):
        new = F.aggregate(x, acc, lambda l, a: F.when(F.exists(l, lambda o: same(o, a)), l).otherwise(F.concat(l, F.array(a))))
        return F.when(F.size(acc) == 0, x).when(F.size(x) == 0, acc).otherwise(new)

    first = F.get("all", F.lit(0))
    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))
    longest = F.aggregate(rest, first["description"], lambda l, x: F.when(F.length(x["description"]) > F.length(l), x["description"]).otherwise(l))
    scalar = lambda n: F.get(F.filter(F.transform("all", lambda x: x[n]), lambda v: v.isNotNull()), F.lit(0))
    return c.select("doc_id", first["strategy"].alias("strategy"), first["seq"].alias("seq"), longest.alias("description"), *[scalar(n).alias(n) for n in ("quantity", "part_number", "unit_of_issue")], F.aggregate(F.transform(rest, lambda x: x["attributes"]), first["attributes"], unite).alias("attributes"))


def roll_up(components: DataFrame) -> DataFrame:
    """One attribute for each document and category: with a value first, then the longest text, then the earliest."""
    a = components.select("doc_id", "strategy", "seq", F.posexplode("attributes").alias("pos", "a"))
    best = F.struct(F.col("a.value").isNotNull(), F.length("a.raw"), -F.col("strategy"), -F.col("seq"), -F.col("pos"))
    r = a.groupBy("doc_id", F.col("a.category").alias("category")).agg(F.max_by(F.col("a"), best).alias("a"))
    return r.select("doc_id", "category", F.col("a.raw").alias("raw"), F.col("a.value").alias("value"), F.col("a.unit").alias("unit"), H.category_order(F.col("category")).alias("ord"))


def system_kind(components: DataFrame) -> DataFrame:
    """The kind whose vocabulary occurs most, in descriptions and attribute texts; Unknown on a tie or none."""
    texts = F.concat(F.array("description"), F.transform("attributes", lambda a: a["raw"]))
    t = components.select("doc_id", F.explode(texts).alias("t"))
    n = [F.sum(F.regexp_count("t", F.lit(p))).alias(k) for k, p in H.SYSTEMS.items()]
    return t.groupBy("doc_id").agg(*n).select("doc_id", _winner().alias("kind"))


def _documents(components: DataFrame) -> DataFrame:
    """One row a document: cs, its components in order, and what is counted on them."""
    c = components.groupBy("doc_id").agg(F.count("*").alias("n_components"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_quantity"), F.array_sort(F.collect_list(F.struct("strategy", "seq", "description", "quantity", "part_number", "attributes"))).alias("cs"))
    texts = F.flatten(F.transform("cs", lambda x: F.concat(F.array(x["description"]), F.transform(x["attributes"], lambda a: a["raw"]))))
    c = c.withColumn("texts", texts).withColumn("n_categories", F.size(F.array_distinct(F.flatten(F.transform("cs", lambda x: F.transform(x["attributes"], lambda a: a["category"]))))))
    c = c.select("*", *[_votes(k, p) for k, p in H.SYSTEMS.items()])
    return c.withColumn("kind", _winner()).drop("texts", *H.SYSTEMS)


def profile(components: DataFrame) -> DataFrame:
    """doc_id, kind, n_components, n_categories, total_quantity, confidence. components: merged.

    One grouping; a document's components are one array, on which the votes and counts are taken.
    """
    score = F.least(F.lit(0.95), 0.4 + 0.08 * F.col("n_categories") + 0.03 * F.least(F.col("n_components"), F.lit(6)))
    return _documents(components).select("doc_id", "n_components", "total_quantity", "n_categories", "kind", F.bround(score, 2).alias("confidence"))


def _votes(kind: str, pattern: str) -> Column:
    return F.aggregate("texts", F.lit(0), lambda n, t: n + F.regexp_count(t, F.lit(pattern))).alias(kind)


def _winner() -> Column:
    """The kind with most votes of its own; Unknown on a tie or without votes."""
    best = F.greatest(*H.SYSTEMS)
    ties = sum((F.when(F.col(k) == best, 1).otherwise(0) for k in H.SYSTEMS), F.lit(0))
    kind = F.when((best == 0) | (ties != 1), "Unknown")
    for k in H.SYSTEMS:
        kind = kind.when(F.col(k) == best, k)
    return kind


def section(components: DataFrame) -> DataFrame:
    """doc_id, markdown: a paragraph on the system and a bullet for each component; texts cut at 160. components: merged."""
    cut = lambda s: F.when(F.length(F.trim(s)) <= 160, F.trim(s)).otherwise(F.concat(F.rtrim(F.substring(F.trim(s), 1, 160)), F.lit("…")))
    names = F.create_map(*[F.lit(x) for kv in PHRASE.items() for x in kv])

    def ranked(x: Column, a: Column, i: Column) -> Column:
        """As roll_up() prefers them: with a value, the longest, the earliest."""
        best = F.struct(a["value"].isNotNull().alias("v"), F.length(a["raw"]).alias("n"), (-x["strategy"]).alias("st"), (-x["seq"]).alias("se"), (-i).alias("i"))
        return F.struct(best.alias("best"), a["category"].alias("category"), a["raw"].alias("raw"), a["value"].alias("value"), a["unit"].alias("unit"))

    def phrase(a: Column) -> Column:
        detail = F.coalesce(a["value"], cut(a["raw"]))
        unit = F.when(a["unit"].isNotNull() & ~F.lower(detail).contains(F.lower(a["unit"])), F.concat(F.lit(" "), a["unit"])).otherwise("")
        return F.concat(F.coalesce(F.try_element_at(names, a["category"]), F.lit("other")), F.lit(": "), detail, unit)

    def line(x: Column) -> Column:
        many = F.when(x["quantity"].isNotNull(), F.concat(F.lit("**Qty "), x["quantity"].cast("string"), F.lit("** — "))).otherwise("")
        part = F.when(x["part_number"].isNotNull(), F.concat(F.lit(" · *part "), F.trim(x["part_number"]), F.lit("*"))).otherwise("")
        return F.concat(F.lit("- "), many, cut(x["description"]), part)

    p = _documents(components)
    every = F.flatten(F.transform("cs", lambda x: F.transform(x["attributes"], lambda a, i: ranked(x, a, i))))
    p = p.withColumn("every", every)
    chosen = F.transform(F.array(*[F.lit(c) for c in H.CATEGORIES]), lambda k: F.array_max(F.filter("every", lambda a: a["category"] == k)))
    specs = F.array_join(F.transform(F.array_compact(chosen), phrase), "; ")
    rows = F.array_join(F.transform("cs", line), "\n")
    kind = F.when(F.col("kind") == "Unknown", "hardware").otherwise(F.concat(F.lit("a "), F.lower("kind")))
    total = F.when(F.col("total_quantity") > 0, F.concat(F.lit(" (total quantity "), F.col("total_quantity").cast("string"), F.lit(")"))).otherwise("")
    para = F.concat(F.lit("This document specifies "), kind, total, F.lit("."), F.when(F.col("n_categories") > 0, F.concat(F.lit(" Key specifications: "), specs, F.lit("."))).otherwise(""))
    return p.select("doc_id", F.concat(F.lit("## Hardware specifications\n\n"), para, F.lit("\n\n"), rows, F.lit("\n")).alias("markdown"))


def append_section(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Document Markdown with its section, where it has components."""
    s = sections.select("doc_id", F.col("markdown").alias("section"))
    return documents.join(s, "doc_id", "left").select("doc_id", F.concat("markdown", F.when(F.col("section").isNotNull(), F.concat(F.lit("\n\n"), "section")).otherwise("")).alias("markdown"))
