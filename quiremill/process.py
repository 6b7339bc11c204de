"""Whole documents from what is known of their pages: characters, structure, checks and notices, in one plan.

A Corpus holds the tables; only pages is a must. Every step is an operator of its own, joined by page, so that Catalyst
sees one plan from the scans to the result and nothing is collected. Routed processing answers pages by structure where
that is enough and sends the rest through the same steps.
"""

from __future__ import annotations

import atexit
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import form_designation, words
from .operators import compose, forms, layer, order, routing, signals, specs, verify
from .sources import tables
from .sources.tables import PAGE

BOX = ["x1", "y1", "x2", "y2"]
LINE = [*PAGE, "line_idx", "text", *BOX, "confidence", "source"]
#: Lines from other sources are counted from these on, so that line_idx stays unique on a page.
IMAGE_LINES, WIDGET_LINES = 1_000_000, 2_000_000
MOST_DPI = 600
SHARES = ("cells", "fields", "images", "readings", "regions", "runs", "signals", "signatures", "widgets", "words")


@dataclass(frozen=True)
class Options:
    """Every option that changes a result, with its default."""

    dpi: int = 300
    min_scan_dpi: int = 150
    upscale: bool = False
    upscale_factor: float = 2.0
    retry_low_resolution: bool = True
    retry_min_words: int = 3
    retry_min_confidence: float = 0.5
    recover_image_text: bool = True
    min_image_coverage: float = 0.1
    detect_markings: bool = True
    text_layer: str = "Auto"
    min_layer_words: int = 5
    max_dropped: float = 0.3
    max_undecodable: float = 0.2
    verify: bool = True
    enumerator_order: bool = False
    form_fields: bool = False
    template_routing: bool = True
    hardware_specs: bool = False
    pages: tuple[int, ...] | None = None
    preprocess_scans: bool = True
    detect_orientation: bool = True
    fast_lane: bool = False
    escalation_share: float = 0.8
    min_fast_confidence: float = 0.6
    ruling_threshold: int = 0
    min_fast_words: int = 5
    min_trust_runs: int = 10
    min_decode_trust: float = 0.5
    template_match: float = 0.85
    block_marked: bool = False


@dataclass(frozen=True)
class Corpus:
    """Tables of pages; all are keyed by doc_id and page_number, and boxes are pixels with y down.

    pages: width_px, height_px. words (the text layer): token_idx, text, box. readings (recognised lines): rotation,
    attempt_no (0 first, 1 enlarged, 2 rendered anew), prepared, line_idx, text, confidence, box. regions: region_idx,
    type, raw_label, confidence, box. cells: region_idx, row, col, box. images: as signals.effective_dpi() takes them.
    widgets: widget_idx, field_type, value, parent_value, as_state, hidden, box. profiles: profile, spec_idx, name, label,
    kind, anchor; profile_order: profile, profile_idx. signatures: token of each page's widgets; template_tokens and
    elements (box fractions, grp): the templates. signals and documents: an outside engine's page classes, as
    routing.classify() takes them, signals with trust; runs and fields: that engine's text runs and form fields.
    """

    pages: DataFrame
    words: DataFrame | None = None
    readings: DataFrame | None = None
    regions: DataFrame | None = None
    cells: DataFrame | None = None
    images: DataFrame | None = None
    widgets: DataFrame | None = None
    profiles: DataFrame | None = None
    profile_order: DataFrame | None = None
    signatures: DataFrame | None = None
    template_tokens: DataFrame | None = None
    elements: DataFrame | None = None
    documents: DataFrame | None = None
    signals: DataFrame | None = None
    runs: DataFrame | None = None
    fields: DataFrame | None = None

    def only(self, wanted: DataFrame) -> Corpus:
        """The same of some pages alone."""
        cut = {n: getattr(self, n).join(wanted, PAGE, "left_semi") for n in ("pages", *SHARES) if getattr(self, n) is not None}
        return replace(self, **cut)


@dataclass(frozen=True)
class Result:
    """pages: a row a page; lines: what they are made of; documents: Markdown; fields: form fields; plan: lanes, if routed."""

    pages: DataFrame
    lines: DataFrame
    documents: DataFrame
    fields: DataFrame
    plan: DataFrame | None = field(default=None)


FIELDS = "doc_id long, page_number int, field_idx int, name string, kind string, value string, confidence double, origin string"


def _wanted(c: Corpus, o: Options) -> Corpus:
    """The page subset comes first, so that no later step sees another page."""
    if o.pages is None:
        return c
    keep = F.col("page_number").isin(sorted(set(o.pages)))
    return replace(c, **{n: getattr(c, n).where(keep) for n in ("pages", *SHARES) if getattr(c, n) is not None})


def _known(c: Corpus, o: Options) -> DataFrame:
    """One row a page: where its characters come from and what its scan is like."""
    p = c.pages.select(*PAGE, "width_px", "height_px")
    none = {"word_count": F.lit(None).cast("long"), "dropped_fraction": F.lit(None).cast("double"), "undecodable_fraction": F.lit(None).cast("double")}
    p = p.join(layer.layer_quality(c.words), PAGE, "left") if c.words is not None else p.withColumns(none)
    from_layer = layer.uses_layer(F.lit(o.text_layer), F.col("word_count"), F.col("dropped_fraction"), F.col("undecodable_fraction"), o.min_layer_words, o.max_dropped, o.max_undecodable)
    p = p.withColumn("from_layer", from_layer)
    if c.images is not None:
        p = p.join(signals.scan_images(c.images), PAGE, "left")
    else:
        p = p.withColumn("dpi", F.lit(None).cast("int")).withColumn("coverage", F.lit(None).cast("double"))
    p = p.withColumn("dpi", F.when(~F.col("from_layer"), F.col("dpi")))
    p = p.withColumn("low_resolution", signals.low_resolution(F.col("from_layer"), F.col("dpi"), o.min_scan_dpi))
    return p.withColumn("image_suspected", F.col("from_layer") & F.lit(o.recover_image_text) & (F.coalesce("coverage", F.lit(0.0)) >= o.min_image_coverage))


def _readings(c: Corpus, o: Options) -> DataFrame | None:
    """Recognised lines with all their keys; of pages read both prepared and plain, the ones asked for."""
    r = c.readings
    if r is None:
        return None
    for name, value in (("rotation", F.lit(0)), ("attempt_no", F.lit(0)), ("prepared", F.lit(True))):
        r = r if name in r.columns else r.withColumn(name, value)
    right = F.col("prepared") == F.lit(o.preprocess_scans)
    some = F.max(right).over(Window.partitionBy(*PAGE))
    return r.withColumn("right", right).withColumn("some", some).where("right or not some").drop("right", "some")


def _scanned(r: DataFrame, known: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(lines of the attempt kept, attempt figures) of pages whose characters come from pixels."""
    scans = known.where(~F.col("from_layer")).select(*PAGE, "low_resolution")
    r = r.join(scans, PAGE)
    if o.detect_orientation:
        turn = signals.orientation(r.where("attempt_no = 0")).select(*PAGE, F.col("rotation").alias("turn"))
        r = r.join(turn, PAGE, "left").where(F.col("rotation") == F.coalesce("turn", F.lit(0)))
    else:
        r = r.where("rotation = 0")
    if o.upscale and o.upscale_factor > 1:  # low resolution is enlarged from the start
        enlarged = F.max(F.col("low_resolution") & (F.col("attempt_no") == 1)).over(Window.partitionBy(*PAGE))
        r = r.withColumn("enlarged", enlarged).where("not enlarged or attempt_no <> 0")
        r = r.withColumn("attempt_no", F.when(F.col("enlarged") & (F.col("attempt_no") == 1), 0).otherwise(F.col("attempt_no"))).drop("enlarged")
    again = min(2 * o.dpi, MOST_DPI)
    tries = [0, *([1] if o.upscale_factor > 1 else []), *([2] if again > o.dpi else [])] if o.retry_low_resolution else [0]
    r = r.where(F.col("attempt_no").isin(tries))
    read = layer.confident_words(r, o.retry_min_confidence, [*PAGE, "attempt_no"])
    every = scans.select(*PAGE, F.lit(0).alias("attempt_no"), F.lit(0).cast("long").alias("words")).unionByName(read.select(*PAGE, "attempt_no", F.col("words").cast("long").alias("words")))
    every = every.groupBy(*PAGE, "attempt_no").agg(F.max("words").alias("words")).join(scans, PAGE)
    kept = signals.keep_better(every, o.retry_min_words)
    via = F.when(F.col("attempt_no") == 1, F.lit(f"enlarging {o.upscale_factor:g} times")).when(F.col("attempt_no") == 2, F.lit(f"rendering at {again} DPI"))
    kept = kept.select(*PAGE, "attempt_no", "retried", via.alias("recovered_via"), F.when(F.col("attempt_no") == 2, again).otherwise(o.dpi).alias("render_dpi"))
    lines = r.join(kept.select(*PAGE, "attempt_no"), [*PAGE, "attempt_no"])
    rotated = lines.groupBy(*PAGE).agg(F.max("rotation").alias("orientation"))
    return lines.withColumn("source", F.lit("Ocr")).select(*LINE), kept.drop("attempt_no").join(rotated, PAGE, "left")


def _characters(c: Corpus, known: DataFrame, o: Options) -> tuple[DataFrame, DataFrame]:
    """(lines, known with what reading them took)."""
    runs = None
    if c.words is not None:
        runs = layer.text_runs(c.words, wanted=known.where("from_layer").select(*PAGE)).where("wanted or is_placeholder")
        runs = _cut(runs.withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("TextLayer")).select(*LINE, "wanted", "is_placeholder"))
        if o.text_layer != "Never":
            known = known.join(runs.where("is_placeholder").select(*PAGE, F.lit(True).alias("is_xfa")).distinct(), PAGE, "left")
    known = known if "is_xfa" in known.columns else known.withColumn("is_xfa", F.lit(None).cast("boolean"))
    known = known.withColumn("is_xfa", F.coalesce("is_xfa", F.lit(False)))
    parts: list[DataFrame] = []
    r = _readings(c, o)
    own = None
    if runs is not None:
        runs = runs.where("wanted")
        own = (runs if o.text_layer == "Never" else runs.where("not is_placeholder")).select(*LINE)
    if runs is not None and r is not None and o.recover_image_text:
        # text that stands in images of a page whose own text is trusted
        seen = r.where("rotation = 0 and attempt_no = 0").join(known.where("image_suspected and not is_xfa").select(*PAGE), PAGE, "left_semi")
        new = layer.merge_recognised(runs, seen).where("source = 'Ocr'").withColumn("line_idx", (F.col("line_idx") + IMAGE_LINES).cast("int"))
        new = new.withColumn("confidence", F.lit(1.0)).select(*LINE)
        parts.append(new)
        known = known.join(new.groupBy(*PAGE).agg(F.count("*").alias("lines_recovered")), PAGE, "left")
    if c.widgets is not None:
        w = layer.widget_lines(c.widgets).join(known.where("from_layer").select(*PAGE), PAGE, "left_semi")
        parts.append(w.select(*PAGE, (F.col("widget_idx") + WIDGET_LINES).cast("int").alias("line_idx"), "text", *BOX, F.lit(1.0).alias("confidence"), F.lit("TextLayer").alias("source")))
    if r is not None:
        lines, figures = _scanned(r, known, o)
        parts.append(lines)
        known = known.join(figures, PAGE, "left")
    for name, value in (("lines_recovered", F.lit(0).cast("long")), ("retried", F.lit(False)), ("render_dpi", F.lit(o.dpi)), ("orientation", F.lit(0))):
        known = known.withColumn(name, F.coalesce(name, value) if name in known.columns else value)
    known = known if "recovered_via" in known.columns else known.withColumn("recovered_via", F.lit(None).cast("string"))
    if not parts:
        if own is not None:
            return own, known
        empty = c.pages.sparkSession.createDataFrame([], "doc_id long, page_number int, line_idx int, text string, x1 double, y1 double, x2 double, y2 double, confidence double, source string")
        return empty, known
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.join(known.where("not is_xfa").select(*PAGE), PAGE, "left_semi")
    return _cut(every if own is None else own.unionByName(every)), known


def _grids(c: Corpus, claimed: DataFrame, lines: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(Markdown, filled cells) of table regions that fit their grid; tables of standard forms have collapsed rows split."""
    if c.cells is None:
        return None, None
    inside = claimed.where("region_type = 'Table'")
    cells = c.cells.select(*compose.TABLE, "row", "col", *BOX)
    good = compose.grid_fits(cells, inside).where("fits").select(*compose.TABLE)
    filled = compose.fill_cells(cells, inside).join(good, compose.TABLE, "left_semi")
    standard = lines.where(form_designation(F.col("text")).isNotNull()).select(*PAGE).distinct()
    plain = filled.join(standard, PAGE, "left_anti").select(*compose.TABLE, "row", "col", "text")
    federal = compose.numbered_rows(compose.expand_rows(filled.join(standard, PAGE, "left_semi"), inside))
    return compose.grid_markdown(plain.unionByName(federal.select(*compose.TABLE, "row", "col", "text"))), filled


def _templated(c: Corpus, o: Options) -> DataFrame | None:
    """Fields of pages whose widgets carry a template's signature."""
    if not o.template_routing or any(t is None for t in (c.signatures, c.template_tokens, c.elements, c.widgets)):
        return None
    match = forms.signature_match(c.signatures, c.template_tokens, o.template_match)
    size = c.pages.select(*PAGE, "width_px", "height_px")
    at = c.elements.withColumnRenamed("page", "template_page").join(match.select(*PAGE, "template_id", "template_page"), ["template_id", "template_page"]).join(size, PAGE)
    at = at.withColumns({b: F.col(b) * F.col("width_px" if b[0] == "x" else "height_px") for b in BOX})
    on = F.coalesce("as_state", F.lit("Off")) != "Off"
    bound = forms.bind_template(at, c.widgets.where("not hidden").withColumn("is_on", on))
    return bound.select(*PAGE, F.col("element_idx").alias("field_idx"), "name", "kind", "value", F.lit(1.0).alias("confidence"), F.lit("template").alias("origin"))


def _fields(c: Corpus, o: Options, lines: DataFrame, templated: DataFrame | None) -> DataFrame:
    """Form fields of each page: of its template, else of its form dictionary, else of its printed labels."""
    found = [(0, templated)] if templated is not None else []
    if o.form_fields and c.widgets is not None:
        d = layer.dictionary_fields(c.widgets)
        found.append((1, d.select(*PAGE, F.col("widget_idx").alias("field_idx"), F.coalesce("name", F.lit("")).alias("name") if "name" in d.columns else F.lit("").alias("name"), F.col("field_type").alias("kind"), "value", "confidence", F.lit("dictionary").alias("origin"))))
    if o.form_fields and c.profiles is not None and c.profile_order is not None:
        g = forms.geometric_fields(lines, c.profiles, c.profile_order)
        found.append((2, g.select(*PAGE, F.col("spec_idx").alias("field_idx"), "name", "kind", "value", "confidence", F.lit("labels").alias("origin"))))
    if not found:
        return c.pages.sparkSession.createDataFrame([], FIELDS)
    every = None
    for priority, f in found:
        f = f.withColumn("priority", F.lit(priority))
        every = f if every is None else every.unionByName(f)
    return forms.first_that_yields(every).drop("priority")


#: Spark 4.1 on: a query removes its shuffle files when it ends. Other versions ignore it.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _cut(df: DataFrame) -> DataFrame:
    """What many steps read is computed once, into the session's checkpoint folder; without one it stays part of the plan.

    It is written as compressed Parquet, its shuffle files go at once, and the folder goes when the driver ends.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getCheckpointDir()
    if not root:
        return df
    at = f"{root}/quiremill-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, at)
    old = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(FREE_SHUFFLES, old)
    return spark.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, at: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception as why:  # at exit the gateway may be gone; files then stay for whoever owns the folder
        if "py4j" not in type(why).__module__ and not isinstance(why, (OSError, AttributeError, AssertionError)):
            raise


def process(c: Corpus, o: Options = Options()) -> Result:
    """All pages: characters, reading order, tables, Markdown, checks, fields, markings, notices; and their documents."""
    c = _wanted(c, o)
    lines, known = _characters(c, _cut(_known(c, o)), o)
    known = _cut(known)
    if c.regions is not None:
        ordered = _cut(order.reading_order(c.regions))
        claimed = _cut(compose.claim(lines, ordered))
        if o.enumerator_order:
            top = claimed.where("region_idx is not null").groupBy(*compose.TABLE).agg(F.min_by("text", F.struct("y1", "x1", "line_idx")).alias("top_text"))
            ordered = order.enumerators(ordered.join(top, compose.TABLE, "left")).drop("top_text")
    else:
        ordered = None
        claimed = lines.withColumn("region_idx", F.lit(None).cast("int")).withColumn("region_type", F.lit(None).cast("string"))
    grids, cells = _grids(c, claimed, lines)
    blocks = compose.region_markdown(claimed, ordered, grids) if ordered is not None else None
    furniture = claimed.withColumn("is_furniture", F.coalesce(F.col("region_type") == "PageFurniture", F.lit(False)))
    # words of the text layer count where the Markdown or the furniture has them, and where the layer is decodable
    truth = c.words if o.verify else None
    finished = _cut(compose.finished_pages(furniture, blocks, truth, o.retry_min_confidence))
    p = known.join(finished, PAGE, "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))
    sound = F.coalesce(F.col("undecodable_fraction") <= o.max_undecodable, F.lit(False))
    p = p.withColumns({n: F.when(sound, F.coalesce(n, F.lit(0).cast("long"))).otherwise(0) for n in ("truth_words", "truth_found")})
    p = p.withColumn("recall_pct", verify.recall_pct(F.col("truth_words"), F.col("truth_found")))
    p = p.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("lines_lost", "words")})
    p = signals.review(p, o.retry_min_words)
    if o.detect_markings:
        banner = signals.sensitivity(furniture.join(known.select(*PAGE, "height_px"), PAGE))
        p = p.join(banner.select(*PAGE, F.col("marking").alias("sensitivity")), PAGE, "left")
    else:
        p = p.withColumn("sensitivity", F.lit(None).cast("string"))
    templated = _templated(c, o)
    fields = _fields(c, o, lines, templated)
    if templated is not None:
        part = compose.template_section(templated).select(*PAGE, F.col("markdown").alias("section"))
        p = p.join(part, PAGE, "left").withColumn("markdown", F.concat("markdown", F.when(F.col("section").isNotNull(), F.concat(F.lit("\n"), "section", F.lit("\n"))).otherwise(""))).drop("section")
    locked = "This form keeps its content in a packet that only its own viewer can show."
    p = p.withColumn("notice", F.when(F.col("is_xfa"), locked).otherwise(F.col("notice")))
    p = p.withColumn("markdown", F.when(F.col("is_xfa"), f"<!-- {locked} -->\n").otherwise(F.col("markdown")))
    p = p.withColumn("needs_review", F.col("needs_review") & ~F.col("is_xfa"))
    flag = verify.flag(F.col("notice"), F.col("lines_lost"), F.col("truth_words"), F.col("recall_pct"), F.lit(None).cast("double"))
    marked = F.lit(o.block_marked) & F.col("sensitivity").isNotNull()
    p = p.withColumn("markdown", F.when(marked, F.concat(F.lit("[withheld: page marked '"), F.col("sensitivity"), F.lit("']"))).otherwise(F.col("markdown")))
    pages = p.select(*PAGE, F.when(F.col("from_layer"), "TextLayer").otherwise("Ocr").alias("source"), "markdown", "notice", "needs_review", "low_resolution", F.col("dpi").alias("effective_dpi"), "render_dpi", "orientation", "retried", "lines_recovered", "lines_lost", "truth_words", "truth_found", "recall_pct", "sensitivity", flag.alias("flag"))
    docs = tables.document_markdown(pages)
    return Result(pages, lines, _appended(docs, pages, cells, o), fields)


def _appended(docs: DataFrame, pages: DataFrame, cells: DataFrame | None, o: Options) -> DataFrame:
    """With the hardware that their pages specify."""
    if not o.hardware_specs:
        return docs
    if cells is None:
        table = pages.sparkSession.createDataFrame([], "doc_id long, table_id long, row int, col int, text string")
    else:
        table = cells.select("doc_id", (F.col("page_number") * 1000 + F.col("region_idx")).cast("long").alias("table_id"), "row", "col", "text")
    return specs.append_section(docs, specs.section(specs.merge_components(specs.components(table, specs.composed_lines(pages)))))


def planned(c: Corpus, o: Options) -> DataFrame:
    """The lane of every page, by what an outside engine says of them."""
    kinds = routing.classify(c.documents, c.signals)
    kinds = kinds if o.pages is None else kinds.where(F.col("page_number").isin(sorted(set(o.pages))))
    return routing.lane_plan(kinds, o.min_fast_confidence, o.ruling_threshold, o.escalation_share)


def process_routed(c: Corpus, o: Options = Options(fast_lane=True), on_plan: Callable[[DataFrame], None] | None = None) -> Result:
    """As process(), but pages that structure can answer are taken from runs and fields, with the plan they followed.

    on_plan sees the plan before any page is read; an error of its own is a warning. A fast page that turns out to hold
    next to nothing goes the other way. Pages of stopped documents are in the plan alone. documents has no page comments.
    """
    if not o.fast_lane or c.signals is None or c.documents is None:
        return process(c, o)
    c = _wanted(c, o)
    plan = _cut(planned(c, o))
    if on_plan is not None:
        try:
            on_plan(plan)
        except Exception as why:  # whoever watches must not stop the work
            warnings.warn(f"on_plan: {why}", stacklevel=2)
    fast = _cut(_fast(c, plan.where("lane = 'Fast'"), o))
    left = plan.where("lane = 'Heavy'").select(*PAGE).unionByName(fast.where("abstain").select(*PAGE))
    heavy = process(c.only(left), replace(o, pages=None, hardware_specs=False))
    merged = routing.merge_lanes(plan, fast, heavy.pages)
    pages = merged.where("produced_by is not null").join(heavy.pages.drop("markdown"), PAGE, "left")
    return Result(pages, heavy.lines, _appended(tables.merged_markdown(pages), pages, None, o), heavy.fields, plan)


def _fast(c: Corpus, plan: DataFrame, o: Options) -> DataFrame:
    """Markdown of pages by structure alone, and whether that holds too little."""
    p = plan.select(*PAGE, "kind")
    trust = c.signals.select(*PAGE, *(["trust"] if "trust" in c.signals.columns else [F.lit(1.0).alias("trust")]))
    p = p.join(trust, PAGE, "left")
    none = F.lit(None).cast("string")
    if c.runs is not None:
        mine = c.runs.join(plan.select(*PAGE), PAGE, "left_semi")
        count = mine.groupBy(*PAGE).agg(F.count_if(~F.col("is_ocr_layer")).alias("n_runs"))
        p = p.join(routing.prose(mine).select(*PAGE, F.col("markdown").alias("prose")), PAGE, "left").join(count, PAGE, "left")
    else:
        p = p.withColumn("prose", none).withColumn("n_runs", F.lit(0))
    if c.fields is not None:
        f = routing.adapt_field(c.fields.join(plan.select(*PAGE), PAGE, "left_semi"))
        count = f.groupBy(*PAGE).agg(F.count("*").alias("n_fields"))
        p = p.join(routing.form_markdown(f).select(*PAGE, F.col("markdown").alias("form")), PAGE, "left").join(count, PAGE, "left")
    else:
        p = p.withColumn("form", none).withColumn("n_fields", F.lit(0))
    md = F.when(F.col("kind") == "FormPage", F.coalesce("form", "prose")).otherwise(F.col("prose"))
    p = p.withColumn("markdown", F.coalesce(md, F.lit("")))
    lone = routing.abstains(F.col("kind"), F.col("n_fields"), F.size(words(F.col("markdown"))), F.coalesce("n_runs", F.lit(0)), F.coalesce("trust", F.lit(1.0)), o.min_fast_words, o.min_trust_runs, o.min_decode_trust)
    return p.select(*PAGE, "markdown", lone.alias("abstain"))
