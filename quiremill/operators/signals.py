"""Page signals: scan resolution, embedded images, sensitivity banners, review notices, retries, orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum_lower, words
from ..sources.tables import PAGE

#: Edges as explicit groups: no lookaround, so that every engine reads the pattern alike.
REST = r"(?://[0-9A-Z][ 0-9A-Z/-]*)?"
CUI = rf"(?:^|[^0-9A-Z])CUI{REST}(?:[^0-9A-Z]|$)"
CONTROLLED = rf"^CONTROLLED{REST}$"
CLASSIFIED = rf"^((?:TOP )?SECRET|CONFIDENTIAL){REST}$"
LEGACY = (
    "FOR OFFICIAL USE ONLY",  # and its acronym, which counts only in capitals
    "FOUO",
    "SENSITIVE BUT UNCLASSIFIED",  # "SBU" is told apart below: it must be the whole line
    "LAW ENFORCEMENT SENSITIVE",
)


def effective_dpi(images: DataFrame, least: float = 0.5) -> DataFrame:
    """dpi of each page's scan: of images that cover half the page, the largest; the later of equals."""
    ok = images.where("placed_w > 0 and placed_h > 0 and sample_w > 0 and sample_h > 0 and page_w * page_h > 0")
    cover = F.col("placed_w") * F.col("placed_h") / (F.col("page_w") * F.col("page_h"))
    dpi = F.bround(F.least(F.col("sample_w") / (F.col("placed_w") / 72.0), F.col("sample_h") / (F.col("placed_h") / 72.0))).cast("int")
    return ok.withColumn("cover", cover).where(F.col("cover") >= least).groupBy(*PAGE).agg(F.max_by(dpi, F.struct("cover", "image_idx")).alias("dpi"))


def image_coverage(images: DataFrame, least: float = 0.01) -> DataFrame:
    """Share of each page that its images of at least 1 % cover, at most 1."""
    share = F.when((F.col("placed_w") > 0) & (F.col("placed_h") > 0) & (F.col("page_w") * F.col("page_h") > 0), F.col("placed_w") * F.col("placed_h") / (F.col("page_w") * F.col("page_h")))
    return images.groupBy(*PAGE).agg(F.least(F.lit(1.0), F.coalesce(F.sum(F.when(share >= least, share)), F.lit(0.0))).alias("coverage"))


def scan_images(images: DataFrame, most: float = 0.5, least: float = 0.01) -> DataFrame:
    """dpi and coverage of each page, as effective_dpi() and image_coverage() say, by one grouping."""
    placed = (F.col("placed_w") > 0) & (F.col("placed_h") > 0) & (F.col("page_w") * F.col("page_h") > 0)
    share = F.when(placed, F.col("placed_w") * F.col("placed_h") / (F.col("page_w") * F.col("page_h")))
    ok = placed & (F.col("sample_w") > 0) & (F.col("sample_h") > 0)
    dpi = F.bround(F.least(F.col("sample_w") / (F.col("placed_w") / 72.0), F.col("sample_h") / (F.col("placed_h") / 72.0))).cast("int")
    large = F.when(ok & (F.col("cover") >= most), F.struct("cover", "image_idx"))
    coverage = F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col("cover") >= least, F.col("cover"))), F.lit(0.0)))
    return images.withColumn("cover", share).groupBy(*PAGE).agg(F.max_by(F.when(ok, dpi), large).alias("dpi"), coverage.alias("coverage"))


def low_resolution(from_layer: Column, dpi: Column, least: int = 150) -> Column:
    return F.coalesce(~from_layer & (dpi < least), F.lit(False))


def marking(text: Column) -> tuple[Column, Column]:
    """(rank, marking) of one line; rank null where it has none. Distribution statements may be of any length."""
    t = F.trim(text)
    up = F.upper(t)
    letter = F.substring(up, 24, 1)
    statement = up.startswith("DISTRIBUTION STATEMENT")
    listed = statement & (F.length(up) > 23) & letter.between("B", "F")
    written = up.startswith("DISTRIBUTION AUTHORIZED TO")
    short = F.length(t) <= 80
    level = F.regexp_extract(up, CLASSIFIED, 1)
    classified = (level != "") & t.contains(level)
    cui = t.rlike(CUI) | up.contains("CONTROLLED UNCLASSIFIED INFORMATION") | t.rlike(CONTROLLED) | t.contains("U//CUI") | up.rlike(r"^(CONTROLLED BY:|CUI CATEGORY:|LIMITED DISSEMINATION CONTROL:|LDC:)") | t.contains("REL TO USA") | up.contains("[CONTAINS CUI]")
    legacy = F.coalesce(*[F.when((up if " " in x else t).contains(x), F.lit(x)) for x in LEGACY], F.when(t == "SBU", "SBU"))
    rank = F.when(listed | written, 1).when(~short, None).when(classified, F.when(level == "TOP SECRET", 5).when(level == "SECRET", 4).otherwise(3)).when(cui, 2).when(legacy.isNotNull(), 1)
    shown = F.when(listed, F.concat(F.lit("DISTRIBUTION STATEMENT "), letter)).when(written, "DISTRIBUTION STATEMENT").when(classified | cui, t).otherwise(legacy)
    return rank, shown


def sensitivity(lines: DataFrame, band: float = 0.12) -> DataFrame:
    """The page's marking: furniture first, then lines in the top or bottom 12 %; first of the highest rank.

    lines: is_furniture, line_idx, text, y1, y2, height_px.
    """
    near = F.col("is_furniture") | (F.col("y1") <= F.col("height_px") * band) | (F.col("y2") >= F.col("height_px") * (1 - band))
    rank, shown = marking(F.col("text"))
    found = lines.where(near).withColumn("rank", rank).withColumn("marking", shown).where("rank is not null")
    first = F.struct("rank", F.when(F.col("is_furniture"), 1).otherwise(0), -F.col("line_idx"))
    return found.groupBy(*PAGE).agg(F.max_by("marking", first).alias("marking"), F.max("rank").alias("rank"))


def keep_better(attempts: DataFrame, most_words: int = 3) -> DataFrame:
    """The attempt kept of each page: a retry counts only while the best so far has fewer than three confident words.

    attempts: attempt_no (0 is the first), words, low_resolution. More words win, ties keep the earlier.
    """
    first = F.max(F.when(F.col("attempt_no") == 0, F.col("words")))
    second = F.greatest(first, F.max(F.when(F.col("attempt_no") == 1, F.col("words"))))
    a = attempts.groupBy(*PAGE).agg(first.alias("w0"), F.coalesce(second, first).alias("w1"), F.max("low_resolution").alias("low"))
    open_ = F.when(F.col("attempt_no") == 0, True).when(F.col("attempt_no") == 1, F.col("low") & (F.col("w0") < most_words)).otherwise(F.col("low") & (F.col("w0") < most_words) & (F.col("w1") < most_words))
    tried = attempts.join(a, PAGE).where(open_)
    return tried.groupBy(*PAGE).agg(F.max_by("attempt_no", F.struct("words", -F.col("attempt_no"))).alias("attempt_no"), F.max("words").alias("words"), (F.count("*") > 1).alias("retried"))


def review(pages: DataFrame, least_words: int = 3) -> DataFrame:
    """needs_review and notice of each page.

    pages: from_layer, truth_words, words, low_resolution, dpi, retried, recovered_via, image_suspected, lines_recovered.
    """
    p = pages
    silent = ~F.col("from_layer") & (F.col("truth_words") == 0) & (F.col("words") < least_words)
    blind = F.col("from_layer") & F.col("image_suspected") & (F.col("lines_recovered") == 0)
    dpi = F.col("dpi").cast("string")
    notice = (
        F.when(silent & F.col("low_resolution") & F.col("dpi").isNotNull(), F.concat(F.lit("Low-resolution scan (about "), dpi, F.lit(" DPI): no text found"), F.when(F.col("retried"), " after another try").otherwise(""), F.lit("; needs review.")))
        .when(silent, "Scan without any text found; needs review.")
        .when(~F.col("from_layer") & F.col("recovered_via").isNotNull(), F.concat(F.lit("Low-resolution scan (about "), dpi, F.lit(" DPI): text found by "), F.col("recovered_via"), F.lit(".")))
        .when(F.col("from_layer") & F.col("image_suspected") & (F.col("lines_recovered") > 0), F.concat(F.lit("Mixed page: lines found in images: "), F.col("lines_recovered").cast("string"), F.lit(".")))
        .when(blind, "Large image without any text found; content may be missing; needs review.")
    )
    return p.withColumn("needs_review", silent | blind).withColumn("notice", notice)


def orientation(lines: DataFrame, bias: float = 1.15, least_chars: int = 100, least_confidence: float = 0.5, least_distinct: float = 0.3) -> DataFrame:
    """The rotation each page needs, by its lines as read in four rotations; 0 unless another wins clearly.

    Two grouped aggregates on the page and rotation; equal scores keep the smaller rotation.
    """
    size = F.length(F.trim("text"))
    tokens = F.filter(F.transform(words(F.col("text")), alnum_lower), lambda w: w != "")
    by = lines.groupBy(*PAGE, "rotation").agg(
        F.sum(F.col("confidence") * size).alias("score"),
        F.sum(size).alias("chars"),
        F.flatten(F.collect_list(tokens)).alias("w"),
    )
    ratio = F.when(F.size("w") == 0, F.lit(1.0)).otherwise(F.size(F.array_distinct("w")) / F.size("w"))
    by = by.select(*PAGE, "rotation", "score", "chars", F.when(F.col("chars") == 0, F.lit(0.0)).otherwise(F.col("score") / F.col("chars")).alias("mean"), ratio.alias("distinct_ratio"))
    best = by.groupBy(*PAGE).agg(F.max_by(F.struct("rotation", "score", "chars", "mean", "distinct_ratio"), F.struct("score", -F.col("rotation"))).alias("b"), F.coalesce(F.max(F.when(F.col("rotation") == 0, F.col("score"))), F.lit(0.0)).alias("score0"))
    b = F.col("b")
    weak = (b["score"] < F.col("score0") * bias) | (b["chars"] < least_chars) | (b["mean"] < least_confidence) | (b["distinct_ratio"] < least_distinct)
    return best.select(*PAGE, F.when(weak, 0).otherwise(b["rotation"]).alias("rotation"), b["rotation"].alias("best_rotation"), b["score"].alias("best_score"), "score0")


