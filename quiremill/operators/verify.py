"""Did any text get lost: coverage, recall, order, gates, flags and ledgers."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box
from ..functions.text import alnum_lower, not_blank, pipe_escape, set_recall, strip, trigrams, undecodable_count
from ..sources.tables import PAGE
from .pagewise import Pages, keyed, low, pagewise


_LINE = ["text", "x1", "y1", "x2", "y2"]


def page_lines() -> Column:
    """Aggregate: the lines of a page as one array, for lost_count()."""
    return F.collect_list(F.struct(F.struct(*_LINE).alias("line"), F.col("is_furniture").alias("furniture"))).alias("lines")


def lost_count(lines: Column, markdown: Column) -> Column:
    """How many lines of more than two characters, no furniture, the Markdown holds neither plain nor escaped.

    Furniture is told by value: a line equal to a furniture line in text and box is furniture.
    """
    furniture = F.transform(F.filter(lines, lambda l: l["furniture"]), lambda l: l["line"])

    def lost(l: Column) -> Column:
        t = l["line"]["text"]
        return (F.length(t) > 2) & ~markdown.contains(t) & ~markdown.contains(pipe_escape(t)) & ~F.array_contains(furniture, l["line"])

    return F.size(F.filter(lines, lost)).cast("long")


def lost_lines(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines_lost of every page: see lost_count(). A page's lines are one array beside its Markdown, so each side is
    read once."""
    per = lines.groupBy(*PAGE).agg(page_lines())
    return pages.select(*PAGE, "markdown").join(per, PAGE, "left").select(*PAGE, F.coalesce(F.when(F.col("lines").isNotNull(), lost_count(F.col("lines"), F.coalesce("markdown", F.lit("")))), F.lit(0).cast("long")).alias("lines_lost"))


def page_words(words: DataFrame, kept: Column) -> DataFrame:
    """word_count, dropped_fraction, undecodable_fraction, truth_words, truth_found, words and recall_pct of every page.

    What layer_quality() and word_recall() say where the output is those of the page's own words for which `kept` holds:
    one reading of the words, packed by page before the one shuffle.
    """
    box = Box.of()
    flat = (box.width <= 0) | (box.height <= 0)
    size = F.when(not_blank(F.col("text")), F.length(strip(F.col("text")))).otherwise(0)
    some = not_blank(F.col("text"))
    w = words.select(*PAGE, alnum_lower(F.col("text")).alias("w"), kept.alias("kept"), (some & ~flat).alias("good"), F.when(flat, size).otherwise(0).alias("lost"), F.when(flat, 0).otherwise(size).alias("held"), F.when(some, undecodable_count(F.col("text"))).otherwise(0).alias("bad"), F.when(some, F.length("text")).otherwise(0).alias("chars"))
    sums = ("good", "lost", "held", "bad", "chars")

    def step(p: Pages) -> dict[str, pa.Array]:
        kept, (_, at) = p.flags("kept"), np.unique(p.codes("w"), return_inverse=True)
        return {**keyed(p, PAGE), **{c: pa.array(p.per_page(p.ints(c))) for c in sums}, **_recall(p, at, np.ones(len(at), bool), kept), "words": pa.array(p.per_page(kept))}

    figures = T.StructType([*[w.schema[k] for k in PAGE], *[T.StructField(c, T.LongType()) for c in (*sums, "truth_words", "truth_found", "words")]])
    p = pagewise(w, PAGE, ["w", "kept", *sums], step, figures)
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    p = p.select(*PAGE, F.col("good").alias("word_count"), share("lost", F.col("lost") + F.col("held")).alias("dropped_fraction"), share("bad", F.col("chars")).alias("undecodable_fraction"), "truth_words", "truth_found", "words")
    return p.withColumn("recall_pct", recall_pct(F.col("truth_words"), F.col("truth_found")))


def _recall(p: Pages, at: np.ndarray, truth: np.ndarray, got: np.ndarray) -> dict[str, pa.Array]:
    """truth_words and truth_found of each page; at numbers the words, truth and got tell whose they are."""
    has = np.zeros(at.max(initial=-1) + 1, bool)
    has[at[got]] = True
    long = truth & _longer(p, 3)
    return {"truth_words": pa.array(p.per_page(long)), "truth_found": pa.array(p.per_page(long & has[at]))}


def _longer(p: Pages, least: int) -> np.ndarray:
    """Words of so many characters; a null is none."""
    return np.asarray(pc.fill_null(pc.greater_equal(pc.utf8_length(p.cols["w"]), least), False).to_numpy(zero_copy_only=False), bool)


def _both(truth: DataFrame, place: str, output: DataFrame, other: str) -> DataFrame:
    """w, out and at of truth (its place) and output (another number of it), to meet page by page."""
    sides = [df.select(*PAGE, alnum_lower(F.col("text")).alias("w"), F.lit(out).alias("out"), F.col(at).cast("long").alias("at")) for df, at, out in ((truth, place, False), (output, other, True))]
    return sides[0].unionByName(sides[1])


def word_recall(truth: DataFrame, output: DataFrame) -> DataFrame:
    """truth_words, found and recall_pct of every page of truth. Tables of words: doc_id, page_number, text.

    Truth words have three characters or more once normalised and count each time; a word is found if the page's output
    has it at all. Both sides go by page through one shuffle of packed pages and meet there, on arrays.
    """
    sides = [df.select(*PAGE, alnum_lower(F.col("text")).alias("w"), F.lit(out).alias("out")) for df, out in ((truth, False), (output, True))]

    def step(p: Pages) -> dict[str, pa.Array]:
        out, (_, at) = p.flags("out"), np.unique(p.codes("w"), return_inverse=True)
        some = np.flatnonzero(p.per_page(~out))
        return {**keyed(p, PAGE, some), **{c: v.take(pa.array(some)) for c, v in _recall(p, at, ~out, out).items()}}

    figures = T.StructType([*[truth.schema[k] for k in PAGE], *[T.StructField(c, T.LongType()) for c in ("truth_words", "truth_found")]])
    both = pagewise(sides[0].unionByName(sides[1]), PAGE, ["w", "out"], step, figures)
    return both.withColumn("recall_pct", recall_pct(F.col("truth_words"), F.col("truth_found")))


def recall_pct(words: Column, found: Column) -> Column:
    """Null without truth."""
    return F.when(words > 0, found * 100.0 / words)


def recall_summary(pages: DataFrame, by: list[str]) -> DataFrame:
    return pages.groupBy(*by).agg(F.bround(F.avg("recall_pct"), 1).alias("avg_recall"), F.count("*").alias("pages"), F.count("recall_pct").alias("pages_with_truth"))


def gates(pages: DataFrame) -> DataFrame:
    """One row: gate1 recall (vacuous without truth), gate2 no lost lines, gate9 no silent empty page."""
    n = F.count("recall_pct")
    share = 100.0 * F.count_if(F.col("recall_pct") >= 95) / F.nullif(n, F.lit(0))
    silent = F.count_if((F.col("source") == "Ocr") & (F.col("words") == 0) & ~F.col("needs_review"))
    return pages.agg(
        F.avg("recall_pct").alias("avg_recall"),
        share.alias("share_95"),
        F.sum("lines_lost").alias("lines_lost"),
        silent.alias("silent_empty"),
        F.when(n == 0, True).otherwise((F.avg("recall_pct") >= 98) & (share >= 98)).alias("gate1"),
        (F.sum("lines_lost") == 0).alias("gate2"),
        (silent == 0).alias("gate9"),
    )


def flag(notice: Column, lost: Column, truth_words: Column, recall: Column, order: Column) -> Column:
    """Why a page is for a person to look at; null if it is not. The first of: notice, loss, no truth, recall, order."""
    return F.when(notice.isNotNull(), notice).when(lost > 0, "lines lost").when(truth_words == 0, "no text layer").when(recall < 95, "recall").when(order < 90, "reading order")


def kendall_tau(items: DataFrame, by: list[str], rank: str = "ord", position: str = "pos") -> DataFrame:
    """tau of positions in rank order; 1 with fewer than two items. Pairs meet within one `by` group of bounded size."""
    a, b = items.alias("a"), items.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in by]
    pairs = a.join(b, _all(same) & (F.col(f"a.{rank}") < F.col(f"b.{rank}")))
    sign = F.signum(F.col(f"b.{position}") - F.col(f"a.{position}"))
    tau = pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in by]).agg((F.sum(sign) / F.count("*")).alias("tau"))
    return items.select(*by).distinct().join(tau, by, "left").select(*by, F.coalesce("tau", F.lit(1.0)).alias("tau"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _lis(values: list[int]) -> int:
    tails: list[int] = []
    for v in values:
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)


def order_fidelity(truth: DataFrame, output: DataFrame, least: int = 8) -> DataFrame:
    """anchors and order_pct of each page: longest increasing run of unique truth words (four characters or more).

    Both sides meet page by page, on arrays.
    """

    def step(p: Pages) -> dict[str, pa.Array]:
        once, first, seen, at = _unique_words(p)
        total = p.per_page(once)
        a = np.flatnonzero(once & seen[at])
        place = p.ints("at")
        a = a[np.lexsort((place[a], first[at[a]], p.page[a]))]
        n = np.bincount(p.page[a], minlength=p.n)
        good = np.flatnonzero((total >= least) & (n >= least))
        end = np.cumsum(n)
        longest = [_lis(place[a[end[i] - n[i] : end[i]]].tolist()) for i in good]
        return {**keyed(p, PAGE, good), "anchors": pa.array(n[good]), "in_order": pa.array(longest, pa.int32())}

    figures = T.StructType([*[truth.schema[k] for k in PAGE], *[T.StructField(c, T.IntegerType()) for c in ("anchors", "in_order")]])
    both = pagewise(_both(truth, "token_idx", output, "token_idx"), PAGE, ["w", "out", "at"], step, figures)
    return both.withColumn("order_pct", F.col("in_order") * 100.0 / F.col("anchors"))


def _unique_words(p: Pages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which items are truth words of four characters or more that their page has once; of each word the first place in
    the output and whether it is there; and the number of each item's word."""
    out, place = p.flags("out"), p.ints("at")
    _, at = np.unique(p.codes("w"), return_inverse=True)
    words = at.max(initial=-1) + 1
    truth = ~out & _longer(p, 4)
    once = truth & (np.bincount(at[truth], minlength=words)[at] == 1)
    first = np.full(words, np.iinfo(np.int64).max)
    np.minimum.at(first, at[out], place[out])
    seen = np.zeros(words, bool)
    seen[at[out]] = True
    return once, first, seen, at


def lane_recall(pages: DataFrame, truth: str = "truth_md", got: str = "got_md") -> DataFrame:
    """Word-set and character-trigram recall of one text against another, page by page."""

    def bag(c: str) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{Nd}]+"), lambda w: F.length(w) >= 3))

    return pages.withColumn("word_recall", set_recall(bag(truth), bag(got))).withColumn("trigram_recall", set_recall(trigrams(F.col(truth)), trigrams(F.col(got))))


def ledger(pages: DataFrame, by: list[str], baseline: dict[str, object]) -> DataFrame:
    """Average recall of each variant and its distance from the baseline variant."""
    avg = pages.groupBy(*by).agg(F.bround(F.avg("recall_pct"), 4).alias("avg_recall"), F.count("*").alias("pages"))
    base = avg.where(_all([F.col(k) == F.lit(v) for k, v in baseline.items()]))
    keep = [k for k in by if k not in baseline]
    base = base.select(*keep, F.col("avg_recall").alias("base"))
    joined = avg.join(base, keep, "left") if keep else avg.join(F.broadcast(base), F.lit(True), "left")  # one row
    return joined.withColumn("delta", F.bround(F.col("avg_recall") - F.col("base"), 4)).drop("base")


def confidence_sweep(words: DataFrame, low: int = 50, high: int = 95, step: int = 5) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 at floors 0.50 to 0.95. words: confidence, is_true.

    One pass: a word counts at every floor up to its confidence.
    """
    floors = F.sequence(F.lit(low), F.lit(high), F.lit(step))
    c = F.bround(F.col("confidence") * 100).cast("int")
    tally = words.select("is_true", c.alias("c"), F.explode(floors).alias("floor"))
    kept = F.col("c") >= F.col("floor")
    out = tally.groupBy("floor").agg(F.count_if(kept & F.col("is_true")).alias("tp"), F.count_if(kept & ~F.col("is_true")).alias("fp"), F.count_if(~kept & F.col("is_true")).alias("fn"))
    return with_f1(out)


def with_f1(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)))


def dpi_histogram(pages: DataFrame, step: int = 25) -> DataFrame:
    return pages.groupBy((F.floor(F.col("dpi") / step) * step).cast("int").alias("bucket")).agg(F.count("*").alias("pages"))


def cell_correctness(truth: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Of each truth row, the most of its cells that one extracted row holds. truth: truth_row, cell; rows: row, text."""
    hit = truth.join(rows, by).where(F.contains(alnum_lower(F.col("text")), alnum_lower(F.col("cell"))))
    best = hit.groupBy(*by, "truth_row", "row").agg(F.count("*").alias("n")).groupBy(*by, "truth_row").agg(F.max("n").alias("n"))
    return truth.groupBy(*by, "truth_row").agg(F.count("*").alias("cells")).join(best, [*by, "truth_row"], "left").withColumn("correct", F.coalesce("n", F.lit(0))).drop("n")


def gold_ranks(region_words: DataFrame, truth: DataFrame, least: int = 8) -> DataFrame:
    """Reading rank of each region by the median truth position of the unique words in it; null below two regions."""

    def step(p: Pages) -> dict[str, pa.Array]:
        once, _, _, at = _unique_words(p)
        out, place = p.flags("out"), p.numbers("at")
        where = np.full(at.max(initial=-1) + 1, np.nan)
        where[at[once]] = place[once]
        a = np.flatnonzero(out & ~np.isnan(where[at]))
        a = a[np.lexsort((at[a], low(place[a]), p.page[a]))]
        if len(a):  # each word once a region
            region, word = low(place[a]), at[a]
            a = a[np.concatenate([[True], (word[1:] != word[:-1]) | (region[1:] != region[:-1])])]
        a = a[np.bincount(p.page[a], minlength=p.n)[p.page[a]] >= least]
        page, region, t = p.page[a], low(place[a]), where[at[a]]
        order = np.lexsort((t, region, page))
        page, region, t = page[order], region[order], t[order]
        start = np.flatnonzero(np.concatenate([[True], (page[1:] != page[:-1]) | (region[1:] != region[:-1])])) if len(a) else np.empty(0, np.int64)
        n = np.diff(np.append(start, len(a)))
        median = (t[start + (n - 1) // 2] + t[start + n // 2]) / 2
        page, region = page[start], region[start]
        order = np.lexsort((region, median, page))
        page, region, median = page[order], region[order], median[order]
        k = np.bincount(page, minlength=p.n)
        rank = (np.arange(len(page)) - (np.cumsum(k) - k)[page] + 1).astype(np.float64)
        rank[k[page] < 2] = np.nan
        return {**keyed(p, PAGE, page), "region_idx": pa.array(np.where(np.isinf(region), np.nan, region), from_pandas=True), "median": pa.array(median), "gold_rank": pa.array(rank, from_pandas=True)}

    ranks = T.StructType([*[truth.schema[k] for k in PAGE], T.StructField("region_idx", region_words.schema["region_idx"].dataType), T.StructField("median", T.DoubleType()), T.StructField("gold_rank", T.IntegerType())])
    return pagewise(_both(truth, "token_idx", region_words, "region_idx"), PAGE, ["w", "out", "at"], step, ranks)


def verdicts(pairs: DataFrame) -> DataFrame:
    """Verdict on each truth field: expected, got (null: nothing paired), others (array of the form's other values)."""
    e, g = alnum_lower(F.col("expected")), alnum_lower(F.col("got"))
    most = F.greatest(F.length(e), F.length(g))
    own = F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(e, g) / most)
    others = F.transform("others", alnum_lower)
    match = (g != "") & (e.contains(g) | g.contains(e))
    verdict = (
        F.when(F.col("got").isNull(), "missing")
        .when(match & (g != e) & e.startswith(g) & (F.length(g) >= 3), "truncated-source")
        .when(match, "correct")
        .when(F.array_contains(others, g) & (own < 0.8), "cross-field")
        .when(own >= 0.5, "garbled")
        .when(F.exists(others, lambda o: (g != "") & o.contains(g)), "cross-field")
        .otherwise("wrong-other")
    )
    return pairs.withColumn("similarity", own).withColumn("verdict", verdict)
