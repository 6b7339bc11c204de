"""One query for each operator, over inputs derived from the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hardware as H
from ..functions import text as X
from ..functions.geometry import Box, from_points, to_grid
from ..operators import compose, forms, layer, order, routing, shape, signals, specs, verify
from ..process import Corpus, process
from ..sources import tables as S
from . import inputs as I
from .inputs import Data, oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PAGE = S.PAGE


def query(sql: str | None = None) -> Callable[[Callable[[Data], DataFrame]], Callable[[Data], DataFrame]]:
    def add(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return add


NORM = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"


def norm(c: str) -> str:
    return NORM.format(c)


# Text layer


@query(f"WITH {I.TOKENS} SELECT doc_id, page_number, token_idx, text, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * 20 AS area FROM box")
def token_boxes(d: Data) -> DataFrame:
    b = Box.of()
    return d.words().withColumn("cx", b.cx).withColumn("cy", b.cy).withColumn("area", b.area)


@query(f"WITH {I.TOKENS}, {I.RUNS} SELECT doc_id, page_number, line_idx, text, x1, y1, x2, y2, n_words FROM runs")
def text_runs(d: Data) -> DataFrame:
    return layer.text_runs(d.words(), exact_rows=True)


@query(f"WITH {I.TOKENS}, {I.RUNS} SELECT doc_id, page_number, line_idx, text, x1, y1, x2, y2, n_words FROM runs")
def text_runs_folded(d: Data) -> DataFrame:
    """The same by the running-mean fold, which does not need an exact grid."""
    return layer.text_runs(d.words())


@query(f"WITH {I.TOKENS} SELECT doc_id, page_number, string_agg(text, '  ' ORDER BY x1) AS text, min(x1) AS x1, y1, count(*) AS n_items FROM box GROUP BY doc_id, page_number, y1")
def visual_rows(d: Data) -> DataFrame:
    return layer.visual_rows(d.words(), "token_idx").drop("row_id")


def _spliced(d: Data) -> DataFrame:
    """Words with some control characters, some that are white space alone, and some boxes without area."""
    w = d.words()
    bad = F.when((F.col("doc_id") + F.col("token_idx")) % 23 == 0, F.concat(F.col("text"), F.lit("\x07�"))).otherwise(F.col("text"))
    bad = F.when((F.col("doc_id") + F.col("token_idx")) % 37 == 1, F.lit("\t\u00a0")).otherwise(bad)
    return w.withColumn("text", bad).withColumn("x2", F.when((F.col("doc_id") * 3 + F.col("token_idx")) % (F.col("doc_id") % 7 + 2) == 0, F.col("x1")).otherwise(F.col("x2")))


SPLICED = """spl AS (
  SELECT doc_id, page_number, token_idx, CASE WHEN (doc_id + token_idx) % 37 = 1 THEN chr(9) || chr(160) WHEN (doc_id + token_idx) % 23 = 0 THEN text || chr(7) || chr(65533) ELSE text END AS text,
    x1, CASE WHEN (doc_id * 3 + token_idx) % (doc_id % 7 + 2) = 0 THEN x1 ELSE x2 END AS x2, CASE WHEN (doc_id + token_idx) % 23 = 0 THEN 2 ELSE 0 END AS bad FROM box
), quality AS (
  SELECT doc_id, page_number, CAST(sum(CASE WHEN x2 > x1 THEN 1 ELSE 0 END) AS BIGINT) AS word_count,
    sum(CASE WHEN x2 > x1 THEN 0 ELSE length(text) END) / sum(length(text)) AS dropped_fraction, sum(bad) / sum(length(text)) AS undecodable_fraction
  FROM spl WHERE text <> chr(9) || chr(160) GROUP BY doc_id, page_number
)"""


@query(f"WITH {I.TOKENS}, {SPLICED} SELECT doc_id, page_number, word_count, round(dropped_fraction, 9) AS dropped_fraction, round(undecodable_fraction, 9) AS undecodable_fraction FROM quality")
def layer_quality(d: Data) -> DataFrame:
    return layer.layer_quality(_spliced(d)).withColumn("dropped_fraction", F.round("dropped_fraction", 9)).withColumn("undecodable_fraction", F.round("undecodable_fraction", 9))


@query(f"WITH {I.TOKENS}, {SPLICED} SELECT doc_id, page_number, mode, CASE mode WHEN 'Never' THEN FALSE WHEN 'Always' THEN word_count > 0 ELSE word_count >= 5 AND dropped_fraction <= 0.3 AND undecodable_fraction <= 0.2 END AS uses_layer FROM quality CROSS JOIN (VALUES ('Never'), ('Always'), ('Auto')) m(mode)")
def text_source_decision(d: Data) -> DataFrame:
    q = layer.layer_quality(_spliced(d)).withColumn("mode", F.explode(F.array(*map(F.lit, ("Never", "Always", "Auto")))))
    return q.select(*PAGE, "mode", layer.uses_layer(F.col("mode"), F.col("word_count"), F.col("dropped_fraction"), F.col("undecodable_fraction")).alias("uses_layer"))


XFA = "SELECT conv_id AS doc_id, CAST(1 AS INT) AS page_number, CAST(turn AS INT) AS line_idx, CASE WHEN conv_id % 4 = 0 AND turn = 0 THEN concat(text, ' Please') WHEN conv_id % 4 = 0 AND turn = 1 THEN 'wait... If this message stays, get Adobe Reader' ELSE text END AS text FROM {conversations}"


@query(f"SELECT doc_id, page_number, contains(t, 'please wait') AND contains(t, 'adobe reader') AS is_placeholder FROM (SELECT doc_id, page_number, lower(string_agg(text, ' ' ORDER BY line_idx)) AS t FROM ({XFA}) x GROUP BY doc_id, page_number)")
def xfa_placeholder(d: Data) -> DataFrame:
    return layer.xfa_placeholder(d.sql(XFA))


def _shifted(r: DataFrame) -> DataFrame:
    """Recognised lines: the runs moved right, every second one far."""
    by = F.when(F.col("line_idx") % 2 == 0, F.lit(10_000.0)).otherwise(F.floor((F.col("x2") - F.col("x1")) / 20) * 10 + F.col("line_idx") % 3 * 60)
    return r.withColumns({"line_idx": F.col("line_idx") + 1000, "x1": F.col("x1") + by, "x2": F.col("x2") + by})


@query(
    f"""WITH {I.TOKENS}, {I.RUNS}, sh AS (SELECT doc_id, page_number, line_idx + 1000 AS line_idx, text, y1, y2, x1 + b AS x1, x2 + b AS x2 FROM (SELECT *, CASE WHEN line_idx % 2 = 0 THEN 10000 ELSE floor((x2 - x1) / 20) * 10 + line_idx % 3 * 60 END AS b FROM runs))
SELECT doc_id, page_number, line_idx, text, x1, y1, x2, y2, 'TextLayer' AS source FROM runs
UNION ALL SELECT doc_id, page_number, line_idx, text, x1, y1, x2, y2, 'Ocr' FROM sh o WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = o.doc_id AND r.page_number = o.page_number
  AND least(o.x2, r.x2) > greatest(o.x1, r.x1) AND least(o.y2, r.y2) > greatest(o.y1, r.y1)
  AND (least(o.x2, r.x2) - greatest(o.x1, r.x1)) * (least(o.y2, r.y2) - greatest(o.y1, r.y1)) / greatest(1, (o.x2 - o.x1) * (o.y2 - o.y1)) > 0.3)"""
)
def mixed_page_merge(d: Data) -> DataFrame:
    r = layer.text_runs(d.words(), exact_rows=True)
    return layer.merge_recognised(r, _shifted(r))


# Signals


@query(f"SELECT doc_id, page_number, dpi FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY cover DESC, image_idx DESC) AS i FROM (SELECT *, CAST(round_even(least(sample_w / (placed_w / 72.0), sample_h / (placed_h / 72.0)), 0) AS INT) AS dpi, placed_w * placed_h / (page_w * page_h) AS cover FROM ({I.IMAGES}) i) x WHERE cover >= 0.5) y WHERE i = 1")
def effective_dpi(d: Data) -> DataFrame:
    return signals.effective_dpi(d.sql(I.IMAGES))


@query(f"SELECT doc_id, page_number, round(least(1.0, sum(CASE WHEN placed_w * placed_h / (page_w * page_h) >= 0.01 THEN placed_w * placed_h / (page_w * page_h) ELSE 0 END)), 9) AS coverage FROM ({I.IMAGES}) i GROUP BY doc_id, page_number")
def image_coverage(d: Data) -> DataFrame:
    return signals.image_coverage(d.sql(I.IMAGES)).withColumn("coverage", F.round("coverage", 9))


_RANK = rf"""
CASE WHEN starts_with(up, 'DISTRIBUTION STATEMENT') AND length(up) > 23 AND substr(up, 24, 1) BETWEEN 'B' AND 'F' THEN 1 WHEN starts_with(up, 'DISTRIBUTION AUTHORIZED TO') THEN 1 WHEN length(t) > 80 THEN NULL
  WHEN level <> '' AND contains(t, level) THEN CASE level WHEN 'TOP SECRET' THEN 5 WHEN 'SECRET' THEN 4 ELSE 3 END
  WHEN regexp_matches(t, '{signals.CUI}') OR contains(up, 'CONTROLLED UNCLASSIFIED INFORMATION') OR regexp_matches(t, '{signals.CONTROLLED}') OR contains(t, 'U//CUI') OR starts_with(up, 'CONTROLLED BY:')
    OR starts_with(up, 'CUI CATEGORY:') OR starts_with(up, 'LIMITED DISSEMINATION CONTROL:') OR starts_with(up, 'LDC:') OR contains(t, 'REL TO USA') OR contains(up, '[CONTAINS CUI]') THEN 2
  WHEN contains(up, 'FOR OFFICIAL USE ONLY') OR contains(t, 'FOUO') OR contains(up, 'SENSITIVE BUT UNCLASSIFIED') OR contains(up, 'LAW ENFORCEMENT SENSITIVE') OR t = 'SBU' THEN 1 END"""


@query(
    f"""WITH b AS (SELECT *, trim(text) AS t, upper(trim(text)) AS up FROM ({I.BANNERS}) x WHERE is_furniture OR y1 <= height_px * 0.12 OR y2 >= height_px * 0.88),
c AS (SELECT *, regexp_extract(up, '{signals.CLASSIFIED}', 1) AS level FROM b), r AS (SELECT *, {_RANK} AS rank FROM c),
s AS (SELECT *, CASE WHEN starts_with(up, 'DISTRIBUTION STATEMENT') AND rank = 1 AND length(up) > 23 THEN 'DISTRIBUTION STATEMENT ' || substr(up, 24, 1) WHEN starts_with(up, 'DISTRIBUTION AUTHORIZED TO') THEN 'DISTRIBUTION STATEMENT' WHEN rank >= 2 THEN t
  WHEN contains(up, 'FOR OFFICIAL USE ONLY') THEN 'FOR OFFICIAL USE ONLY' WHEN contains(t, 'FOUO') THEN 'FOUO' WHEN contains(up, 'SENSITIVE BUT UNCLASSIFIED') THEN 'SENSITIVE BUT UNCLASSIFIED' WHEN contains(up, 'LAW ENFORCEMENT SENSITIVE') THEN 'LAW ENFORCEMENT SENSITIVE' ELSE t END AS marking,
  row_number() OVER (PARTITION BY doc_id, page_number ORDER BY rank DESC, is_furniture DESC, line_idx) AS i FROM r WHERE rank IS NOT NULL)
SELECT doc_id, page_number, marking, CAST(rank AS INT) AS rank FROM s WHERE i = 1"""
)
def sensitivity_marking(d: Data) -> DataFrame:
    return signals.sensitivity(d.sql(I.BANNERS))


@query(
    f"""WITH a AS ({I.ATTEMPTS}), w AS (SELECT doc_id, page_number, max(CASE WHEN attempt_no = 0 THEN words END) AS w0, max(CASE WHEN attempt_no <= 1 THEN words END) AS w1, bool_or(low_resolution) AS low FROM a GROUP BY doc_id, page_number),
t AS (SELECT a.*, row_number() OVER (PARTITION BY a.doc_id, a.page_number ORDER BY words DESC, attempt_no) AS i, count(*) OVER (PARTITION BY a.doc_id, a.page_number) AS n FROM a JOIN w USING (doc_id, page_number) WHERE attempt_no = 0 OR (low AND w0 < 3 AND (attempt_no = 1 OR w1 < 3)))
SELECT doc_id, page_number, attempt_no, words, n > 1 AS retried FROM t WHERE i = 1"""
)
def retry_keep_better(d: Data) -> DataFrame:
    return signals.keep_better(d.sql(I.ATTEMPTS))


REVIEW = "SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, turn % 2 = 0 AS from_layer, CAST(conv_id % 3 AS BIGINT) AS truth_words, CAST((conv_id + turn) % 6 AS BIGINT) AS words, conv_id % 2 = 0 AS low_resolution, CASE WHEN turn % 3 = 0 THEN NULL ELSE CAST(60 + turn AS INT) END AS dpi, conv_id % 5 = 0 AS retried, CASE WHEN (conv_id + turn) % 4 = 3 THEN 'upscaling' END AS recovered_via, turn % 4 = 0 AS image_suspected, CAST(conv_id % 2 AS INT) AS lines_recovered FROM {conversations}"


@query(
    f"""SELECT doc_id, page_number, s OR b AS needs_review, CASE WHEN s AND low_resolution AND dpi IS NOT NULL THEN 'Low-resolution scan (about ' || dpi || ' DPI): no text found' || CASE WHEN retried THEN ' after another try' ELSE '' END || '; needs review.' WHEN s THEN 'Scan without any text found; needs review.'
WHEN NOT from_layer AND recovered_via IS NOT NULL THEN 'Low-resolution scan (about ' || dpi || ' DPI): text found by ' || recovered_via || '.' WHEN from_layer AND image_suspected AND lines_recovered > 0 THEN 'Mixed page: lines found in images: ' || lines_recovered || '.' WHEN b THEN 'Large image without any text found; content may be missing; needs review.' END AS notice
FROM (SELECT *, NOT from_layer AND truth_words = 0 AND words < 3 AS s, from_layer AND image_suspected AND lines_recovered = 0 AS b FROM ({REVIEW}) x)"""
)
def needs_review(d: Data) -> DataFrame:
    return signals.review(d.sql(REVIEW)).select(*PAGE, "needs_review", "notice")


@query(
    f"""WITH l AS ({I.ROTATED}), m AS (SELECT doc_id, page_number, rotation, sum(confidence * length(trim(text))) AS score, sum(length(trim(text))) AS chars, list_filter(list_transform(string_split_regex(string_agg(text, ' '), '\\s+'), lambda w: {norm('w')}), lambda w: w <> '') AS w FROM l GROUP BY ALL),
k AS (SELECT *, CASE WHEN chars = 0 THEN 0 ELSE score / chars END AS mean, CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_distinct(w)) / len(w) END AS ratio, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY round(score, 6) DESC, rotation) AS i, max(CASE WHEN rotation = 0 THEN score END) OVER (PARTITION BY doc_id, page_number) AS s0 FROM m)
SELECT doc_id, page_number, CASE WHEN score < s0 * 1.15 OR chars < 100 OR mean < 0.5 OR ratio < 0.3 THEN 0 ELSE rotation END AS rotation, rotation AS best_rotation, round(score, 6) AS best_score, round(s0, 6) AS score0 FROM k WHERE i = 1"""
)
def orientation_vote(d: Data) -> DataFrame:
    return signals.orientation(d.sql(I.ROTATED)).withColumn("best_score", F.round("best_score", 6)).withColumn("score0", F.round("score0", 6))


# Routing

_KINDS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in routing.KIND_OF_CLASS.items())
KINDS = f"""kinds AS (
  SELECT s.doc_id, s.page_number, CASE WHEN has_xfa THEN 'Mixed' ELSE CASE class {_KINDS} ELSE 'Mixed' END END AS kind, confidence, rulings
  FROM ({I.DOCUMENTS}) d JOIN ({I.SIGNALS}) s ON s.doc_id = d.doc_id WHERE status = 'Processed'
  UNION ALL SELECT doc_id, CAST(unnest(range(1, page_count + 1)) AS INT), CASE WHEN status = 'Processed' THEN 'Mixed' ELSE 'Unprocessable' END, CAST(1 AS DOUBLE), 0
  FROM ({I.DOCUMENTS}) d WHERE status <> 'Processed' OR doc_id NOT IN (SELECT doc_id FROM ({I.SIGNALS}) s)
), own AS (
  SELECT *, CASE WHEN kind = 'Unprocessable' THEN 'Stop' WHEN kind IN ('FormPage', 'DigitalText', 'Empty') THEN CASE WHEN confidence < 0.6 THEN 'Heavy' ELSE 'Fast' END WHEN kind = 'TableOrComplexLayout' AND rulings < 4 THEN 'Fast' ELSE 'Heavy' END AS own FROM kinds
), docw AS (
  SELECT *, bool_or(kind = 'Unprocessable') OVER (PARTITION BY doc_id) AS stopped, avg(CASE WHEN own = 'Heavy' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY doc_id) AS share FROM own
), plan AS (
  SELECT doc_id, page_number, kind, confidence, rulings, CASE WHEN stopped THEN 'Stop' WHEN share >= 0.8 THEN 'Heavy' ELSE own END AS lane,
    CASE WHEN stopped THEN 'document stopped' WHEN share >= 0.8 THEN 'whole document escalated' WHEN kind IN ('FormPage', 'DigitalText', 'Empty') THEN CASE WHEN own = 'Heavy' THEN 'low confidence' ELSE 'answered by structure' END
      WHEN kind = 'TableOrComplexLayout' THEN CASE WHEN own = 'Fast' THEN 'few rulings: read as text' ELSE 'table needs pixels' END ELSE 'needs pixels' END AS reason, stopped, NOT stopped AND share >= 0.8 AS escalated FROM docw
)"""


def _kinds(d: Data) -> DataFrame:
    return routing.classify(d.sql(I.DOCUMENTS), d.sql(I.SIGNALS))


def _plan(d: Data) -> DataFrame:
    return routing.lane_plan(_kinds(d), ruling_threshold=4)


@query(f"WITH {KINDS} SELECT doc_id, page_number, kind, confidence, rulings FROM kinds")
def page_classification(d: Data) -> DataFrame:
    return _kinds(d)


@query(f"WITH {KINDS} SELECT * FROM plan")
def lane_plan(d: Data) -> DataFrame:
    return _plan(d)


@query(
    f"""WITH {KINDS} SELECT doc_id, count(*) FILTER (WHERE lane = 'Fast') AS n_fast, count(*) FILTER (WHERE lane = 'Heavy') AS n_heavy, count(*) FILTER (WHERE lane = 'Stop') AS n_stop, coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (WHERE lane = 'Heavy'), '') AS heavy_pages,
round(avg(CASE WHEN lane = 'Heavy' THEN 1.0 ELSE 0.0 END), 9) AS escalation_share, bool_or(stopped) AS stopped, bool_or(escalated) AS escalated FROM plan GROUP BY doc_id"""
)
def lane_summary(d: Data) -> DataFrame:
    return routing.lane_summary(lane_plan(d)).withColumn("escalation_share", F.round("escalation_share", 9))


ABST = "(kind = 'FormPage' AND rulings % 3 = 0 AND rulings < 5) OR (kind <> 'FormPage' AND (confidence < 0.5 OR (rulings < 5 AND page_number * 4 >= 10)))"


def _abstaining(d: Data) -> DataFrame:
    k = lane_plan(d)
    return k.withColumn("abstain", routing.abstains(F.col("kind"), F.col("rulings") % 3, F.col("rulings"), F.col("page_number") * 4, F.col("confidence")))


@query(f"WITH {KINDS} SELECT doc_id, page_number, kind, {ABST} AS abstain FROM plan")
def fast_lane_abstention(d: Data) -> DataFrame:
    return _abstaining(d).select(*PAGE, "kind", "abstain")


@query(
    f"""WITH {KINDS} SELECT doc_id, page_number, lane, CASE WHEN lane = 'Fast' AND NOT ({ABST}) THEN 'fast ' || page_number ELSE 'heavy ' || page_number END AS markdown, CASE WHEN lane = 'Fast' AND NOT ({ABST}) THEN 'structure' ELSE 'pixels' END AS produced_by FROM plan"""
)
def lane_merge_provenance(d: Data) -> DataFrame:
    p = _abstaining(d)
    fast = p.where("lane = 'Fast'").select(*PAGE, F.concat(F.lit("fast "), F.col("page_number").cast("string")).alias("markdown"), "abstain")
    heavy = p.where("lane <> 'Fast' or abstain").select(*PAGE, F.concat(F.lit("heavy "), F.col("page_number").cast("string")).alias("markdown"))
    return routing.merge_lanes(p.drop("abstain"), fast, heavy)


@query(
    f"""WITH {KINDS} SELECT source, count(*) AS pages, count(*) FILTER (WHERE lane = 'Fast') AS n_fast, count(*) FILTER (WHERE lane = 'Heavy') AS n_heavy, count(*) FILTER (WHERE lane = 'Stop') AS n_stop, round(count(*) FILTER (WHERE lane = 'Heavy') / count(*), 9) AS heavy_share, count(*) FILTER (WHERE kind = 'TableOrComplexLayout') AS n_tables
FROM (SELECT *, 'corpus' || (doc_id % 5) AS source FROM plan) GROUP BY ROLLUP (source)"""
)
def route_census(d: Data) -> DataFrame:
    p = lane_plan(d).withColumn("source", F.concat(F.lit("corpus"), (F.col("doc_id") % 5).cast("string")))
    return routing.route_census(p).withColumn("heavy_share", F.round("heavy_share", 9))


@query(f"WITH {I.TOKENS}, {I.RUNS} SELECT doc_id, page_number, string_agg(t, chr(10) ORDER BY y1) AS markdown FROM (SELECT doc_id, page_number, y1, string_agg(text, ' ' ORDER BY x1) AS t FROM runs GROUP BY doc_id, page_number, y1) GROUP BY doc_id, page_number")
def fast_lane_prose(d: Data) -> DataFrame:
    r = layer.text_runs(d.words(), exact_rows=True)
    up = r.select(*PAGE, F.col("line_idx").alias("run_idx"), F.col("x1").alias("x"), (F.lit(S.PAGE_HEIGHT) - F.col("y1")).alias("y"), (F.col("x2") - F.col("x1")).alias("width"), F.lit(20.0).alias("font_size"), F.lit(0.25).alias("space_width_em"), "text", F.lit(False).alias("is_ocr_layer"))
    return routing.prose(up)


@query(
    f"""SELECT doc_id, page_number, string_agg('- **' || name || ':** ' || v, chr(10) ORDER BY field_idx) AS markdown FROM (
SELECT *, CASE WHEN trim(coalesce(qualified_name, '')) <> '' THEN trim(qualified_name) WHEN trim(coalesce(partial_name, '')) <> '' THEN trim(partial_name) WHEN trim(coalesce(label, '')) <> '' THEN trim(label) ELSE '(unnamed)' END AS name,
CASE WHEN field_type = 'Button' THEN CASE WHEN is_checked THEN '[x]' ELSE '[ ]' END WHEN trim(value) <> '' THEN trim(value) END AS v FROM ({I.FIELDS}) f) WHERE v IS NOT NULL GROUP BY doc_id, page_number"""
)
def fast_lane_form_markdown(d: Data) -> DataFrame:
    return routing.form_markdown(routing.adapt_field(d.sql(I.FIELDS)))


# Verification


LOST = f"""{I.TOKENS}, {I.RUNS}, md AS (SELECT doc_id, page_number, string_agg(replace(text, '|', '\\|'), chr(10) ORDER BY line_idx) AS markdown FROM runs WHERE (doc_id + line_idx) % 19 <> 0 GROUP BY doc_id, page_number),
lost AS (SELECT m.doc_id, m.page_number, count(*) FILTER (WHERE line_idx % 31 <> 0 AND length(text) > 2 AND NOT contains(markdown, text) AND NOT contains(markdown, replace(text, '|', '\\|'))) AS lines_lost FROM md m LEFT JOIN runs r ON m.doc_id = r.doc_id AND m.page_number = r.page_number GROUP BY m.doc_id, m.page_number)"""


@query(f"WITH {LOST} SELECT * FROM lost")
def coverage_lost_lines(d: Data) -> DataFrame:
    """Pages with some lines left out or their pipes escaped; pages of which nothing is left have no Markdown."""
    r = layer.text_runs(d.words(), exact_rows=True).withColumn("is_furniture", F.col("line_idx") % 31 == 0)
    shown = F.when((F.col("doc_id") + F.col("line_idx")) % 19 != 0, X.pipe_escape(F.col("text")))
    pages = r.groupBy(*PAGE).agg(verify.page_lines(), S.in_order(shown, F.col("line_idx"), separator="\n").alias("markdown"), F.count(shown).alias("n"))
    return pages.where("n > 0").select(*PAGE, verify.lost_count(F.col("lines"), F.col("markdown")).alias("lines_lost"))


RECALL = f"""{I.TOKENS}, tw AS (SELECT doc_id, page_number, {norm('text')} AS w, count(*) AS n FROM box GROUP BY ALL), gw AS (SELECT DISTINCT doc_id, page_number, {norm('text')} AS w FROM twin),
recall AS (SELECT t.doc_id, t.page_number, CAST(coalesce(sum(n) FILTER (WHERE length(t.w) >= 3), 0) AS BIGINT) AS truth_words, CAST(coalesce(sum(n) FILTER (WHERE length(t.w) >= 3 AND g.w IS NOT NULL), 0) AS BIGINT) AS truth_found FROM tw t LEFT JOIN gw g USING (doc_id, page_number, w) GROUP BY ALL)"""
_PCT = "CASE WHEN truth_words > 0 THEN truth_found * 100.0 / truth_words END"


@query(f"WITH {RECALL} SELECT *, round({_PCT}, 9) AS recall_pct FROM recall")
def word_recall(d: Data) -> DataFrame:
    return verify.word_recall(d.words(), d.twin()).withColumn("recall_pct", F.round("recall_pct", 9))


@query(f"WITH {RECALL} SELECT doc_id, round_even(avg(CAST({_PCT} AS DOUBLE)), 1) AS avg_recall, count(*) AS pages, count({_PCT}) AS pages_with_truth FROM recall GROUP BY doc_id")
def recall_summary(d: Data) -> DataFrame:
    return verify.recall_summary(verify.word_recall(d.words(), d.twin()), ["doc_id"])


REPORT = f"""{RECALL}, base AS (SELECT doc_id, page_number, count(*) AS words, min(confidence) AS c FROM twin GROUP BY ALL),
rep AS (SELECT r.*, CAST({_PCT} AS DOUBLE) AS recall_pct, coalesce(words, 0) AS words, CASE WHEN r.doc_id % 4 = 1 THEN 'Ocr' ELSE 'TextLayer' END AS source FROM recall r LEFT JOIN base b USING (doc_id, page_number))"""


def _report(d: Data) -> DataFrame:
    """Recall, words and quality of every page, from its words in one pass."""
    twin = (F.col("doc_id") * 31 + F.col("token_idx")) % 17 != 0  # what degraded() keeps
    r = verify.page_words(d.words(), twin)
    return r.withColumn("source", F.when(F.col("doc_id") % 4 == 1, "Ocr").otherwise("TextLayer")).withColumn("needs_review", F.lit(False)).withColumn("lines_lost", F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0))


@query(
    f"""WITH {REPORT}, a AS (SELECT avg(recall_pct) AS m, 100.0 * count(*) FILTER (WHERE recall_pct >= 95) / nullif(count(recall_pct), 0) AS s, sum(CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END) AS l, count(*) FILTER (WHERE source = 'Ocr' AND words = 0) AS e, count(recall_pct) AS n FROM rep)
SELECT round(m, 6) AS avg_recall, round(s, 6) AS share_95, CAST(l AS BIGINT) AS lines_lost, e AS silent_empty, CASE WHEN n = 0 THEN TRUE ELSE m >= 98 AND s >= 98 END AS gate1, l = 0 AS gate2, e = 0 AS gate9 FROM a"""
)
def corpus_gates(d: Data) -> DataFrame:
    return verify.gates(_report(d)).withColumn("avg_recall", F.round("avg_recall", 6)).withColumn("share_95", F.round("share_95", 6))


@query(
    f"""WITH {REPORT}, q AS (SELECT doc_id, page_number, count(*) AS word_count FROM box GROUP BY ALL), k AS (SELECT r.*, word_count, word_count >= 5 AS from_layer, CASE WHEN (r.doc_id + r.page_number) % 6 = 0 THEN 'TableOrComplexLayout' WHEN (r.doc_id + r.page_number) % 6 = 1 THEN 'ScannedImageOnly' ELSE 'DigitalText' END AS kind, CAST((r.doc_id * 13 + r.page_number * 5) % 100 AS DOUBLE) / 100 AS confidence FROM rep r JOIN q USING (doc_id, page_number)),
o AS (SELECT *, CASE WHEN kind = 'DigitalText' AND confidence >= 0.6 THEN 'Fast' ELSE 'Heavy' END AS own FROM k), w AS (SELECT *, avg(CASE WHEN own = 'Heavy' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY doc_id) AS share FROM o)
SELECT doc_id, page_number, word_count, from_layer, CASE WHEN share >= 0.8 THEN 'Heavy' ELSE own END AS lane, truth_words, truth_found, round(recall_pct, 6) AS recall_pct,
CASE WHEN doc_id % 50 = 0 THEN 'lines lost' WHEN truth_words = 0 THEN 'no text layer' WHEN recall_pct < 95 THEN 'recall' END AS flag FROM w"""
)
def page_quality_report(d: Data) -> DataFrame:
    """The flagship: words, layer decision, lane plan, recall of the degraded reading, flag; one row a page."""
    r = _report(d)
    at = F.col("doc_id") + F.col("page_number")
    kind = F.when(at % 6 == 0, "TableOrComplexLayout").when(at % 6 == 1, "ScannedImageOnly").otherwise("DigitalText")
    r = r.withColumns({"kind": kind, "confidence": ((F.col("doc_id") * 13 + F.col("page_number") * 5) % 100) / F.lit(100.0), "rulings": F.lit(0)})
    r = routing.with_lanes(r)
    layered = layer.uses_layer(F.lit("Auto"), F.col("word_count"), F.col("dropped_fraction"), F.col("undecodable_fraction"))
    flag = verify.flag(F.lit(None).cast("string"), F.col("lines_lost"), F.col("truth_words"), F.col("recall_pct"), F.lit(None).cast("double"))
    return r.select(*PAGE, "word_count", layered.alias("from_layer"), "lane", "truth_words", "truth_found", F.round("recall_pct", 6).alias("recall_pct"), flag.alias("flag"))


SNIPS = "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS ord, CAST(MIN(l_partkey) AS BIGINT) AS pos FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@query(f"WITH s AS ({SNIPS}), p AS (SELECT a.doc_id, sum(sign(b.pos - a.pos)) / count(*) AS tau FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.ord < b.ord GROUP BY a.doc_id) SELECT d.doc_id, round(coalesce(tau, 1.0), 9) AS tau FROM (SELECT DISTINCT doc_id FROM s) d LEFT JOIN p USING (doc_id)")
def order_kendall_tau(d: Data) -> DataFrame:
    return verify.kendall_tau(d.sql(SNIPS), ["doc_id"]).withColumn("tau", F.round("tau", 9))


@query(
    rf"""WITH {I.TOKENS}, w AS (SELECT doc_id, page_number, {norm('text')} AS w, token_idx AS t FROM box), u AS (SELECT doc_id, page_number, w, min(t) AS t FROM w WHERE length(w) >= 4 GROUP BY ALL HAVING count(*) = 1),
g AS (SELECT doc_id, page_number, {norm('text')} AS w, min(xor(token_idx, 1)) AS g FROM twin GROUP BY ALL), n AS (SELECT doc_id, page_number FROM u GROUP BY ALL HAVING count(*) >= 8),
p AS (SELECT u.doc_id, u.page_number, list([u.t] ORDER BY g.g, u.t) AS p FROM u JOIN g USING (doc_id, page_number, w) JOIN n USING (doc_id, page_number) GROUP BY ALL HAVING count(*) >= 8),
k AS (SELECT doc_id, page_number, len(p) AS a, len(list_reduce(p, lambda acc, x: acc[1:len(list_filter(acc, lambda y: y < x[1]))] || x || acc[len(list_filter(acc, lambda y: y < x[1])) + 2:])) AS k FROM p)
SELECT doc_id, page_number, CAST(a AS INT) AS anchors, CAST(k AS INT) AS in_order, round(CAST(k * 100 AS DOUBLE) / a, 9) AS order_pct FROM k"""
)
def order_lis(d: Data) -> DataFrame:
    w = d.words()
    return verify.order_fidelity(w, d.twin().withColumn("token_idx", F.col("token_idx").bitwiseXOR(F.lit(1)))).withColumn("order_pct", F.round("order_pct", 9))


@query(
    rf"""WITH p AS (SELECT page_id, html AS a, regexp_replace(html, '<h1>', 'xyz', 'g') AS b FROM pages), bag AS (SELECT page_id, list_distinct(list_filter(string_split_regex(lower(a), '[^\p{{L}}\p{{Nd}}]+'), lambda w: length(w) >= 3)) AS ta, list_distinct(list_filter(string_split_regex(lower(b), '[^\p{{L}}\p{{Nd}}]+'), lambda w: length(w) >= 3)) AS tb, {norm('a')} AS na, {norm('b')} AS nb FROM p),
tri AS (SELECT *, list_distinct(list_transform(range(1, length(na) - 1), lambda i: substr(na, i, 3))) AS ga, list_distinct(list_transform(range(1, length(nb) - 1), lambda i: substr(nb, i, 3))) AS gb FROM bag)
SELECT page_id, round(len(list_intersect(ta, tb)) / len(ta), 9) AS word_recall, round(len(list_intersect(ga, gb)) / len(ga), 9) AS trigram_recall FROM tri"""
)
def set_and_trigram_recall(d: Data) -> DataFrame:
    p = d.table("pages").select("page_id", F.col("html").alias("truth_md"), F.regexp_replace("html", "<h1>", "xyz").alias("got_md"))
    return verify.lane_recall(p).select("page_id", F.round("word_recall", 9).alias("word_recall"), F.round("trigram_recall", 9).alias("trigram_recall"))


LEDGER = "SELECT l_orderkey AS doc_id, CASE l_linenumber % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'blur' WHEN 2 THEN 'fade' ELSE 'noise' END AS variant, CAST(75 + CAST(l_suppkey AS INT) % 3 * 25 AS INT) AS dpi, CAST(1 + l_linenumber % 3 AS INT) AS factor, CAST(l_quantity * 2 AS DOUBLE) AS recall_pct FROM {lineitem}"


@query(f"WITH a AS (SELECT variant, round_even(avg(recall_pct), 4) AS avg_recall, count(*) AS pages FROM ({LEDGER}) x GROUP BY variant) SELECT *, round_even(avg_recall - (SELECT avg_recall FROM a WHERE variant = 'baseline'), 4) AS delta FROM a")
def degradation_ledger(d: Data) -> DataFrame:
    return verify.ledger(d.sql(LEDGER), ["variant"], {"variant": "baseline"})


@query(f"WITH a AS (SELECT dpi, factor, round_even(avg(recall_pct), 4) AS avg_recall, count(*) AS pages FROM ({LEDGER}) x GROUP BY dpi, factor) SELECT a.*, round_even(a.avg_recall - b.avg_recall, 4) AS delta FROM a LEFT JOIN a b ON a.dpi = b.dpi AND b.factor = 1")
def upscale_ledger(d: Data) -> DataFrame:
    return verify.ledger(d.sql(LEDGER), ["dpi", "factor"], {"factor": 1})


@query(f"WITH {I.TOKENS} SELECT CAST(f AS INT) AS floor, *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM (SELECT f, count(*) FILTER (WHERE c >= f AND t) AS tp, count(*) FILTER (WHERE c >= f AND NOT t) AS fp, count(*) FILTER (WHERE c < f AND t) AS fn FROM (SELECT token_idx * 7 % 100 AS c, (doc_id + token_idx) % 5 <> 0 AS t FROM twin) CROSS JOIN range(50, 96, 5) r(f) GROUP BY f)".replace("AS floor, *,", "AS floor, tp, fp, fn,"))
def confidence_sweep(d: Data) -> DataFrame:
    w = d.twin().withColumn("is_true", (F.col("doc_id") + F.col("token_idx")) % 5 != 0)
    return verify.confidence_sweep(w).select("floor", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"SELECT CAST(floor(dpi / 25) * 25 AS INT) AS bucket, count(*) AS pages FROM (SELECT CAST(round_even(least(sample_w / (placed_w / 72.0), sample_h / (placed_h / 72.0)), 0) AS INT) AS dpi FROM ({I.IMAGES}) i) x GROUP BY 1")
def dpi_histogram(d: Data) -> DataFrame:
    i = d.sql(I.IMAGES)
    return verify.dpi_histogram(i.select(F.bround(F.least(F.col("sample_w") / (F.col("placed_w") / 72.0), F.col("sample_h") / (F.col("placed_h") / 72.0))).cast("int").alias("dpi")))


TRUTH_CELLS = "SELECT doc_id, row AS truth_row, text AS cell FROM (" + I.CELLS + ") c WHERE (doc_id + row) % 2 = 0"


@query(
    f"""WITH t AS ({TRUTH_CELLS}), r AS (SELECT doc_id, row, string_agg(text, ' ' ORDER BY col) AS text FROM ({I.CELLS}) c WHERE col < 2 GROUP BY doc_id, row), h AS (SELECT t.doc_id, truth_row, row, count(*) AS n FROM t JOIN r ON t.doc_id = r.doc_id AND contains({norm('r.text')}, {norm('cell')}) GROUP BY ALL), b AS (SELECT doc_id, truth_row, max(n) AS n FROM h GROUP BY ALL)
SELECT a.doc_id, a.truth_row, cells, coalesce(n, 0) AS correct FROM (SELECT doc_id, truth_row, count(*) AS cells FROM t GROUP BY ALL) a LEFT JOIN b USING (doc_id, truth_row)"""
)
def cell_correctness(d: Data) -> DataFrame:
    rows = d.sql(I.CELLS).where("col < 2").groupBy("doc_id", "row").agg(S.in_order(F.col("text"), F.col("col"), separator=" ").alias("text"))
    return verify.cell_correctness(d.sql(TRUTH_CELLS), rows, ["doc_id"])


VERDICTS = "SELECT c_custkey AS id, c_name AS expected, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN substring(c_name, 1, 8) WHEN 2 THEN c_mktsegment WHEN 3 THEN concat(substring(c_name, 1, 16), 'zz') WHEN 4 THEN 'q' ELSE NULL END AS got, c_mktsegment AS other FROM {customer}"


@query(
    f"""WITH v AS (SELECT *, {norm('expected')} AS e, {norm('got')} AS g, {norm('other')} AS o FROM ({VERDICTS}) x), s AS (SELECT *, CASE WHEN g IS NULL THEN NULL ELSE 1 - levenshtein(e, g) / greatest(length(e), length(g)) END AS own FROM v)
SELECT id, round(own, 9) AS similarity, CASE WHEN got IS NULL THEN 'missing' WHEN g <> '' AND (contains(e, g) OR contains(g, e)) THEN CASE WHEN g <> e AND starts_with(e, g) AND length(g) >= 3 THEN 'truncated-source' ELSE 'correct' END WHEN o = g AND own < 0.8 THEN 'cross-field' WHEN own >= 0.5 THEN 'garbled' WHEN g <> '' AND contains(o, g) THEN 'cross-field' ELSE 'wrong-other' END AS verdict FROM s"""
)
def field_verdicts(d: Data) -> DataFrame:
    v = d.sql(VERDICTS).withColumn("others", F.array("other"))
    return verify.verdicts(v).select("id", F.round("similarity", 9).alias("similarity"), "verdict")


@query(
    f"""WITH {I.TOKENS}, nb AS (SELECT doc_id, page_number, token_idx, CAST(floor(y1 / 200) AS INT) AS region_idx, {norm('text')} AS w FROM box), u AS (SELECT doc_id, page_number, w, min(token_idx) AS t FROM nb WHERE length(w) >= 4 GROUP BY ALL HAVING count(*) = 1),
j AS (SELECT r.*, t FROM (SELECT DISTINCT doc_id, page_number, region_idx, w FROM nb) r JOIN u USING (doc_id, page_number, w)), a AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_number) AS n FROM j), m AS (SELECT doc_id, page_number, region_idx, median(t) AS median FROM a WHERE n >= 8 GROUP BY ALL),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page_number) AS c, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY median, region_idx) AS i FROM m) SELECT doc_id, page_number, region_idx, median, CASE WHEN c >= 2 THEN CAST(i AS INT) END AS gold_rank FROM k"""
)
def gold_reading_ranks(d: Data) -> DataFrame:
    w = d.words()
    r = w.withColumn("region_idx", F.floor(F.col("y1") / 200).cast("int"))
    return verify.gold_ranks(r, w)


# Hardware specifications



def _re(pattern: str) -> str:
    return pattern.replace("(?i)", "").replace("'", "''")


def _has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{_re(pattern)}', 'i')"


def _cap(c: str, pattern: str, g: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract({c}, '{_re(pattern)}', {g}, '{flags}'), '')"


_CAPACITY = f"{_cap('text', H.CAPACITY)} || ' ' || upper({_cap('text', H.CAPACITY, 2)})"
_CLOCK = f"{_cap('text', H.CLOCK)} || ' ' || replace(upper({_cap('text', H.CLOCK, 2)}), 'HZ', 'Hz')"
_MEDIUM = "CASE " + " ".join(f"WHEN {_has('text', chr(92) + 'b' + m.replace('.', '[.]') + chr(92) + 'b')} THEN '{m}'" for m in H.MEDIA) + " END"
_ATTRIBUTES = {
    "Processor": (_has("text", H.KEYWORDS["Processor"]), f"nullif(concat_ws(', ', {_cap('text', H.CORES)} || '-core', {_CLOCK}), '')", "NULL"),
    "Memory": (_has("text", H.KEYWORDS["Memory"]), _CAPACITY, f"upper({_cap('text', H.DDR)})"),
    "Storage": (_has("text", H.KEYWORDS["Storage"]), _CAPACITY, _MEDIUM),
    "Graphics": (_has("text", H.KEYWORDS["Graphics"]), _CAPACITY, "NULL"),
    "FormFactor": (f"({_cap('text', H.RACK, 1, 'c')} IS NOT NULL OR {_has('text', H.KEYWORDS['FormFactor'])})", f"{_cap('text', H.RACK, 1, 'c')} || 'U'", "NULL"),
    "PowerSupply": (_has("text", H.KEYWORDS["PowerSupply"]), f"{_cap('text', H.WATT)} || ' W'", "NULL"),
    "Network": (_has("text", H.KEYWORDS["Network"]), "NULL", "NULL"),
    "Display": (_has("text", H.KEYWORDS["Display"]), f"{_cap('text', H.SCREEN)} || '\"'", "NULL"),
    "OperatingSystem": (_has("text", H.KEYWORDS["OperatingSystem"]), "NULL", "NULL"),
    "Warranty": ("(regexp_matches(text, 'warrant(y|ies)', 'i') OR regexp_matches(text, '\\b[0-9]+[- ]?years?\\b[^.]*warrant', 'i'))", f"{_cap('text', H.YEARS)} || '-year'", "NULL"),
}


def _attributes_sql(source: str, keep: str) -> str:
    """Rows of attributes of `text` in source, one SELECT for each category."""
    return " UNION ALL ".join(f"SELECT {keep}, {i} AS pos, '{c}' AS category, text AS raw, CAST({v} AS VARCHAR) AS value, CAST({u} AS VARCHAR) AS unit FROM {source} WHERE {hit}" for i, (c, (hit, v, u)) in enumerate(_ATTRIBUTES.items()))


@query(f"WITH f AS ({I.FRAGMENTS}), a AS ({_attributes_sql('f', 'fragment_id')}) SELECT fragment_id, category, raw, value, unit FROM a")
def spec_attributes(d: Data) -> DataFrame:
    f = d.sql(I.FRAGMENTS).select("fragment_id", F.explode(H.attributes(F.col("text"))).alias("a"))
    return f.select("fragment_id", "a.*")


LINES = "SELECT doc_id, CAST(1 AS INT) AS page_number, CAST(fragment_id AS INT) AS line_no, CASE p_partkey % 3 WHEN 0 THEN concat('- ', text) WHEN 1 THEN concat(CAST(p_partkey % 9 AS STRING), ') ', text) ELSE concat(CASE p_partkey % 4 WHEN 0 THEN 'Processor: ' WHEN 1 THEN 'Memory: ' WHEN 2 THEN 'Model: ' ELSE 'Note to all: ' END, text) END AS text FROM (" + I.FRAGMENTS + ") f"
_BULLETS = rf"""li AS ({LINES}), bu AS (SELECT doc_id, line_no, trim(regexp_replace(regexp_extract(text, '{_re(H.BULLET)}', 1), '\s+', ' ', 'g')) AS text FROM li WHERE regexp_matches(text, '{_re(H.BULLET)}') AND NOT regexp_matches(text, '{_re(H.KEY_VALUE)}')),
ba AS ({_attributes_sql("bu", "doc_id, line_no")})"""


@query(f"WITH {_BULLETS} SELECT b.doc_id, CAST(1000000 + b.line_no AS BIGINT) AS seq, b.text AS description, n AS n_attributes FROM bu b JOIN (SELECT doc_id, line_no, count(*) AS n FROM ba GROUP BY ALL) a USING (doc_id, line_no)")
def spec_bullets(d: Data) -> DataFrame:
    return specs.bullets(d.sql(LINES)).select("doc_id", "seq", "description", F.size("attributes").cast("long").alias("n_attributes"))


_LABELS = "CASE " + " ".join(f"WHEN regexp_matches(label, '^\\s*({'|'.join(w.replace(' ', chr(92) + 's*') for w in p)})\\s*$', 'i') THEN '{c}'" for c, p in H.LABELS) + " END"
_KEYED = rf"""kl AS (SELECT doc_id, line_no, trim(regexp_extract(text, '{_re(H.KEY_VALUE)}', 1)) AS label, trim(regexp_extract(text, '{_re(H.KEY_VALUE)}', 2)) AS text FROM ({LINES}) l), kc AS (SELECT *, {_LABELS} AS category FROM kl WHERE label <> ''), kk AS (SELECT * FROM kc WHERE category IS NOT NULL),
ka AS ({_attributes_sql("kk", "doc_id, line_no, category AS own")}), kv AS (SELECT k.doc_id, k.line_no, k.category, coalesce(a.raw, label || ': ' || text) AS raw, CASE WHEN a.raw IS NULL THEN text ELSE a.value END AS value, a.unit FROM kk k LEFT JOIN ka a ON a.doc_id = k.doc_id AND a.line_no = k.line_no AND a.category = k.category)"""


@query(f"WITH {_KEYED} SELECT * FROM kv")
def spec_key_values(d: Data) -> DataFrame:
    k = specs.key_values(d.sql(LINES))
    return k.select("doc_id", "line_no", "category", F.col("attribute.raw").alias("raw"), F.col("attribute.value").alias("value"), F.col("attribute.unit").alias("unit"))


@query(f"WITH {_KEYED} SELECT doc_id, count(*) AS n_attributes FROM kv GROUP BY doc_id HAVING count(*) >= 2")
def spec_sheets(d: Data) -> DataFrame:
    return specs.spec_sheets(specs.key_values(d.sql(LINES))).select("doc_id", F.size("attributes").cast("long").alias("n_attributes"))


PARTS_TABLE = """
SELECT doc_id, p_partkey % 3 AS table_id, CAST(p_partkey % 20 + 2 AS INT) AS row, CAST(c AS INT) AS col, CASE c WHEN 0 THEN CAST(p_partkey % 50 AS STRING) WHEN 1 THEN text WHEN 2 THEN concat('P', CAST(p_partkey AS STRING)) ELSE 'each' END AS text
FROM (""" + I.FRAGMENTS + """) f CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t
UNION ALL SELECT doc_id, table_id, CAST(1 AS INT), CAST(c AS INT), CASE c WHEN 0 THEN 'Qty' WHEN 1 THEN CASE WHEN doc_id % 4 = 1 THEN 'Text' ELSE 'Item description' END WHEN 2 THEN 'Part No' ELSE 'Unit' END
FROM (SELECT DISTINCT doc_id, p_partkey % 3 AS table_id FROM (""" + I.FRAGMENTS + """) f) h CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t
"""
_TABLE_ROWS = f"""tc AS ({PARTS_TABLE}), tr AS (SELECT doc_id, table_id, row, max(CASE WHEN col = 0 THEN text END) AS q, max(CASE WHEN col = 1 THEN text END) AS b, max(CASE WHEN col = 2 THEN text END) AS p, max(CASE WHEN col = 3 THEN text END) AS u, arg_max(text, length(text) * 10 - col) AS l FROM tc WHERE row > 1 GROUP BY ALL),
td AS (SELECT doc_id, table_id, row, q, p, u, CASE WHEN doc_id % 4 = 1 THEN l ELSE b END AS text FROM tr), ta AS ({_attributes_sql("td", "doc_id, table_id, row")})"""


@query(rf"WITH {_TABLE_ROWS} SELECT t.doc_id, table_id * 1000000 + row AS seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS description, CAST(q AS INT) AS quantity, p AS part_number, u AS unit_of_issue, n AS n_attributes FROM td t JOIN (SELECT doc_id, table_id, row, count(*) AS n FROM ta GROUP BY ALL) a USING (doc_id, table_id, row)")
def spec_table_rows(d: Data) -> DataFrame:
    return specs.table_rows(d.sql(PARTS_TABLE)).select("doc_id", "seq", "description", "quantity", "part_number", "unit_of_issue", F.size("attributes").cast("long").alias("n_attributes"))


def _components(d: Data) -> DataFrame:
    return specs.merge_components(specs.components(d.sql(PARTS_TABLE), d.sql(LINES)))


def _sum_matches(t: str) -> str:
    return ", ".join(f"sum(len(regexp_extract_all({t}, '{_re(p)}', 0, 'i'))) AS {k}" for k, p in H.SYSTEMS.items())


@query(f"WITH f AS ({I.FRAGMENTS}), s AS (SELECT doc_id, {_sum_matches('text')} FROM f GROUP BY doc_id), g AS (SELECT *, greatest({', '.join(H.SYSTEMS)}) AS m FROM s) SELECT doc_id, CASE WHEN m = 0 OR {' + '.join(f'({k} = m)::INT' for k in H.SYSTEMS)} <> 1 THEN 'Unknown' {' '.join(f'WHEN {k} = m THEN ' + repr(k) for k in H.SYSTEMS)} END AS kind FROM g")
def spec_system_kind(d: Data) -> DataFrame:
    f = d.sql(I.FRAGMENTS).select("doc_id", F.col("text").alias("description"), F.array().cast("array<struct<category:string,raw:string,value:string,unit:string>>").alias("attributes"))
    return specs.system_kind(f)


@query(f"WITH f AS ({I.FRAGMENTS}), a AS ({_attributes_sql('f', 'doc_id, fragment_id')}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY (value IS NOT NULL) DESC, length(raw) DESC, fragment_id, pos) AS i FROM a) SELECT doc_id, category, raw, value, unit FROM r WHERE i = 1")
def spec_roll_up(d: Data) -> DataFrame:
    f = d.sql(I.FRAGMENTS).select("doc_id", F.lit(1).alias("strategy"), F.col("fragment_id").alias("seq"), H.attributes(F.col("text")).alias("attributes"))
    return specs.roll_up(f).drop("ord")


_TRIM160 = "CASE WHEN length(trim({0})) <= 160 THEN trim({0}) ELSE rtrim(substr(trim({0}), 1, 160)) || '…' END"
_COMPONENTS = rf"""{_TABLE_ROWS}, {_BULLETS}, {_KEYED},
part AS (
  SELECT doc_id, 1 AS strategy, CAST(table_id * 1000000 + row AS BIGINT) AS seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS description, CAST(q AS INT) AS quantity, p AS part_number, table_id, row AS at FROM td
  UNION ALL SELECT doc_id, 2, CAST(1000000 + line_no AS BIGINT), text, NULL, NULL, 0, line_no FROM bu
  UNION ALL SELECT doc_id, 3, 0, 'System (spec sheet)', NULL, NULL, 0, 0 FROM kv GROUP BY doc_id HAVING count(*) >= 2
), att AS (
  SELECT doc_id, 1 AS strategy, CAST(table_id * 1000000 + row AS BIGINT) AS seq, pos, category, raw, value, unit FROM ta
  UNION ALL SELECT doc_id, 2, CAST(1000000 + line_no AS BIGINT), pos, category, raw, value, unit FROM ba
  UNION ALL SELECT doc_id, 3, 0, line_no, category, raw, value, unit FROM kv
), own AS (SELECT p.*, lower(description) AS norm FROM part p WHERE EXISTS (SELECT 1 FROM att a WHERE a.doc_id = p.doc_id AND a.strategy = p.strategy AND a.seq = p.seq)),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY strategy, seq) AS k FROM own),
com AS (SELECT doc_id, norm, arg_min(strategy, k) AS strategy, arg_min(seq, k) AS seq, arg_max(description, length(description) * 1000 - k) AS description, arg_min(quantity, k) FILTER (WHERE quantity IS NOT NULL) AS quantity, arg_min(part_number, k) FILTER (WHERE part_number IS NOT NULL) AS part_number FROM nth GROUP BY ALL),
uni AS (SELECT n.doc_id, n.norm, n.k, a.pos, a.category, a.raw, a.value, a.unit, row_number() OVER (PARTITION BY n.doc_id, n.norm, a.category, a.value ORDER BY n.k, a.pos) AS again FROM nth n JOIN att a ON a.doc_id = n.doc_id AND a.strategy = n.strategy AND a.seq = n.seq),
mrg AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY k, pos) AS place FROM uni WHERE k = 1 OR again = 1),
txt AS (SELECT doc_id, description AS t FROM com UNION ALL SELECT doc_id, raw FROM mrg), vot AS (SELECT doc_id, {_sum_matches('t')} FROM txt GROUP BY doc_id), best AS (SELECT *, greatest({', '.join(H.SYSTEMS)}) AS m FROM vot),
kind AS (SELECT doc_id, CASE WHEN m = 0 OR {' + '.join(f'({k} = m)::INT' for k in H.SYSTEMS)} <> 1 THEN 'Unknown' {' '.join(f'WHEN {k} = m THEN ' + repr(k) for k in H.SYSTEMS)} END AS kind FROM best),
num AS (SELECT doc_id, count(*) AS n_components, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS total_quantity FROM com GROUP BY doc_id), cat AS (SELECT doc_id, CAST(count(DISTINCT category) AS INT) AS n_categories FROM mrg GROUP BY doc_id),
prof AS (SELECT doc_id, n_components, total_quantity, n_categories, kind, round_even(least(CAST(0.95 AS DOUBLE), CAST(0.4 AS DOUBLE) + CAST(0.08 AS DOUBLE) * n_categories + CAST(0.03 AS DOUBLE) * least(n_components, 6)), 2) AS confidence FROM num JOIN cat USING (doc_id) JOIN kind USING (doc_id))"""


@query(
    f"WITH {_COMPONENTS} SELECT * FROM prof"
)
def spec_profile(d: Data) -> DataFrame:
    return specs.profile(_components(d))


@query(
    f"""WITH {_COMPONENTS}, rol AS (SELECT *, row_number() OVER (PARTITION BY m.doc_id, category ORDER BY (value IS NOT NULL) DESC, length(raw) DESC, c.strategy, c.seq, place) AS i, coalesce(value, {_TRIM160.format('raw')}) AS detail FROM mrg m JOIN com c ON c.doc_id = m.doc_id AND c.norm = m.norm),
spc AS (SELECT doc_id, string_agg(CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in specs.PHRASE.items())} ELSE 'other' END || ': ' || detail || CASE WHEN unit IS NOT NULL AND NOT contains(lower(detail), lower(unit)) THEN ' ' || unit ELSE '' END, '; ' ORDER BY CASE category {' '.join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(H.CATEGORIES))} END) AS specs FROM rol WHERE i = 1 GROUP BY doc_id),
row AS (SELECT doc_id, string_agg('- ' || CASE WHEN quantity IS NOT NULL THEN '**Qty ' || quantity || '** — ' ELSE '' END || {_TRIM160.format('description')} || CASE WHEN part_number IS NOT NULL THEN ' · *part ' || trim(part_number) || '*' ELSE '' END, chr(10) ORDER BY strategy, seq) AS rows FROM com GROUP BY doc_id)
SELECT doc_id, '## Hardware specifications' || chr(10) || chr(10) || 'This document specifies ' || CASE WHEN kind = 'Unknown' THEN 'hardware' ELSE 'a ' || lower(kind) END || CASE WHEN total_quantity > 0 THEN ' (total quantity ' || total_quantity || ')' ELSE '' END || '.' || CASE WHEN n_categories > 0 THEN ' Key specifications: ' || specs || '.' ELSE '' END || chr(10) || chr(10) || rows || chr(10) AS markdown FROM prof JOIN spc USING (doc_id) JOIN row USING (doc_id)"""
)
def spec_section_markdown(d: Data) -> DataFrame:
    return specs.section(_components(d))


# Reading order and composition

REGION_CTE = f"tags AS ({I.TAGS_DUCK}), reg AS ({I.REGIONS})"
MASKED = f"""{REGION_CTE}, med AS (SELECT doc_id, page_number, median(x2 - x1) AS m, count(*) AS n FROM reg GROUP BY ALL),
msk AS (SELECT a.*, n >= 4 AND a.type IN ('Title', 'Table', 'Figure') AND a.x2 - a.x1 > 1.3 * m AND (SELECT count(*) FROM reg b WHERE b.doc_id = a.doc_id AND b.page_number = a.page_number AND b.region_idx <> a.region_idx AND least(a.x2, b.x2) > greatest(a.x1, b.x1)) >= 2 AS masked FROM reg a JOIN med USING (doc_id, page_number))"""


@query(f"WITH {MASKED} SELECT doc_id, page_number, region_idx, type, masked FROM msk")
def region_mask(d: Data) -> DataFrame:
    return order.masked(d.regions()).select(*PAGE, "region_idx", "type", "masked")


@query(f"WITH {MASKED} SELECT doc_id, page_number, region_idx, masked, CAST((SELECT count(*) FROM msk s WHERE s.doc_id = m.doc_id AND s.page_number = m.page_number AND s.masked AND s.y1 + s.y2 < m.y1 + m.y2) AS INT) AS band FROM msk m")
def separator_bands(d: Data) -> DataFrame:
    return order.separator_bands(order.masked(d.regions())).select(*PAGE, "region_idx", "masked", "band")


@query(f"WITH {REGION_CTE}, g AS (SELECT *, CASE WHEN y1 > max(y2) OVER (PARTITION BY doc_id, page_number ORDER BY y1, region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 12 THEN 1 ELSE 0 END AS n FROM reg) SELECT doc_id, page_number, region_idx, CAST(sum(n) OVER (PARTITION BY doc_id, page_number ORDER BY y1, region_idx ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM g")
def gap_bands(d: Data) -> DataFrame:
    return order.gap_bands(d.regions(), "region_idx").select(*PAGE, "region_idx", "band")


@query(f"WITH {REGION_CTE}, g AS (SELECT doc_id, page_number, max(coalesce(y1 - r, 0)) AS w FROM (SELECT *, max(y2) OVER (PARTITION BY doc_id, page_number ORDER BY y1, region_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM reg) GROUP BY ALL) SELECT doc_id, page_number, CASE WHEN w >= 12 THEN w ELSE 0.0 END AS widest FROM g")
def widest_gap(d: Data) -> DataFrame:
    return order.widest_gap(d.regions(), "region_idx")


@query(f"WITH {REGION_CTE}, h AS (SELECT doc_id, page_number, list_sort(list(greatest(1.0, y2 - y1))) AS h FROM reg GROUP BY ALL), g AS (SELECT r.*, CASE WHEN (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER (PARTITION BY r.doc_id, r.page_number ORDER BY (y1 + y2) / 2, region_idx) > 0.8 * h[len(h) // 2 + 1] THEN 1 ELSE 0 END AS n FROM reg r JOIN h USING (doc_id, page_number)) SELECT doc_id, page_number, region_idx, CAST(sum(n) OVER (PARTITION BY doc_id, page_number ORDER BY (y1 + y2) / 2, region_idx ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM g")
def center_bands(d: Data) -> DataFrame:
    return order.center_bands(d.regions(), "region_idx").select(*PAGE, "region_idx", "band")


@query()
def reading_order_xycut(d: Data) -> DataFrame:
    return order.reading_order(d.regions(), "xycut")


@query()
def reading_order_xycutpp(d: Data) -> DataFrame:
    return order.reading_order(d.regions())


@query(
    f"""WITH RECURSIVE {REGION_CTE}, every AS (SELECT * FROM reg UNION ALL SELECT doc_id, page_number, region_idx + 1000, raw_label, type, confidence / 2, x1 + region_idx % 200, y1, x2 + region_idx % 200, y2 FROM reg),
item AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY confidence DESC, region_idx) AS i FROM every),
kept AS (SELECT DISTINCT doc_id, page_number, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(l VARCHAR, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS ks, FALSE AS stays FROM item
  UNION ALL SELECT doc_id, page_number, i, CASE WHEN free THEN ks || [struct_pack(l := raw_label, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] ELSE ks END, free FROM (SELECT t.*, k.ks, len(list_filter(k.ks, lambda q: q.l = t.raw_label AND least(q.x2, t.x2) > greatest(q.x1, t.x1) AND least(q.y2, t.y2) > greatest(q.y1, t.y1)
    AND (least(q.x2, t.x2) - greatest(q.x1, t.x1)) * (least(q.y2, t.y2) - greatest(q.y1, t.y1)) > 0.7 * least((q.x2 - q.x1) * (q.y2 - q.y1), (t.x2 - t.x1) * (t.y2 - t.y1)))) = 0 AS free FROM kept k JOIN item t ON t.doc_id = k.doc_id AND t.page_number = k.page_number AND t.i = k.i + 1) f)
SELECT t.* EXCLUDE (i), CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY i) - 1 AS INT) AS kept_rank FROM item t JOIN kept k USING (doc_id, page_number, i) WHERE k.stays"""
)
def nms_regions(d: Data) -> DataFrame:
    r = d.regions()
    twin = r.withColumns({"region_idx": F.col("region_idx") + 1000, "x1": F.col("x1") + F.col("region_idx") % 200, "x2": F.col("x2") + F.col("region_idx") % 200, "confidence": F.col("confidence") / 2})
    return order.suppress_duplicates(r.unionByName(twin))


NUMBERED = "SELECT l_orderkey AS doc_id, CAST(1 AS INT) AS page_number, CAST(l_linenumber AS INT) AS region_idx, CAST(l_linenumber - 1 AS INT) AS reading_rank, CASE WHEN l_orderkey % 3 = 0 THEN concat(CAST((n - l_linenumber + 1) AS STRING), '. item') WHEN l_orderkey % 3 = 1 THEN concat(CAST((l_linenumber * 2) AS STRING), ') item') ELSE concat(CAST(l_linenumber AS STRING), '.5 item') END AS top_text FROM (SELECT l_orderkey, r AS l_linenumber, MAX(r) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, DENSE_RANK() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM {lineitem}) y) x"


@query(f"WITH r AS ({NUMBERED}), n AS (SELECT *, TRY_CAST(nullif(regexp_extract(top_text, '^\\s*([0-9]{{1,3}})[.)]\\s', 1), '') AS INT) AS k FROM r), s AS (SELECT *, count(k) OVER p AS c, max(k) OVER p AS hi, min(k) OVER p AS lo, count(DISTINCT k) OVER p AS u FROM n WINDOW p AS (PARTITION BY doc_id, page_number)) SELECT doc_id, page_number, region_idx, top_text, CASE WHEN k IS NOT NULL AND c >= 3 AND lo = 1 AND hi = c AND u = c THEN k - 1 ELSE reading_rank END AS reading_rank FROM s")
def enumerator_reorder(d: Data) -> DataFrame:
    return order.enumerators(d.sql(NUMBERED))


def _page_lines(d: Data) -> DataFrame:
    """A line in every region, one beside it, one below all."""
    r = d.regions()
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    body = r.select(*PAGE, "region_idx", k.alias("k"), "x1", "y1")
    x1 = F.col("x1") + 5 + F.col("k") * F.when(F.col("region_idx") % 4 == 0, 2000).otherwise(100)
    lines = body.select(*PAGE, (F.col("region_idx") * 2 + F.col("k")).alias("line_idx"), F.concat(F.lit("line "), F.col("region_idx").cast("string"), F.lit("|"), F.col("k").cast("string")).alias("text"), x1.alias("x1"), (F.col("y1") + 3).alias("y1"), (x1 + 80).alias("x2"), (F.col("y1") + 19).alias("y2"))
    return lines


PAGE_LINES = "pl AS (SELECT doc_id, page_number, region_idx * 2 + k AS line_idx, 'line ' || region_idx || '|' || k AS text, x1 + 5 + k * CASE WHEN region_idx % 4 = 0 THEN 2000 ELSE 100 END AS x1, y1 + 3 AS y1, x1 + 85 + k * CASE WHEN region_idx % 4 = 0 THEN 2000 ELSE 100 END AS x2, y1 + 19 AS y2 FROM reg CROSS JOIN (VALUES (0), (1)) t(k))"
CLAIM = f"WITH {REGION_CTE}, {PAGE_LINES}, own AS (SELECT l.doc_id, l.page_number, l.line_idx, r.region_idx, row_number() OVER (PARTITION BY l.doc_id, l.page_number, l.line_idx ORDER BY CASE r.type WHEN 'Table' THEN 0 WHEN 'Title' THEN 1 ELSE 2 END, r.region_idx) AS i FROM pl l JOIN reg r ON r.doc_id = l.doc_id AND r.page_number = l.page_number AND (l.x1 + l.x2) / 2 BETWEEN r.x1 AND r.x2 AND (l.y1 + l.y2) / 2 BETWEEN r.y1 AND r.y2)"


@query(f"{CLAIM} SELECT l.doc_id, l.page_number, l.line_idx, o.region_idx FROM pl l LEFT JOIN own o ON o.doc_id = l.doc_id AND o.page_number = l.page_number AND o.line_idx = l.line_idx AND o.i = 1")
def line_claim(d: Data) -> DataFrame:
    return compose.claim(_page_lines(d), d.regions().withColumn("reading_rank", F.col("region_idx"))).select(*PAGE, "line_idx", "region_idx")


@query(f"{CLAIM} SELECT l.doc_id, l.page_number, l.line_idx, l.text FROM pl l WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = l.doc_id AND o.page_number = l.page_number AND o.line_idx = l.line_idx)")
def orphan_lines(d: Data) -> DataFrame:
    return compose.orphans(compose.claim(_page_lines(d), d.regions().withColumn("reading_rank", F.col("region_idx")))).select(*PAGE, "line_idx", "text")


@query()
def page_markdown(d: Data) -> DataFrame:
    return compose.compose_pages(_page_lines(d), order.reading_order(d.regions()))


@query("SELECT conv_id AS doc_id, string_agg(CASE WHEN turn = 0 THEN '' ELSE '---' || chr(10) || chr(10) END || '<!-- page ' || (turn + 1) || ' -->' || chr(10) || chr(10) || text, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def document_markdown(d: Data) -> DataFrame:
    return S.document_markdown(d.table("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), F.col("text").alias("markdown")))


@query("SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE (conv_id + turn) % 4 <> 2 AND trim(text) <> '') AS markdown FROM conversations GROUP BY conv_id")
def merged_markdown(d: Data) -> DataFrame:
    """Some pages are white space alone: line ends, a no-break space, an ideographic space."""
    text = F.when((F.col("conv_id") + F.col("turn")) % 4 == 2, F.lit("\n\u00a0\u3000\r\n")).otherwise(F.col("text"))
    return S.merged_markdown(d.table("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_number"), text.alias("markdown")))


CELL_CTE = f"cel AS MATERIALIZED ({I.CELLS}), cli AS MATERIALIZED ({I.CELL_LINES}), hit AS MATERIALIZED (SELECT c.doc_id, c.page_number, c.region_idx, c.row, c.col, l.line_idx, l.text, l.y1, l.x1 FROM cel c JOIN cli l ON c.doc_id = l.doc_id AND c.page_number = l.page_number AND c.region_idx = l.region_idx AND (l.x1 + l.x2) / 2 BETWEEN c.x1 AND c.x2 AND (l.y1 + l.y2) / 2 BETWEEN c.y1 AND c.y2)"


def _cells(d: Data) -> DataFrame:
    return d.sql(I.CELLS).drop("text")


@query(f"WITH {CELL_CTE} SELECT c.doc_id, c.page_number, c.region_idx, c.row, c.col, coalesce(string_agg(h.text, ' ' ORDER BY h.y1, h.x1, h.line_idx), '') AS text, count(h.line_idx) AS n_lines FROM cel c LEFT JOIN hit h USING (doc_id, page_number, region_idx, row, col) GROUP BY ALL")
def table_cells(d: Data) -> DataFrame:
    return compose.fill_cells(_cells(d), d.sql(I.CELL_LINES)).select(*compose.TABLE, "row", "col", "text", "n_lines")


@query(f"WITH {CELL_CTE}, held AS (SELECT DISTINCT doc_id, page_number, region_idx, line_idx FROM hit) SELECT l.doc_id, l.page_number, l.region_idx, l.line_idx, l.text FROM cli l ANTI JOIN held h USING (doc_id, page_number, region_idx, line_idx)")
def unassigned_lines(d: Data) -> DataFrame:
    return compose.unassigned(_cells(d), d.sql(I.CELL_LINES)).select(*compose.TABLE, "line_idx", "text")


@query(f"WITH {CELL_CTE}, held AS (SELECT DISTINCT doc_id, page_number, region_idx, line_idx, TRUE AS is_held FROM hit), t AS (SELECT doc_id, page_number, region_idx, sum(length(text)) AS total, sum(CASE WHEN is_held IS NULL THEN length(text) ELSE 0 END) AS lost FROM cli l LEFT JOIN held USING (doc_id, page_number, region_idx, line_idx) GROUP BY ALL) SELECT doc_id, page_number, region_idx, 3 AS n_cols, round(lost / total, 9) AS unassigned_share, lost / total <= 0.25 AS fits FROM t")
def grid_fit(d: Data) -> DataFrame:
    return compose.grid_fits(_cells(d), d.sql(I.CELL_LINES)).withColumn("unassigned_share", F.round("unassigned_share", 9))


@query(f"WITH c AS ({I.CELLS}), r AS (SELECT doc_id, page_number, region_idx, row, '| ' || string_agg(replace(text, '|', '\\|'), ' | ' ORDER BY col) || ' |' AS t FROM c GROUP BY ALL), n AS (SELECT doc_id, page_number, region_idx, max(row) AS m FROM r GROUP BY ALL), g AS (SELECT n.doc_id, n.page_number, n.region_idx, i AS row FROM n, range(0, m + 1) x(i)) SELECT g.doc_id, g.page_number, g.region_idx, string_agg(coalesce(t, '|  |  |  |') || CASE WHEN g.row = 0 THEN chr(10) || '|---|---|---|' ELSE '' END, chr(10) ORDER BY g.row) AS markdown FROM g LEFT JOIN r USING (doc_id, page_number, region_idx, row) GROUP BY ALL")
def grid_markdown(d: Data) -> DataFrame:
    return compose.grid_markdown(d.sql(I.CELLS))


_TAB = "doc_id, page_number, region_idx"
FEDERAL = f"""cel AS ({I.CELLS}), cli AS ({I.CELL_LINES}), rr AS (SELECT {_TAB}, row, min(y1) AS ry1, max(y2) AS ry2 FROM cel GROUP BY ALL), cc AS (SELECT {_TAB}, row, col, min(x1) AS cx1, max(x2) AS cx2 FROM cel GROUP BY ALL),
ins AS (SELECT l.*, r.row, (l.y1 + l.y2) / 2 AS cy FROM cli l JOIN rr r USING ({_TAB}) WHERE r.row > 0 AND (l.y1 + l.y2) / 2 BETWEEN ry1 - 0.5 AND ry2 + 0.5), hh AS (SELECT {_TAB}, row, list_sort(list(greatest(1.0, y2 - y1))) AS h FROM ins GROUP BY ALL),
cut AS (SELECT i.*, CASE WHEN cy - lag(cy) OVER (PARTITION BY {_TAB}, row ORDER BY cy, line_idx) > 0.8 * h[len(h) // 2 + 1] THEN 1 ELSE 0 END AS c FROM ins i JOIN hh USING ({_TAB}, row)), bnd AS (SELECT *, CAST(sum(c) OVER (PARTITION BY {_TAB}, row ORDER BY cy, line_idx) AS INT) AS band FROM cut),
plc AS (SELECT b.doc_id, b.page_number, b.region_idx, b.row, b.line_idx, b.text, b.x1, b.band, min(c.col) AS col FROM bnd b LEFT JOIN cc c ON c.doc_id = b.doc_id AND c.page_number = b.page_number AND c.region_idx = b.region_idx AND c.row = b.row AND (b.x1 + b.x2) / 2 BETWEEN cx1 AND cx2 GROUP BY ALL),
per AS (SELECT {_TAB}, row, col, count(DISTINCT band) AS b FROM plc WHERE col IS NOT NULL GROUP BY ALL), mul AS (SELECT {_TAB}, row FROM per GROUP BY ALL HAVING count(*) FILTER (WHERE b >= 2) >= 2), spl AS (SELECT {_TAB}, row FROM plc JOIN mul USING ({_TAB}, row) GROUP BY ALL HAVING count(DISTINCT band) >= 2),
fed AS (SELECT {_TAB}, row, 0 AS part, col, text FROM cel ANTI JOIN spl USING ({_TAB}, row) UNION ALL SELECT {_TAB}, row, band, col, string_agg(text, ' ' ORDER BY x1, line_idx) FROM plc JOIN spl USING ({_TAB}, row) WHERE col IS NOT NULL GROUP BY ALL)"""


@query(
    f"WITH {FEDERAL} SELECT doc_id, page_number, region_idx, row, part, col, text FROM fed"
)
def federal_rows(d: Data) -> DataFrame:
    """Rows of tables whose cells hold two text rows each come apart."""
    return compose.expand_rows(d.sql(I.CELLS), d.sql(I.CELL_LINES))


@query(
    f"""WITH {FEDERAL}, num AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, page_number, region_idx ORDER BY row, part) - 1 AS i FROM fed), sz AS (SELECT doc_id, page_number, region_idx, max(i) AS mi, max(col) AS mc FROM num GROUP BY ALL),
g AS (SELECT s.doc_id, s.page_number, s.region_idx, r.i, c.c FROM sz s, LATERAL (SELECT unnest(range(0, mi + 1)) AS i) r, LATERAL (SELECT unnest(range(0, mc + 1)) AS c) c),
l AS (SELECT g.doc_id, g.page_number, g.region_idx, g.i, '| ' || string_agg(coalesce(replace(text, '|', '\\|'), ''), ' | ' ORDER BY g.c) || ' |' || CASE WHEN g.i = 0 THEN chr(10) || '|' || repeat('---|', CAST(count(*) AS INT)) ELSE '' END AS t FROM g LEFT JOIN num n ON n.doc_id = g.doc_id AND n.page_number = g.page_number AND n.region_idx = g.region_idx AND n.i = g.i AND n.col = g.c GROUP BY g.doc_id, g.page_number, g.region_idx, g.i)
SELECT doc_id, page_number, region_idx, string_agg(t, chr(10) ORDER BY i) AS markdown FROM l GROUP BY ALL"""
)
def federal_markdown(d: Data) -> DataFrame:
    return compose.split_markdown(d.sql(I.CELLS), d.sql(I.CELL_LINES))


# Forms

FOUND = f"fl AS ({I.FORM_LINES}), sp AS ({I.PROFILE_ROWS}), fh AS (SELECT l.*, s.profile, s.profile_idx, s.spec_idx, s.name, s.label, s.kind, s.anchor, row_number() OVER (PARTITION BY doc_id, page_number, profile, spec_idx ORDER BY length({norm('text')}), line_idx) AS i FROM fl l JOIN sp s ON contains({norm('l.text')}, {norm('s.label')})), fd AS (SELECT * FROM fh WHERE i = 1), hb AS (SELECT doc_id, page_number, profile, profile_idx, count(*) AS hits FROM fd GROUP BY ALL), bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY hits DESC, profile_idx) AS i FROM hb) WHERE i = 1 AND hits >= 2)"


def _specs(d: Data) -> tuple[DataFrame, DataFrame]:
    s = d.sql(I.PROFILE_ROWS)
    return s.drop("profile_idx"), s.select("profile", "profile_idx").distinct()


@query(f"WITH {FOUND} SELECT doc_id, page_number, profile, hits FROM bp")
def profile_match(d: Data) -> DataFrame:
    s, names = _specs(d)
    return forms.best_profile(forms.labels_found(d.sql(I.FORM_LINES), s), names)


_ROW = "abs((l.y1 + l.y2) - (a.y1 + a.y2)) / 2 < 0.6 * greatest(1, a.y2 - a.y1)"
_AN = r"regexp_matches(l.text, '[\p{L}\p{Nd}]')"


@query(
    rf"""WITH {FOUND}, a AS (SELECT f.* FROM fd f JOIN bp b USING (doc_id, page_number, profile)), v AS (SELECT a.*,
  nullif(trim(regexp_extract(text, array_to_string(list_filter(list_transform(string_split(label, ' '), lambda w: regexp_replace(w, '[^\p{{L}}\p{{Nd}}]', '', 'g')), lambda w: w <> ''), '\W+') || '\W*(.+)$', 1, 'i')), '') AS inl,
  (SELECT arg_min(l.text, l.x1 * 1000 + l.line_idx) FROM fl l WHERE l.doc_id = a.doc_id AND l.line_idx <> a.line_idx AND {_ROW} AND l.x1 >= a.x2 - 2 AND {_AN}) AS rt,
  (SELECT arg_min(l.text, l.y1 * 1000 + l.line_idx) FROM fl l WHERE l.doc_id = a.doc_id AND l.line_idx <> a.line_idx AND l.y1 >= a.y2 - 1 AND l.y1 - a.y2 < 2.5 * greatest(1, a.y2 - a.y1) AND least(l.x2, a.x2) > greatest(l.x1, a.x1) AND {_AN}) AS bl,
  EXISTS (SELECT 1 FROM fl l WHERE l.doc_id = a.doc_id AND {_ROW} AND l.x2 <= a.x1 + 0.5 * greatest(1, a.y2 - a.y1) AND a.x1 - l.x2 < 12 * greatest(1, a.y2 - a.y1) AND regexp_matches(l.text, '(^|[^0-9A-Za-z])[xX☒✓✗]([^0-9A-Za-z]|$)')) AS mk FROM a),
w AS (SELECT *, CASE WHEN kind = 'Checkbox' THEN CASE WHEN mk THEN 'checked' ELSE 'unchecked' END ELSE coalesce(CASE WHEN regexp_matches(inl, '[\p{{L}}\p{{Nd}}]') THEN inl END, CASE WHEN anchor IN ('Right', 'RightThenBelow') THEN rt END, CASE WHEN anchor IN ('Below', 'RightThenBelow') THEN bl END) END AS value FROM v)
SELECT doc_id, page_number, profile, spec_idx, name, kind, trim(value) AS value, CAST(0.8 AS DOUBLE) AS confidence FROM w WHERE trim(value) <> ''"""
)
def geometric_fields(d: Data) -> DataFrame:
    return forms.geometric_fields(d.sql(I.FORM_LINES), *_specs(d))


_H = "greatest(1, w.y2 - w.y1)"
_WROW = f"abs((l.y1 + l.y2) - (w.y1 + w.y2)) / 2 < 0.7 * {_H}"


@query(
    rf"""WITH fl AS ({I.FORM_LINES}), wi AS ({I.WIDGETS}), lb AS (SELECT * FROM fl l WHERE regexp_matches(text, '\p{{L}}') AND NOT EXISTS (SELECT 1 FROM wi w WHERE w.doc_id = l.doc_id AND (l.x1 + l.x2) / 2 BETWEEN w.x1 AND w.x2 AND (l.y1 + l.y2) / 2 BETWEEN w.y1 AND w.y2))
SELECT doc_id, page_number, widget_idx, value, coalesce(
  (SELECT arg_min(trim(l.text), l.x1 * 1000 + l.line_idx) FROM lb l WHERE l.doc_id = w.doc_id AND w.kind = 'Checkbox' AND {_WROW} AND l.x1 >= w.x2 - 0.5 * {_H}),
  (SELECT arg_min(trim(l.text), -l.x2 * 1000 + l.line_idx) FROM lb l WHERE l.doc_id = w.doc_id AND {_WROW} AND l.x2 <= w.x1 + 0.5 * {_H}),
  (SELECT arg_min(trim(l.text), -l.y2 * 1000 + l.line_idx) FROM lb l WHERE l.doc_id = w.doc_id AND l.y2 <= w.y1 + 0.5 * {_H} AND w.y1 - l.y2 < 2.5 * {_H} AND least(l.x2, w.x2) > greatest(l.x1, w.x1)), '') AS label FROM wi w"""
)
def widget_labels(d: Data) -> DataFrame:
    return forms.widget_labels(d.sql(I.WIDGETS), d.sql(I.FORM_LINES)).select(*PAGE, "widget_idx", "value", "label")


@query(
    f"""WITH p AS (SELECT DISTINCT * FROM ({I.SIGNATURES}) x), t AS ({I.TEMPLATE_TOKENS}), j AS (SELECT p.doc_id, p.page_number, t.template_id, t.template_idx, t.page, count(*) AS k FROM p JOIN t USING (token) GROUP BY ALL), s AS (SELECT j.*, k / ((SELECT count(*) FROM p WHERE p.doc_id = j.doc_id) + (SELECT count(*) FROM t WHERE t.template_id = j.template_id) - k) AS score FROM j)
SELECT doc_id, page_number, template_id, page AS template_page, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY score DESC, template_idx, page) AS i FROM s WHERE score >= 0.85) WHERE i = 1"""
)
def template_jaccard(d: Data) -> DataFrame:
    return forms.signature_match(d.sql(I.SIGNATURES), d.sql(I.TEMPLATE_TOKENS)).withColumn("score", F.round("score", 9))


def _fractions(d: Data) -> DataFrame:
    return d.sql(I.FORM_LINES).withColumns({"cx": (F.col("x1") + F.col("x2")) / 1200, "cy": (F.col("y1") + F.col("y2")) / 900})


_TOK = "list_distinct(list_filter(string_split_regex(upper({0}), '[\\s.,:;()/\\-''\"&]+'), lambda w: length(w) >= 4 AND regexp_matches(w, '\\p{{L}}')))"
FRACTIONS = f"fr AS (SELECT *, (x1 + x2) / 1200 AS cx, (y1 + y2) / 900 AS cy FROM ({I.FORM_LINES}) f), el AS (SELECT * FROM ({I.ELEMENTS}) e)"


@query(
    f"""WITH {FRACTIONS}, an AS (SELECT *, {_TOK.format('label')} AS toks FROM el), ok AS (SELECT * FROM an WHERE len(toks) > 0), h AS (SELECT o.*, EXISTS (SELECT 1 FROM fr l, unnest(o.toks) u(t) WHERE l.doc_id = o.doc_id AND abs(l.cx - (o.x1 + o.x2) / 2) <= 0.05 AND abs(l.cy - (o.y1 + o.y2) / 2) <= 0.05 AND contains(upper(l.text), t)) AS hit FROM ok o)
SELECT doc_id, page_number, template_id, count(*) AS n_anchors, count(*) FILTER (WHERE hit) AS aligned, round(count(*) FILTER (WHERE hit) / count(*), 9) AS share, count(*) >= 5 AND count(*) FILTER (WHERE hit) / count(*) >= 0.15 AS is_match FROM h GROUP BY ALL"""
)
def anchor_verify(d: Data) -> DataFrame:
    return forms.anchor_check(d.sql(I.ELEMENTS), _fractions(d), least=0.15, anchors=5).withColumn("share", F.round("share", 9))


@query(
    rf"""WITH {FRACTIONS}, m AS (SELECT l.doc_id, l.page_number, l.line_idx, l.text, l.y1, l.x1, e.element_idx, CASE WHEN e.label = '' THEN '(unlabeled)' ELSE e.label END AS label, row_number() OVER (PARTITION BY l.doc_id, l.line_idx ORDER BY (l.cx - (e.x1 + e.x2) / 2) ** 2 + (l.cy - (e.y1 + e.y2) / 2) ** 2, e.element_idx) AS i FROM fr l JOIN el e ON e.doc_id = l.doc_id AND e.kind <> 'Checkbox' AND l.cx BETWEEN e.x1 AND e.x2 AND l.cy BETWEEN e.y1 AND e.y2),
k AS (SELECT *, {_TOK.format('text')} AS vt, {_TOK.format('label')} AS lt FROM m WHERE i = 1), p AS (SELECT doc_id, page_number, element_idx, label, trim(regexp_replace(string_agg(text, ' ' ORDER BY y1, x1, line_idx), '\s+', ' ', 'g')) AS value FROM k WHERE NOT (len(vt) > 0 AND len(list_filter(vt, lambda w: NOT list_contains(lt, w))) = 0) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, lower(label), lower(value) ORDER BY element_idx) AS i FROM p WHERE (length(value) >= 2 AND regexp_matches(value, '\p{{L}}')) OR len(regexp_extract_all(value, '\p{{Nd}}')) >= 2) SELECT doc_id, page_number, element_idx, label AS name, value FROM f WHERE i = 1"""
)
def scanned_fields(d: Data) -> DataFrame:
    return forms.scanned_fields(d.sql(I.ELEMENTS), _fractions(d))


@query(
    f"""WITH RECURSIVE wi AS ({I.WIDGETS}), el AS (SELECT doc_id, page_number, widget_idx, kind, 'label ' || widget_idx AS label, x1 + 0.004 AS x1, y1 + 0.004 AS y1, x2 + 0.004 AS x2, y2 + 0.004 AS y2, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY widget_idx) AS i FROM wi),
near AS (SELECT e.doc_id, e.page_number, e.i, e.widget_idx AS element_idx, e.kind, e.label, coalesce(list(w.widget_idx ORDER BY ((e.x1 + e.x2) / 2 - (w.x1 + w.x2) / 2) ** 2 + ((e.y1 + e.y2) / 2 - (w.y1 + w.y2) / 2) ** 2, w.widget_idx) FILTER (WHERE w.widget_idx IS NOT NULL), []) AS ws
  FROM el e LEFT JOIN wi w ON w.doc_id = e.doc_id AND w.page_number = e.page_number AND (w.x1 + w.x2) / 2 BETWEEN e.x1 - 0.01 AND e.x2 + 0.01 AND (w.y1 + w.y2) / 2 BETWEEN e.y1 - 0.01 AND e.y2 + 0.01 AND (e.x1 + e.x2) / 2 BETWEEN w.x1 - 0.01 AND w.x2 + 0.01 AND (e.y1 + e.y2) / 2 BETWEEN w.y1 - 0.01 AND w.y2 + 0.01 GROUP BY ALL),
pick AS (SELECT DISTINCT doc_id, page_number, CAST(0 AS BIGINT) AS i, CAST([] AS INT[]) AS used, CAST(NULL AS INT) AS w FROM el
  UNION ALL SELECT n.doc_id, n.page_number, n.i, list_filter(used || [free], lambda x: x IS NOT NULL), free FROM (SELECT n.*, p.used, list_filter(n.ws, lambda x: NOT list_contains(p.used, x))[1] AS free FROM pick p JOIN near n ON n.doc_id = p.doc_id AND n.page_number = p.page_number AND n.i = p.i + 1) n)
SELECT n.doc_id, CAST(n.page_number AS INT) AS page_number, CAST(element_idx AS INT) AS element_idx, CAST(w AS INT) AS widget_idx, n.kind, label AS name, CASE WHEN n.kind = 'Checkbox' THEN label ELSE trim(v.value) END AS value
FROM pick k JOIN near n ON n.doc_id = k.doc_id AND n.page_number = k.page_number AND n.i = k.i JOIN wi v ON v.doc_id = k.doc_id AND v.page_number = k.page_number AND v.widget_idx = k.w WHERE CASE WHEN n.kind = 'Checkbox' THEN v.value = 'X' ELSE trim(v.value) <> '' END"""
)
def template_bind(d: Data) -> DataFrame:
    w = d.sql(I.WIDGETS)
    e = w.select(*PAGE, F.col("widget_idx").alias("element_idx"), "kind", F.concat(F.lit("label "), F.col("widget_idx").cast("string")).alias("label"), F.lit(None).cast("string").alias("grp"), *[(F.col(c) + 0.004).alias(c) for c in ("x1", "y1", "x2", "y2")])
    return forms.bind_template(e, w.withColumn("is_on", F.col("value") == "X"))


REGISTRY = "SELECT CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE n_name END AS template_id, concat('b', n_name) AS name, CAST(1 AS INT) AS version FROM {nation} WHERE n_nationkey < 18"
CUSTOMER_REGISTRY = "SELECT lower(n_name) AS template_id, concat('c', n_name) AS name, CAST(2 AS INT) AS version FROM {nation} WHERE n_nationkey >= 10"


@query(f"SELECT coalesce(c.template_id, b.template_id) AS template_id, coalesce(c.name, b.name) AS name, coalesce(c.version, b.version) AS version, CASE WHEN c.template_id IS NOT NULL THEN 'customer' ELSE 'bundled' END AS origin FROM ({REGISTRY}) b FULL OUTER JOIN ({CUSTOMER_REGISTRY}) c ON lower(b.template_id) = lower(c.template_id)")
def registry_merge(d: Data) -> DataFrame:
    return forms.merge_registries(d.sql(REGISTRY), d.sql(CUSTOMER_REGISTRY))


STORE = "SELECT CAST(p_size AS STRING) AS template_id, CAST(p_partkey AS BIGINT) AS version, p_name AS name, p_partkey % 10 = 0 AS deleted FROM {part}"


@query(f"SELECT template_id, version, name, deleted FROM (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY version DESC) AS i FROM ({STORE}) s) WHERE i = 1 AND NOT deleted")
def template_store_upsert(d: Data) -> DataFrame:
    s = d.sql(STORE)
    return forms.upsert(s.where("version < 100"), s.where("version >= 100"))


@query(f"WITH e AS ({I.ELEMENTS}), t AS (SELECT doc_id, page || ':' || kind || ':' || CAST(round_even((x1 + x2) / 2 * 1000, 0) AS INT) || ':' || CAST(round_even((y1 + y2) / 2 * 1000, 0) AS INT) AS k FROM e) SELECT CAST(doc_id AS VARCHAR) AS template_id, sha256(string_agg(k, '|' ORDER BY k)) AS fingerprint FROM t GROUP BY doc_id")
def layout_fingerprint(d: Data) -> DataFrame:
    return forms.fingerprint(d.sql(I.ELEMENTS).withColumn("template_id", F.col("doc_id").cast("string")))


DESIGNATIONS = "SELECT conv_id AS doc_id, CAST(1 AS INT) AS page_number, CAST(turn AS INT) AS line_idx, CASE (conv_id + turn) % 5 WHEN 0 THEN concat('Standard Form ', CAST(30 + conv_id % 4 AS STRING), 'a (REV. 4/20', CAST(10 + conv_id % 15 AS STRING), ')') WHEN 1 THEN 'OPTIONAL  FORM 336' WHEN 2 THEN 'SF 30' ELSE substring(text, 1, 50) END AS text FROM {conversations}"


@query(
    f"""WITH l AS ({DESIGNATIONS}), x AS (SELECT *, nullif(upper(regexp_extract(text, '\\b(?:OPTIONAL|STANDARD)\\s+FORM\\s+([0-9]+[A-Z]?)', 1, 'i')), '') AS g, nullif(regexp_extract(text, '\\bREV\\.?\\s*\\(?[0-9]{{1,2}}/([0-9]{{4}})', 1, 'i'), '') AS r FROM l)
SELECT doc_id, arg_min(g, line_idx) FILTER (WHERE g IS NOT NULL) AS designation, arg_min(r, line_idx) FILTER (WHERE r IS NOT NULL) AS revision_year FROM x GROUP BY doc_id"""
)
def form_designation(d: Data) -> DataFrame:
    g, r = X.form_designation(F.col("text")), X.revision_year(F.col("text"))
    at = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_idx")))
    return d.sql(DESIGNATIONS).groupBy("doc_id").agg(at(g).alias("designation"), at(r).alias("revision_year"))


FORM_IDS = "SELECT CAST(i AS INT) AS template_idx, t AS template_id FROM (VALUES (0, 'SF30-16'), (1, 'SF30A-20'), (2, 'sf31'), (3, 'SF336-05'), (4, 'SF33A'), (5, 'SF33')) v(i, t)"


@query(f"WITH f AS (SELECT DISTINCT CAST(30 + conv_id % 4 AS VARCHAR) || CASE WHEN conv_id % 2 = 0 THEN 'A' ELSE '' END AS designation, conv_id AS doc_id FROM conversations), r AS ({FORM_IDS}) SELECT doc_id, designation, arg_min(template_id, template_idx) AS template_id FROM f JOIN r ON starts_with(upper(template_id), 'SF' || designation) AND NOT regexp_matches(substr(upper(template_id), length(designation) + 3, 1), '[A-Z0-9]') GROUP BY ALL")
def template_by_designation(d: Data) -> DataFrame:
    f = d.table("conversations").select(F.col("conv_id").alias("doc_id"), F.concat((F.col("conv_id") % 4 + 30).cast("string"), F.when(F.col("conv_id") % 2 == 0, "A").otherwise("")).alias("designation")).distinct()
    return forms.by_designation(f, d.sql(FORM_IDS))


SPANS = "SELECT doc_id, page_number, line_idx AS span_idx, CASE WHEN line_idx % 2 = 0 THEN 'Key' ELSE 'Value' END AS kind, text, CAST(line_idx * 10 + 5 AS DOUBLE) / 100 AS confidence, x1, y1, x2, y2 FROM (" + I.FORM_LINES + ") f"


@query(
    f"""WITH s AS ({SPANS}), p AS (SELECT v.doc_id, v.page_number, v.span_idx, k.text AS kt, k.confidence AS kc, k.span_idx AS ki, CASE WHEN (k.y1 + k.y2) / 2 BETWEEN v.y1 - (v.y2 - v.y1) AND v.y2 + (v.y2 - v.y1) AND k.x2 <= v.x1 + 0.25 * (v.x2 - v.x1) THEN greatest(0, v.x1 - k.x2) WHEN k.y2 <= v.y1 + 0.5 * (v.y2 - v.y1) AND k.x2 >= v.x1 - (k.x2 - k.x1) AND k.x1 <= v.x2 THEN greatest(0, v.y1 - k.y2) + 0.25 * abs(k.x1 - v.x1) END AS dist FROM s v JOIN s k ON k.doc_id = v.doc_id AND k.kind = 'Key' AND v.kind = 'Value'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, span_idx ORDER BY dist, ki) AS i FROM p WHERE dist <= 0.35 * 600) WHERE i = 1)
SELECT s.doc_id, s.page_number, s.span_idx, kt AS key, s.text AS value, coalesce(least(s.confidence, kc), s.confidence) AS confidence FROM s LEFT JOIN b USING (doc_id, page_number, span_idx) WHERE s.kind = 'Value'"""
)
def learned_pairing(d: Data) -> DataFrame:
    return forms.pair_values(d.sql(SPANS), 600.0)


_LETTER = r"regexp_matches(w.text, '\p{L}')"


@query(
    f"""WITH s AS ({SPANS}), p AS (SELECT v.doc_id, v.page_number, v.span_idx, k.text AS kt, k.confidence AS kc, k.span_idx AS ki, CASE WHEN (k.y1 + k.y2) / 2 BETWEEN v.y1 - (v.y2 - v.y1) AND v.y2 + (v.y2 - v.y1) AND k.x2 <= v.x1 + 0.25 * (v.x2 - v.x1) THEN greatest(0, v.x1 - k.x2) WHEN k.y2 <= v.y1 + 0.5 * (v.y2 - v.y1) AND k.x2 >= v.x1 - (k.x2 - k.x1) AND k.x1 <= v.x2 THEN greatest(0, v.y1 - k.y2) + 0.25 * abs(k.x1 - v.x1) END AS dist FROM s v JOIN s k ON k.doc_id = v.doc_id AND k.kind = 'Key' AND v.kind = 'Value'),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, span_idx ORDER BY dist, ki) AS i FROM p WHERE dist <= 0.35 * 60) WHERE i = 1), v AS (SELECT s.*, greatest(1.0, s.y2 - s.y1) AS h FROM s ANTI JOIN b USING (doc_id, span_idx) WHERE kind = 'Value'),
lw AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM ({I.FORM_LINES}) f), e AS (SELECT *, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS k FROM lw),
u AS (SELECT *, greatest(1, x2 - x1) / greatest(1, list_sum(list_transform(ws, lambda x: length(x))) + len(ws) - 1) AS unit, coalesce(list_sum(list_transform(ws[1:k], lambda x: length(x) + 1)), 0) AS before FROM e),
w AS (SELECT doc_id, line_idx * 1000 + k AS word_idx, word AS text, x1 + before * unit AS x1, y1, least(x1 + before * unit + length(word) * unit, x2) AS x2, y2 FROM u WHERE line_idx % 2 = 0),
le AS (SELECT v.doc_id, v.span_idx, v.h, w.*, row_number() OVER o AS i, coalesce(lag(w.x1) OVER o, v.x1) - w.x2 AS gap FROM v JOIN w ON w.doc_id = v.doc_id AND {_LETTER} AND abs((w.y1 + w.y2) / 2 - (v.y1 + v.y2) / 2) <= 0.8 * greatest(h, w.y2 - w.y1) AND w.x2 <= v.x1 + 0.25 * h WINDOW o AS (PARTITION BY v.doc_id, v.span_idx ORDER BY w.x2 DESC, w.word_idx)),
ru AS (SELECT *, max(CASE WHEN gap > 2 * h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, span_idx ORDER BY i) AS cut FROM le), rt AS (SELECT doc_id, span_idx, text, row_number() OVER (PARTITION BY doc_id, span_idx ORDER BY i DESC) AS n FROM ru WHERE cut = 0),
ab AS (SELECT v.doc_id, v.span_idx, v.h, w.*, max(w.y2) OVER (PARTITION BY v.doc_id, v.span_idx) AS low FROM v JOIN w ON w.doc_id = v.doc_id AND {_LETTER} AND w.y2 <= v.y1 + 0.5 * h AND w.x2 >= v.x1 - 2 * h AND w.x1 <= v.x2 + 2 * h AND v.y1 - w.y2 <= 3.5 * h),
abn AS (SELECT doc_id, span_idx, text, row_number() OVER (PARTITION BY doc_id, span_idx ORDER BY x1, y2 DESC, word_idx) AS n FROM ab WHERE low - y2 <= 0.8 * h),
nm AS (SELECT doc_id, span_idx, string_agg(text, ' ' ORDER BY n) AS t FROM rt WHERE n <= 10 GROUP BY ALL UNION ALL SELECT doc_id, span_idx, string_agg(text, ' ' ORDER BY n) FROM abn ANTI JOIN rt USING (doc_id, span_idx) WHERE n <= 10 GROUP BY ALL)
SELECT s.doc_id, s.page_number, s.span_idx, coalesce(b.kt, nullif(regexp_replace(trim(nm.t), '[:.-]+$', ''), '')) AS key, s.text AS value, coalesce(least(s.confidence, kc), s.confidence) AS confidence FROM s LEFT JOIN b USING (doc_id, span_idx) LEFT JOIN nm USING (doc_id, span_idx) WHERE s.kind = 'Value'"""
)
def learned_key_fallback(d: Data) -> DataFrame:
    """Values beyond the reach of a learned key take the words printed left of them or above."""
    w = forms.word_boxes(d.sql(I.FORM_LINES))
    w = w.select(*PAGE, (F.col("line_idx") * 1000 + F.col("word_idx")).alias("word_idx"), "text", (F.col("line_idx") % 2 == 1).alias("in_value"), "x1", "y1", "x2", "y2")
    return forms.pair_values(d.sql(SPANS), 60.0, words=w)


BIO = "SELECT l_orderkey AS doc_id, CAST(1 AS INT) AS page_number, CAST(l_linenumber AS INT) AS word_idx, CASE CAST(MAX(l_quantity) AS INT) % 7 WHEN 0 THEN 'B-KEY' WHEN 1 THEN 'I-KEY' WHEN 2 THEN 'B-VALUE' WHEN 3 THEN 'I-VALUE' WHEN 4 THEN 'VALUE' WHEN 5 THEN 'O' ELSE 'I-VALUE' END AS label, CAST(MAX(l_discount) AS DOUBLE) AS prob FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


@query(
    f"""WITH b AS ({BIO}), t AS (SELECT *, CASE WHEN label = 'O' THEN NULL WHEN ends_with(label, 'KEY') THEN 'Key' ELSE 'Value' END AS kind, label LIKE 'I-%' OR label = 'VALUE' AS more FROM b), c AS (SELECT *, CASE WHEN more AND lag(word_idx) OVER w = word_idx - 1 AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY word_idx)),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_number ORDER BY word_idx) AS span FROM c) SELECT doc_id, page_number, kind, min(word_idx) AS first_word, max(word_idx) AS last_word, count(*) AS n_words, round(avg(prob), 9) AS confidence FROM g WHERE kind IS NOT NULL GROUP BY doc_id, page_number, span, kind"""
)
def bio_decode(d: Data) -> DataFrame:
    return forms.bio_spans(d.sql(BIO)).withColumn("confidence", F.round("confidence", 9))


@query(
    f"""WITH w AS (SELECT *, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM ({I.FORM_LINES}) f), e AS (SELECT *, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS word_idx FROM w),
u AS (SELECT *, greatest(1, x2 - x1) / greatest(1, list_sum(list_transform(ws, lambda x: length(x))) + len(ws) - 1) AS unit, coalesce(list_sum(list_transform(ws[1:word_idx], lambda x: length(x) + 1)), 0) AS before FROM e)
SELECT doc_id, page_number, line_idx, word_idx, word AS text, round(x1 + before * unit, 6) AS x1, y1, round(least(x1 + before * unit + length(word) * unit, x2), 6) AS x2, y2 FROM u"""
)
def proportional_word_boxes(d: Data) -> DataFrame:
    return forms.word_boxes(d.sql(I.FORM_LINES)).withColumns({"x1": F.round("x1", 6), "x2": F.round("x2", 6)})


@query(f"WITH {I.TOKENS}, n AS (SELECT doc_id, page_number, count(*) AS k FROM box GROUP BY ALL) SELECT doc_id, page_number, CAST(w AS INT) AS window, CAST(w * 72 AS INT) AS first_word, CAST(least(w * 72 + 96, k) - 1 AS INT) AS last_word FROM n, range(0, greatest(0, CAST(ceil((k - 96) / 72) AS BIGINT)) + 1) r(w)")
def sliding_windows(d: Data) -> DataFrame:
    return forms.token_windows(d.words().groupBy(*PAGE).agg(F.count("*").alias("n_words")), size=96)


# Shaping

SHAPED = "SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, repeat(text, 60) AS markdown, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'CUI' END AS marking, CASE WHEN turn = 3 THEN NULL ELSE CAST(90 + (conv_id * 7 + turn) % 10 AS DOUBLE) + 0.25 END AS recall_pct, turn % 2 = 1 AS needs_review, CAST(turn AS DOUBLE) / 4 AS seconds FROM {conversations}"


@query(
    f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total_pages FROM ({SHAPED}) x), w AS (SELECT *, least(2, greatest(1, total_pages)) AS from_page FROM s), k AS (SELECT *, CASE WHEN marking IS NOT NULL THEN '[withheld: page marked ''' || marking || ''']' ELSE markdown END AS md, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS i FROM w WHERE page_number >= from_page)
SELECT doc_id, page_number, total_pages, from_page, CASE WHEN length(md) > 20000 THEN substr(md, 1, 20000) || ' …[truncated]' ELSE md END AS markdown, length(md) > 20000 AS truncated, round_even(recall_pct, 1) AS recall_pct, needs_review, marking FROM k WHERE i <= 3"""
)
def result_window(d: Data) -> DataFrame:
    return shape.page_window(d.sql(SHAPED), start=2, count=3, block=True)


@query(
    f"""SELECT doc_id, count(*) AS pages, round_even(avg(recall_pct), 1) AS avg_recall, coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (WHERE needs_review), '') AS review_pages, coalesce(string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) FILTER (WHERE marking IS NOT NULL), '') AS marked_pages, round_even(sum(seconds), 2) AS seconds,
CASE WHEN length(string_agg(markdown, chr(10) || chr(10) ORDER BY page_number)) > 40000 THEN substr(string_agg(markdown, chr(10) || chr(10) ORDER BY page_number), 1, 40000) || ' …[truncated]' ELSE string_agg(markdown, chr(10) || chr(10) ORDER BY page_number) END AS markdown, length(string_agg(markdown, chr(10) || chr(10) ORDER BY page_number)) > 40000 AS truncated FROM ({SHAPED}) x GROUP BY doc_id"""
)
def result_summary(d: Data) -> DataFrame:
    return shape.summary(d.sql(SHAPED))


@query(f"SELECT doc_id, page_number, CASE WHEN marking IS NOT NULL THEN '[withheld: page marked ''' || marking || ''']' ELSE markdown END AS markdown FROM ({SHAPED}) x")
def redaction(d: Data) -> DataFrame:
    return d.sql(SHAPED).select(*PAGE, shape.redacted(F.col("markdown"), F.col("marking"), True).alias("markdown"))


@query(f"SELECT doc_id, page_number, field_idx, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, field_idx) AS i FROM ({I.FIELDS}) f) WHERE i <= 2")
def field_dto(d: Data) -> DataFrame:
    return shape.capped_fields(d.sql(I.FIELDS), 2).select(*PAGE, "field_idx", "value")


@query(f"SELECT doc_id, page_number, recall_pct FROM ({SHAPED}) x WHERE recall_pct IS NOT NULL ORDER BY recall_pct, doc_id, page_number LIMIT 10")
def top_offenders(d: Data) -> DataFrame:
    return shape.top_offenders(d.sql(SHAPED).select(*PAGE, "recall_pct"))


@query(
    f"""SELECT doc_id, '[' || string_agg('{{"pageNumber":' || page_number || coalesce(',"recallPct":' || recall_pct, '') || ',"needsReview":' || needs_review || coalesce(',"sensitivityMarking":"' || marking || '"', '') || '}}', ',' ORDER BY page_number) || ']' AS json FROM ({SHAPED}) x GROUP BY doc_id"""
)
def json_export(d: Data) -> DataFrame:
    return S.page_json(d.sql(SHAPED).select(*PAGE, "recall_pct", "needs_review", F.col("marking").alias("sensitivity_marking")))


@query(
    "SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 20"
)
def seeded_sample(d: Data) -> DataFrame:
    return shape.seeded_sample(d.table("documents").select("doc_id"), "doc_id", 20)


POINTS = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS l, CAST(p_size + 10 AS DOUBLE) AS r, CAST(700 - p_size AS DOUBLE) AS b, CAST(720 - p_size AS DOUBLE) AS t FROM {part}"


@query(f"SELECT id, l * 300 / 72 AS x1, (792 - t) * 300 / 72 AS y1, r * 300 / 72 AS x2, (792 - b) * 300 / 72 AS y2, CAST(least(greatest(round_even(l * 1000 / 612, 0), 0), 1000) AS INT) AS gx FROM ({POINTS}) p")
def point_to_raster(d: Data) -> DataFrame:
    box = from_points(F.col("l"), F.col("b"), F.col("r"), F.col("t"), F.lit(792.0), F.lit(300.0))
    return d.sql(POINTS).select("id", *box.columns(), to_grid(F.col("l"), F.lit(612)).alias("gx"))



@query(
    f"""WITH RECURSIVE {REGION_CTE}, pr AS (SELECT t.doc_id, t.page_number, t.region_idx AS truth_idx, p.region_idx AS pred_idx, (least(t.x2, p.x2 + 20) - greatest(t.x1, p.x1 + 20)) * (least(t.y2, p.y2) - greatest(t.y1, p.y1)) / least((t.x2 - t.x1) * (t.y2 - t.y1), (p.x2 - p.x1) * (p.y2 - p.y1)) AS overlap, {norm('t.raw_label')} AS tv, {norm('p.type')} AS pv
  FROM reg t JOIN reg p ON p.doc_id = t.doc_id AND p.page_number = t.page_number AND least(t.x2, p.x2 + 20) > greatest(t.x1, p.x1 + 20) AND least(t.y2, p.y2) > greatest(t.y1, p.y1)),
sc AS (SELECT *, CAST(floor(overlap / 0.05) AS INT) AS bucket, contains(tv, pv) OR contains(pv, tv) AS value_match FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY bucket DESC, value_match DESC, overlap DESC, truth_idx, pred_idx) AS i FROM sc),
go AS (SELECT DISTINCT doc_id, page_number, CAST(0 AS BIGINT) AS i, CAST([] AS INT[]) AS ts, CAST([] AS INT[]) AS ps, FALSE AS took FROM rk
  UNION ALL SELECT doc_id, page_number, i, CASE WHEN free THEN ts || [truth_idx] ELSE ts END, CASE WHEN free THEN ps || [pred_idx] ELSE ps END, free FROM (SELECT r.*, g.ts, g.ps, NOT list_contains(g.ts, r.truth_idx) AND NOT list_contains(g.ps, r.pred_idx) AS free FROM go g JOIN rk r ON r.doc_id = g.doc_id AND r.page_number = g.page_number AND r.i = g.i + 1) f)
SELECT doc_id, page_number, truth_idx, pred_idx, round(overlap, 9) AS overlap, bucket, value_match FROM rk JOIN go USING (doc_id, page_number, i) WHERE took"""
)
def truth_pairing(d: Data) -> DataFrame:
    r = d.regions()
    cols = [*PAGE, "x1", "y1", "x2", "y2"]
    t = r.select(*cols, F.col("region_idx").alias("truth_idx"), F.col("raw_label").alias("value"))
    p = r.select(*PAGE, (F.col("x1") + 20).alias("x1"), "y1", (F.col("x2") + 20).alias("x2"), "y2", F.col("region_idx").alias("pred_idx"), F.col("type").alias("value"))
    return forms.pair_truth(t, p).withColumn("overlap", F.round("overlap", 9))


# The whole way


@query(
    f"""WITH {I.TOKENS}, {SPLICED}, tw AS (SELECT doc_id, page_number, count(*) FILTER (WHERE length({norm('text')}) >= 3) AS n FROM spl GROUP BY ALL),
im AS (SELECT *, CAST(round_even(least(sample_w / (placed_w / 72.0), sample_h / (placed_h / 72.0)), 0) AS INT) AS d, placed_w * placed_h / (page_w * page_h) AS cover FROM ({I.IMAGES}) i),
dp AS (SELECT doc_id, page_number, arg_max(d, cover * 1000 + image_idx * 0.0001) FILTER (WHERE cover >= 0.5) AS dpi, least(1.0, sum(CASE WHEN cover >= 0.01 THEN cover ELSE 0 END)) AS coverage FROM im GROUP BY ALL),
k AS (SELECT t.doc_id, t.page_number, n, dpi, coalesce(coverage, 0) AS coverage, coalesce(word_count >= 5 AND dropped_fraction <= 0.3 AND undecodable_fraction <= 0.2, FALSE) AS ok, coalesce(undecodable_fraction <= 0.2, FALSE) AS sound FROM tw t LEFT JOIN quality q USING (doc_id, page_number) LEFT JOIN dp USING (doc_id, page_number))
SELECT doc_id, page_number, CASE WHEN ok THEN 'TextLayer' ELSE 'Ocr' END AS source, CASE WHEN NOT ok THEN dpi END AS effective_dpi, coalesce(NOT ok AND dpi < 150, FALSE) AS low_resolution, CASE WHEN sound THEN n ELSE 0 END AS truth_words, CASE WHEN ok THEN n ELSE 0 END AS truth_found, CASE WHEN ok THEN coverage >= 0.1 ELSE NOT sound OR n = 0 END AS needs_review, CAST(0 AS BIGINT) AS lines_lost FROM k"""
)
def process_documents(d: Data) -> DataFrame:
    """Documents with a text layer of mixed worth and images behind it, through all of process(); no layout, no readings."""
    w = _spliced(d)
    pages = w.groupBy(*PAGE).agg(F.lit(1000).alias("width_px"), F.lit(S.PAGE_HEIGHT).alias("height_px"))
    r = process(Corpus(pages=pages, words=w, images=d.sql(I.IMAGES)))
    return r.pages.select(*PAGE, "source", "effective_dpi", "low_resolution", "truth_words", "truth_found", "needs_review", "lines_lost")
