"""Inputs that stand in for scanned documents, derived from the driver's tables in SQL that both engines read.

{name} in a text is a table: parquet.`path` for Spark, the registered view for the oracle. Word geometry has its own
DataFrame operator (sources.tables.token_boxes) and its own SQL here, TOKENS.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import degraded, token_boxes

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: One page for each order line: class, confidence, rulings, as an outside engine would say.
SIGNALS = """
SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS page_number,
  CASE (l_partkey + l_linenumber) % 9 WHEN 0 THEN 'digital_text' WHEN 1 THEN 'form' WHEN 2 THEN 'empty' WHEN 3 THEN 'table_or_complex'
    WHEN 4 THEN 'scanned_image' WHEN 5 THEN 'scanned_ocr' WHEN 6 THEN 'digital_text' WHEN 7 THEN 'other' ELSE 'digital_text' END AS class,
  CAST((l_suppkey * 37 + l_linenumber * 11) % 100 AS DOUBLE) / 100 AS confidence,
  CAST(l_partkey % 12 AS INT) AS rulings
FROM (SELECT l_orderkey, l_linenumber, MAX(l_partkey) AS l_partkey, MAX(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x
"""
#: Their documents: one in 40 was not processed, one in 29 is an XFA form; 25 more of three pages have no signal at all.
DOCUMENTS = """
SELECT doc_id, CASE WHEN doc_id % 40 = 7 THEN 'Failed' ELSE 'Processed' END AS status, doc_id % 29 = 3 AS has_xfa, CAST(MAX(page_number) AS BIGINT) AS page_count
FROM (""" + SIGNALS + """) s GROUP BY doc_id
UNION ALL SELECT CAST(-1 - n_nationkey AS BIGINT), 'Processed', FALSE, CAST(3 AS BIGINT) FROM {nation}
"""
#: Images placed on pages of 612 by 792 points.
IMAGES = """
SELECT l_orderkey AS doc_id, CAST(1 + l_linenumber % 2 AS INT) AS page_number, CAST(l_linenumber AS INT) AS image_idx,
  CAST(50 + l_partkey % 6 * 112 AS DOUBLE) AS placed_w, CAST(40 + l_suppkey % 5 * 188 AS DOUBLE) AS placed_h,
  CAST(l_quantity * 50 AS INT) AS sample_w, CAST(l_quantity * 60 AS INT) AS sample_h, CAST(612 AS DOUBLE) AS page_w, CAST(792 AS DOUBLE) AS page_h
FROM (SELECT l_orderkey, l_linenumber, MAX(l_partkey) AS l_partkey, MAX(l_suppkey) AS l_suppkey, MAX(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x
"""
#: A page's lines in a band, a marking on some.
BANNERS = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, CAST(0 AS INT) AS line_idx, conv_id % 5 = 0 AS is_furniture,
  CASE (conv_id * 3 + turn) % 16 WHEN 0 THEN 'CUI' WHEN 1 THEN 'SECRET//NOFORN' WHEN 2 THEN 'TOP SECRET' WHEN 3 THEN 'CONFIDENTIAL' WHEN 4 THEN 'Confidential'
    WHEN 5 THEN 'CUI//SP-PRVCY' WHEN 6 THEN 'FOUO' WHEN 7 THEN 'Distribution Statement C. Authorized to agencies and their contractors only, for reasons that take more than eighty letters'
    WHEN 8 THEN 'distribution statement a: public' WHEN 9 THEN 'Controlled by: office' WHEN 10 THEN 'the secret to our success' WHEN 11 THEN 'CIRCUIT' WHEN 12 THEN 'SBU' WHEN 13 THEN 'law enforcement sensitive'
    ELSE substring(text, 1, 60) END AS text,
  CAST(CASE WHEN turn % 3 = 0 THEN 10 WHEN turn % 3 = 1 THEN 1150 ELSE 600 END AS DOUBLE) AS y1, CAST(CASE WHEN turn % 3 = 0 THEN 30 WHEN turn % 3 = 1 THEN 1170 ELSE 620 END AS DOUBLE) AS y2, CAST(1200 AS INT) AS height_px
FROM {conversations}
UNION ALL
SELECT conv_id, CAST(turn + 1 AS INT), CAST(1 AS INT), FALSE, CASE WHEN turn % 2 = 0 THEN 'CUI' ELSE 'page ' END, CAST(1160 AS DOUBLE), CAST(1180 AS DOUBLE), CAST(1200 AS INT) FROM {conversations}
"""
#: Reading attempts of pages.
ATTEMPTS = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, CAST(a AS INT) AS attempt_no, CAST((conv_id + turn * 3 + a * a * 5) % 7 AS BIGINT) AS words, (conv_id + turn) % 3 <> 0 AS low_resolution
FROM {conversations} CROSS JOIN (SELECT 0 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) t
"""
#: Lines as read in four rotations.
ROTATED = """
SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_number, CAST(r AS INT) AS rotation, text,
  CAST(((conv_id * 7 + turn * 5 + r) % 13) * 7 AS DOUBLE) / 100 AS confidence
FROM {conversations} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 90 UNION ALL SELECT 180 UNION ALL SELECT 270) t
"""
#: Parts as fragments of parts lists, twenty a list.
FRAGMENTS = """
SELECT p_partkey AS fragment_id, CAST(FLOOR(p_partkey / 20) AS BIGINT) AS doc_id, p_partkey,
  CASE p_partkey % 11
    WHEN 0 THEN concat('Intel Xeon processor ', CAST(p_size AS STRING), '-core ', CAST(p_size % 4 + 1 AS STRING), '.5ghz')
    WHEN 1 THEN concat(CAST(p_size * 2 AS STRING), 'gb ddr4 ECC memory, 2-year warranty')
    WHEN 2 THEN concat('Storage: ', CAST(p_size AS STRING), ' TB ', CASE p_partkey % 7 WHEN 0 THEN 'hdd' WHEN 1 THEN 'SATA SSD' WHEN 2 THEN 'NVMe' WHEN 3 THEN 'sas' ELSE 'disk' END)
    WHEN 3 THEN concat('GPU RTX ', CAST(p_size AS STRING), 'GB vram')
    WHEN 4 THEN concat(CAST(p_size % 5 + 1 AS STRING), 'U rackmount server chassis')
    WHEN 5 THEN concat('Redundant power supply ', CAST(p_size * 20 AS STRING), 'W')
    WHEN 6 THEN '10 GbE network card SFP+'
    WHEN 7 THEN concat(CAST(p_size % 20 + 13 AS STRING), '-inch UHD monitor')
    WHEN 8 THEN 'Windows 11 operating system'
    WHEN 9 THEN concat('workstation tower ', p_name)
    ELSE concat(p_name, ' ', p_brand, ' ', CAST(p_size AS STRING), ' GB') END AS text
FROM {part}
"""
#: Table cells of each order: a header row, then one row a line.
CELLS = """
SELECT l_orderkey AS doc_id, CAST(1 AS INT) AS page_number, CAST(0 AS INT) AS region_idx, CAST(r AS INT) AS row, CAST(c AS INT) AS col,
  CAST(c * 100 AS DOUBLE) AS x1, CAST(r * 40 AS DOUBLE) AS y1, CAST(c * 100 + 95 AS DOUBLE) AS x2, CAST(r * 40 + 38 AS DOUBLE) AS y2,
  CASE c WHEN 0 THEN concat('part ', CAST(l_partkey AS STRING)) WHEN 1 THEN concat('a|', CAST(CAST(l_quantity AS INT) AS STRING)) ELSE l_returnflag END AS text
FROM (SELECT l_orderkey, MIN(l_partkey) AS l_partkey, MIN(l_quantity) AS l_quantity, MIN(l_returnflag) AS l_returnflag, l_linenumber - 1 AS r FROM {lineitem} GROUP BY l_orderkey, l_linenumber) x
CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) t
"""
#: Lines of those tables: two a cell, some of them outside any cell.
CELL_LINES = """
SELECT doc_id, page_number, region_idx, CAST(row * 100 + col * 10 + k AS INT) AS line_idx, CASE WHEN k = 0 THEN text ELSE concat('n', CAST(row AS STRING)) END AS text,
  x1 + 5 + CASE WHEN (doc_id + row) % 5 = 0 AND k = 1 THEN 400 ELSE 0 END AS x1, y1 + 2 + k * 18 AS y1,
  x1 + 60 + CASE WHEN (doc_id + row) % 5 = 0 AND k = 1 THEN 400 ELSE 0 END AS x2, y1 + 12 + k * 18 AS y2
FROM (""" + CELLS + """) c CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t WHERE NOT ((doc_id + row + col) % 3 = 0 AND k = 1)
"""
#: Fields of customers' forms.
FIELDS = """
SELECT c_custkey AS doc_id, CAST(1 AS INT) AS page_number, CAST(i AS INT) AS field_idx,
  CASE WHEN i = 0 THEN 'form.name' WHEN i = 1 THEN '' ELSE NULL END AS qualified_name, CASE WHEN i = 1 THEN 'segment' ELSE ' ' END AS partial_name, CASE WHEN i = 2 THEN 'Active' ELSE NULL END AS label,
  CASE WHEN i = 2 THEN 'Button' ELSE 'Text' END AS field_type, CASE WHEN i = 0 THEN c_name WHEN i = 1 AND c_custkey % 4 <> 0 THEN c_mktsegment WHEN i = 1 THEN '  ' ELSE 'x' END AS value, c_acctbal > 0 AS is_checked
FROM {customer} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t
"""
#: Lines of filled forms, from customers: labels and values by place.
FORM_LINES = """
SELECT c_custkey AS doc_id, CAST(1 AS INT) AS page_number, CAST(i AS INT) AS line_idx,
  CASE i WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN concat('ORDER NO. ', CAST(c_custkey AS STRING)) ELSE 'Order No.' END WHEN 1 THEN concat('A-', CAST(c_custkey AS STRING)) WHEN 2 THEN 'Name of buyer:' WHEN 3 THEN c_name
    WHEN 4 THEN CASE WHEN c_custkey % 4 = 1 THEN 'Grand sum' ELSE 'Total amount' END WHEN 5 THEN CAST(CAST(FLOOR(c_acctbal) AS INT) AS STRING) WHEN 6 THEN 'Rush delivery' WHEN 7 THEN CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE '-' END ELSE c_mktsegment END AS text,
  CAST(CASE i WHEN 0 THEN 10 WHEN 1 THEN 200 WHEN 2 THEN 10 WHEN 3 THEN 12 WHEN 4 THEN 10 WHEN 5 THEN CASE WHEN c_custkey % 5 = 0 THEN 15 ELSE 300 END WHEN 6 THEN 60 WHEN 7 THEN 20 ELSE 500 END AS DOUBLE) AS x1,
  CAST(CASE i WHEN 0 THEN 10 WHEN 1 THEN 12 WHEN 2 THEN 50 WHEN 3 THEN 75 WHEN 4 THEN 120 WHEN 5 THEN CASE WHEN c_custkey % 5 = 0 THEN 145 ELSE 121 END WHEN 6 THEN 200 WHEN 7 THEN 202 ELSE 400 END AS DOUBLE) AS y1,
  CAST(CASE i WHEN 0 THEN 150 WHEN 1 THEN 290 WHEN 2 THEN 160 WHEN 3 THEN 180 WHEN 4 THEN 150 WHEN 5 THEN CASE WHEN c_custkey % 5 = 0 THEN 90 ELSE 360 END WHEN 6 THEN 190 WHEN 7 THEN 32 ELSE 590 END AS DOUBLE) AS x2,
  CAST(CASE i WHEN 0 THEN 30 WHEN 1 THEN 32 WHEN 2 THEN 70 WHEN 3 THEN 95 WHEN 4 THEN 140 WHEN 5 THEN CASE WHEN c_custkey % 5 = 0 THEN 165 ELSE 141 END WHEN 6 THEN 220 WHEN 7 THEN 222 ELSE 420 END AS DOUBLE) AS y2
FROM {customer} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8) t
"""
PROFILE_ROWS = """
SELECT profile, CAST(profile_idx AS INT) AS profile_idx, CAST(spec_idx AS INT) AS spec_idx, name, label, kind, anchor FROM (VALUES
  ('order-form', 0, 0, 'order_no', 'Order No', 'Text', 'Right'), ('order-form', 0, 1, 'buyer', 'Name of Buyer', 'Text', 'Below'),
  ('order-form', 0, 2, 'total', 'Total Amount', 'Text', 'RightThenBelow'), ('order-form', 0, 3, 'rush', 'Rush Delivery', 'Checkbox', 'Mark'),
  ('grant-form', 1, 0, 'grant_no', 'Grant Number', 'Text', 'Right'), ('grant-form', 1, 1, 'office', 'Order No', 'Text', 'Below')
) AS t(profile, profile_idx, spec_idx, name, label, kind, anchor)
"""
#: Widgets over those forms.
WIDGETS = """
SELECT doc_id, page_number, CAST(line_idx AS INT) AS widget_idx, CASE WHEN line_idx = 7 THEN 'Checkbox' ELSE 'Text' END AS kind, text AS value, x1 - 2 AS x1, y1 - 1 AS y1, x2 + 2 AS x2, y2 + 1 AS y2
FROM (""" + FORM_LINES + """) f WHERE line_idx IN (1, 3, 5, 7)
"""
#: Widget signatures: pages of customers against invented templates.
SIGNATURES = """
SELECT c_custkey AS doc_id, CAST(1 AS INT) AS page_number, concat('Text:', CAST(k AS STRING), ':', CAST(k * k % 17 AS STRING)) AS token
FROM {customer} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11) t
WHERE (c_custkey + k) % (c_custkey % 9 + 4) <> 0
"""
TEMPLATE_TOKENS = """
SELECT template_id, CAST(template_idx AS INT) AS template_idx, CAST(1 AS INT) AS page, concat('Text:', CAST(k AS STRING), ':', CAST(k * k % 17 AS STRING)) AS token
FROM (VALUES ('T-wide', 0, 12), ('T-less', 1, 10), ('T-few', 2, 8)) AS a(template_id, template_idx, n)
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11) t WHERE k < n
"""
#: Elements of one invented template, tried on every form page (fractions of 600 by 450).
ELEMENTS = """
SELECT d.doc_id, CAST(1 AS INT) AS page_number, template_id, CAST(element_idx AS INT) AS element_idx, kind, CAST(1 AS INT) AS page, label, CAST(NULL AS STRING) AS grp, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2
FROM (VALUES ('ORD-24', 0, 'Text', 'ORDER NUMBER', 0.0, 0.0, 0.3, 0.09), ('ORD-24', 1, 'Text', 'buyer', 0.0, 0.1, 0.35, 0.25), ('ORD-24', 2, 'Text', 'Total Amount', 0.0, 0.25, 0.7, 0.4), ('ORD-24', 3, 'Text', '', 0.3, 0.0, 0.6, 0.12), ('ORD-24', 4, 'Text', 'Name', 0.0, 0.08, 0.4, 0.3), ('ORD-24', 5, 'Checkbox', 'Rush Delivery', 0.0, 0.4, 0.1, 0.6), ('ORD-24', 6, 'Text', 'Delivery', 0.05, 0.42, 0.4, 0.5)) AS t(template_id, element_idx, kind, label, x1, y1, x2, y2)
CROSS JOIN (SELECT c_custkey AS doc_id FROM {customer}) d
"""
#: Regions of web pages: their tags in order, on a three-column grid.
REGIONS = """
SELECT doc_id, page_number, region_idx, tag AS raw_label,
  CASE WHEN tag IN ('nav', 'footer') THEN 'PageFurniture' WHEN tag = 'h1' THEN 'Title' WHEN region_idx % 11 = 6 THEN 'Table' WHEN region_idx % 13 = 7 THEN 'Figure' ELSE 'Text' END AS type,
  CAST((region_idx * 29 + doc_id) % 100 AS DOUBLE) / 100 AS confidence,
  CAST((region_idx + doc_id) % 3 * 350 AS DOUBLE) AS x1, CAST(FLOOR(region_idx / 3) * 45 + region_idx % 2 * 6 AS DOUBLE) AS y1,
  CAST((region_idx + doc_id) % 3 * 350 + CASE WHEN tag = 'h1' OR region_idx % 11 = 6 THEN 800 ELSE 280 + region_idx * 7 % 50 END AS DOUBLE) AS x2, CAST(FLOOR(region_idx / 3) * 45 + region_idx % 2 * 6 + 25 AS DOUBLE) AS y2
FROM tags
"""
TAGS_SPARK = "SELECT page_id AS doc_id, CAST(1 AS INT) AS page_number, CAST(i AS INT) AS region_idx, tag FROM (SELECT page_id, posexplode(regexp_extract_all(html, '<(h1|p|li|nav|footer)[ >]', 1)) AS (i, tag) FROM {pages})"
TAGS_DUCK = "SELECT doc_id, 1 AS page_number, CAST(generate_subscripts(t, 1) - 1 AS INT) AS region_idx, unnest(t) AS tag FROM (SELECT page_id AS doc_id, regexp_extract_all(html, '<(h1|p|li|nav|footer)[ >]', 1) AS t FROM pages)"

#: Word geometry for the oracle.
TOKENS = r"""
tok AS (
  SELECT doc_id, unnest(ws) AS text, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS token_idx
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
), box AS (
  SELECT doc_id, CAST(token_idx // 400 + 1 AS INT) AS page_number, token_idx, text, x AS x1, y AS y1, x + 10 * length(text) AS x2, y + 20 AS y2
  FROM (SELECT *, CAST(10 * coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id, token_idx // 10 ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      + CASE WHEN doc_id % 3 = 0 AND token_idx % 10 >= 5 THEN 200 ELSE 0 END AS DOUBLE) AS x, CAST(30 * (token_idx // 10 % 40) AS DOUBLE) AS y FROM tok)
), twin AS (
  SELECT *, CAST(token_idx * 7 % 100 AS DOUBLE) / 100 AS confidence FROM box WHERE (doc_id * 31 + token_idx) % 17 <> 0
)"""
#: Runs of words on the exact grid, for the oracle: needs TOKENS before it.
RUNS = """
cut AS (
  SELECT *, CASE WHEN x1 - lag(x2) OVER (PARTITION BY doc_id, page_number, y1 ORDER BY x1) > 30 THEN 1 ELSE 0 END AS c FROM box
), grp AS (
  SELECT *, sum(c) OVER (PARTITION BY doc_id, page_number, y1 ORDER BY x1) AS run FROM cut
), runs AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY round_even(y1 / 20, 0), x1, y1) - 1 AS INT) AS line_idx FROM (
    SELECT doc_id, page_number, y1, run, string_agg(text, ' ' ORDER BY x1) AS text, min(x1) AS x1, max(x2) AS x2, max(y2) AS y2, count(*) AS n_words FROM grp GROUP BY doc_id, page_number, y1, run)
)"""


def oracle(text: str) -> str:
    """A portable text for the oracle."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else m[0], text)


#: Tables whose few bytes become many rows: the key that what is derived from them goes by, and bytes for one task.
KEYS = {"customer": ("c_custkey", 1 << 18), "part": ("p_partkey", 1 << 18), "lineitem": ("l_orderkey", 1 << 21), "conversations": ("conv_id", 1 << 20)}
#: Bytes of all tables for each reducer, and of an exchange's data in one reducer at most.
FOLDER_BYTES, REDUCER_BYTES = 8 << 20, 16 << 20


def bounded(spark: SparkSession, path: str) -> None:
    """Reducers follow the folder's size, so that what one of them holds does not grow with it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    total = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    now = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.shuffle.partitions", max(now, min(20_000, total // FOLDER_BYTES)))
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    util = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
    if util.byteStringAsBytes(spark.conf.get(name)) > REDUCER_BYTES:
        spark.conf.set(name, str(REDUCER_BYTES))


class Data:
    """The tables of one folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.at = spark, sf_dir
        bounded(spark, sf_dir)

    def keyed(self, name: str) -> str:
        """A view of a table by its key, a bounded share a task: whatever the size of files and row groups. What is
        grouped by that key later needs no other exchange."""
        t = self.table(name)
        size = int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        view = f"quiremill_{name}_{hashlib.sha256(self.at.encode()).hexdigest()[:12]}"
        key, share = KEYS[name]
        t.repartition(max(self.spark.sparkContext.defaultParallelism, -(-size // share)), key).createOrReplaceTempView(view)
        return view

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        views = {n: self.keyed(n) for n in KEYS if f"{{{n}}}" in text}
        return self.spark.sql(re.sub(r"\{(\w+)\}", lambda m: views.get(m[1]) or (f"parquet.`{self.at}/{m[1]}.parquet`" if m[1] in TABLES else m[0]), text))

    def words(self) -> DataFrame:
        return token_boxes(self.table("documents"))

    def twin(self) -> DataFrame:
        return degraded(self.words())

    def regions(self) -> DataFrame:
        return self.sql(f"WITH tags AS ({TAGS_SPARK}) {REGIONS}")
