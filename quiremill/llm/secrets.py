"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Each version of a text is a blob under its SHA-256. A ledger is a table in a folder that holds, for every (blob, rule
version) scanned so far, the spans found. A scan reads it, looks up which blobs it lacks, scans one copy of each, appends
them to it, and joins the findings back to every row (path) that has the blob. An empty or missing folder is a ledger
that has seen nothing; without a folder, a new one serves this scan alone. Every scan appends one folder of files, which
appears whole or not at all; blobs that two scans added at once count once.

Spans are in code points, end exclusive. Per kind: matches from the left, not overlapping, then those too short dropped.
Defined results: a null text is empty; a null id is kept as its row's id; repeated rows each get their findings; nothing
found gives counts of 0 and empty strings. Other columns are never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, only


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # Java regular expression
    least: int = 0  # code points of group `of` that a match must have
    of: int = 0


#: White space in a key, also as the \n of a quoted string.
_GAP = r"(?:\s|\\[nr])*+"
#: A private key from its BEGIN line through its headers and base64 body to the END line, or to the end of the body if there
#: is none: chunks of 16 letters at least, or padded, or right before the END line. Possessive, so that no text takes long.
PEM = (
    r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]++ )*+PRIVATE KEY-----"
    rf"(?:{_GAP}(?:(?:Proc-Type|DEK-Info|Content-Domain|Key-Info|MIC-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{{16,}}+={{0,2}}+|[A-Za-z0-9+/]++(?:={{1,2}}+|(?={_GAP}-----END ))))*+"
    rf"(?:{_GAP}-----END (?:(?!PRIVATE KEY-----)[A-Z]++ )*+PRIVATE KEY-----)?+"
)
#: The three base kinds first; their minima of whole runs are part of the pattern where that cannot change the matches.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", PEM),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
VERSION = "1"
BASE = ("assign", "access", "hex")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, end>>: the gaps between matches and the matches give the positions by their lengths."""
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(hits, lambda x: F.length(x))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.of)) if rule.of else hits
    rows = F.arrays_zip(F.transform(gaps, lambda x: F.length(x)).alias("gap"), sizes.alias("size"), F.transform(kept, lambda x: F.length(x)).alias("key"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,ord:int,end:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        hit = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"))
        good = x["size"].isNotNull() & (x["key"] >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(rows, start, step, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast("array<struct<start:int,ord:int,end:int>>"))


def found_in(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start, then by the rules' order."""
    return F.array_sort(F.concat(*[spans_of(text, r, i) for i, r in enumerate(rules)]))


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def version_of(rules: tuple[Rule, ...]) -> str:
    """Changes with any rule, so that a changed rule set scans every blob again."""
    import hashlib

    return f"{VERSION}-{hashlib.sha256(repr(rules).encode()).hexdigest()[:12]}"


LEDGER = "blob binary, rules string, spans array<struct<start:int,ord:int,end:int>>"


class Ledger:
    """The table of scanned blobs in a folder; see LEDGER for its columns."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, version: str) -> DataFrame | None:
        """blob and spans of all blobs that were scanned under a rule version; None if no scan was ever added."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scan=*")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
            return None
        rows = self.spark.read.schema(LEDGER).parquet(f"{self.path}/scan=*")
        return rows.where(F.col("rules") == version).dropDuplicates(["blob"]).select("blob", "spans")

    def append(self, found: DataFrame, version: str) -> DataFrame:
        """Add blob and spans under a rule version; the rows added, as read back."""
        at = f"{self.path}/scan={uuid.uuid4().hex}"
        found.select("blob", F.lit(version).alias("rules"), "spans").write.parquet(at)
        return self.spark.read.schema(LEDGER).parquet(at)


def scan(docs: DataFrame, ledger: str | None = None, *, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, blob, spans) of every row; (blob, spans) of every blob with spans; and the ledger rows that this scan added.

    One row of each unseen blob, that with the smallest id, is scanned; rows with one id and text are one version.
    """
    spark = docs.sparkSession
    table = Ledger(spark, ledger or (scratch or Scratch(spark, "secrets")).path("ledger"))
    version = version_of(rules)
    known = table.read(version)
    rows = only(docs, id=id, text=text).select("id", F.coalesce("text", F.lit("")).alias("text"))
    paths = rows.select("id", F.unhex(F.sha2("text", 256)).alias("blob"))
    owners = paths.groupBy("blob").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("o"))
    if known is not None:
        owners = owners.join(known.select("blob"), "blob", "left_anti")
    owners = owners.select("blob", F.col("o.id").alias("id"))
    unseen = rows.withColumn("blob", F.unhex(F.sha2("text", 256))).join(owners.withColumnsRenamed({"blob": "b", "id": "i"}), F.col("blob").eqNullSafe(F.col("b")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")
    found = unseen.select("blob", found_in(F.col("text"), rules).alias("spans"))
    added = table.append(found.dropDuplicates(["blob"]), version)
    seen = added.select("blob", "spans") if known is None else added.select("blob", "spans").unionByName(known)
    hits = seen.where(F.size("spans") > 0)
    return paths.join(hits, "blob", "left"), hits, added


def of_kind(order: int):
    return lambda s: s["ord"] == order


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """Counts and spans of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows, _, _ = scan(docs, ledger, rules=rules)
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:int,ord:int,end:int>>"))
    count = [F.size(F.filter(spans, of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    base = joined(F.filter(spans, lambda s: s["ord"] < len(BASE)), rules)
    return rows.select(F.col("id").alias("doc_id"), *count, F.sha2(base, 256).alias("base_sha256"), joined(spans, rules).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", *, id: str = "doc_id", ledger: str | None = None) -> DataFrame:
    """The documents with each span of a secret replaced by [kind]; overlapping spans become one, named by the first.

    The spans are those of scan(): one copy of each text that the ledger lacks is scanned. A null text stays null. The
    columns stay as they are, whatever their names.
    """
    _, hits, _ = scan(docs, ledger, id=id, text=text, rules=rules)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    kinds = F.array(*[F.lit(f"[{r.kind}]") for r in rules])
    t = F.col("row").getField(text)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        put = F.concat(acc["done"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(kinds, s["ord"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, put).otherwise(acc["done"]).alias("done"))

    merged = F.aggregate(F.col("spans"), start, step, lambda acc: F.concat(acc["done"], F.substring(t, acc["at"] + 1, F.length(t))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("blob", F.unhex(F.sha2(F.coalesce(t, F.lit("")), 256))).join(hits, "blob", "left")
    cut = F.when(F.size("spans") > 0, merged).otherwise(t)
    return rows.select(*[cut.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
