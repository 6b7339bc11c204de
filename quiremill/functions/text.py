"""Normalisers, tokenisers and rule functions over text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ALNUM = r"[^\p{L}\p{Nd}]"
#: Replacement character, control characters but tab, line feed and carriage return, DEL, C1 and private use.
UNDECODABLE = r"[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{E000}-\x{F8FF}]"
MARK_GLYPH = r"(?<![0-9A-Za-z])(?:[☒✓✗]|[Xx])(?![0-9A-Za-z])"
FORM = r"(?i)\b(?:OPTIONAL|STANDARD)[\s]+FORM[\s]+([0-9]+[A-Z]?)"
REVISION = r"(?i)\bREV\.?\s*\(?\d{1,2}/(\d{4})"


def alnum_lower(s: Column) -> Column:
    """Letters and digits only, lower-cased: one spelling in every engine (upper-casing is not, for ß)."""
    return F.lower(F.regexp_replace(s, NOT_ALNUM, ""))


def alnum_upper(s: Column) -> Column:
    """Letters and digits only, upper-cased letter by letter; ß stays as it is."""
    parts = F.split(F.regexp_replace(s, NOT_ALNUM, ""), "ß", -1)
    return F.array_join(F.transform(parts, F.upper), "ß")


def words(s: Column) -> Column:
    """Stretches between any Unicode white space."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def word_count(s: Column) -> Column:
    return F.size(words(s))


def undecodable_count(s: Column) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, UNDECODABLE, ""))


def not_blank(s: Column) -> Column:
    """Holds anything but white space, of any kind that Unicode knows; null is blank."""
    return F.coalesce(s.rlike(r"(?U)\S"), F.lit(False))


def strip(s: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def has_alnum(s: Column) -> Column:
    return s.rlike(r"[\p{L}\p{Nd}]")


def form_designation(s: Column) -> Column:
    found = F.regexp_extract(s, FORM, 1)
    return F.when(found != "", F.upper(found))


def revision_year(s: Column) -> Column:
    found = F.regexp_extract(s, REVISION, 1)
    return F.when(found != "", found)


def pipe_escape(s: Column) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def cap(s: Column, most: int, marker: str = " …[truncated]") -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit(marker))).otherwise(F.coalesce(s, F.lit("")))


def was_capped(s: Column, most: int) -> Column:
    return F.coalesce(F.length(s) > most, F.lit(False))


def distinctive_tokens(s: Column) -> Column:
    """Upper-cased parts of at least four characters that hold a letter, each once."""
    parts = F.split(F.upper(s), r"[\s.,:;()/\-'\"&]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 4) & t.rlike(r"\p{L}")))


def is_echo(value: Column, label: Column) -> Column:
    """All distinctive tokens of the value are in the label; needs at least one."""
    v = distinctive_tokens(value)
    return (F.size(v) > 0) & (F.size(F.array_except(v, distinctive_tokens(label))) == 0)


def is_meaningful(value: Column) -> Column:
    """Two characters with a letter, or two digits."""
    v = F.trim(value)
    return ((F.length(v) >= 2) & v.rlike(r"\p{L}")) | (F.regexp_count(v, F.lit(r"\p{Nd}")) >= 2)


def has_value_char(value: Column) -> Column:
    """Something alphanumeric besides x and X, which are ticks."""
    return value.rlike(r"[[\p{L}\p{Nd}]&&[^xX]]")


def leading_number(s: Column) -> Column:
    """1 to 199 from a leading "12." or "12)" before white space."""
    n = F.regexp_extract(s, r"^\s*([0-9]{1,3})(?:[)]|[.])\s", 1).try_cast("int")
    return F.when((n >= 1) & (n <= 199), n)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def lines_of(s: Column) -> Column:
    """Trimmed lines, blank ones left out."""
    return F.filter(F.transform(F.split(s, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def trigrams(s: Column) -> Column:
    """Distinct runs of three of the normalised characters; a shorter text is its own. One pass, by lookahead."""
    n = alnum_lower(s)
    long = F.array_distinct(F.regexp_extract_all(n, F.lit("(?=(...))"), F.lit(1)))
    return F.when(F.length(n) >= 3, long).when(n != "", F.array(n)).otherwise(F.array().cast("array<string>"))


def set_recall(truth: Column, got: Column) -> Column:
    """Share of the truth set that the other has; 1 for an empty truth."""
    return F.when(F.size(truth) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(truth, got)) / F.size(truth))


def similarity(a: Column, b: Column) -> Column:
    """Normalised edit similarity."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)
