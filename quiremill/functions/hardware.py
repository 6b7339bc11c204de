"""Recognising hardware attributes in short text fragments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def any_of(words: list[str]) -> str:
    """Whole words in any case; blanks stand for any white space."""
    return r"(?i)\b(?:" + "|".join(w.replace(" ", r"\s*") for w in words) + r")\b"


NUMBER = r"(\d+(?:[.]\d+)?)"
CAPACITY = rf"(?i)\b{NUMBER}\s*([GMT]B)\b"
CLOCK = rf"(?i)\b{NUMBER}\s*([GM]Hz)\b"
CORES = r"(?i)\b(\d+)[\s-]*cores?\b"
DDR = r"(?i)\b(DDR[2-5])\b"
RACK = r"\b(\d+)\s*U\b"
WATT = r"(?i)\b(\d+)\s*(?:W|watt)s?\b"
SCREEN = rf'(?i)\b{NUMBER}\s*(?:"|-?in(?:ch|\b))'
YEARS = r"(?i)\b(\d+)[- ]?year"

KEYWORDS = {
    "Processor": any_of(["altra", "celeron", "core i[3579]", "cpu", "epyc", "opteron", "pentium", "power 1?[0-9]", "processor", "ryzen", "threadripper", "xeon"]),
    "Memory": any_of(["dimm", "ecc", "lrdimm", "memory", "ram", "rdimm", "so-?dimm", "udimm"]),
    "Storage": any_of(["disk", "hard drive", "hdd", "m[.]2", "nvme", "sas", "sata", "solid[- ]state", "ssd", "storage", "u[.]2"]),
    "Graphics": any_of(["blackwell", "geforce", "gpu", "graphics", "gtx", "nvidia", "quadro", "radeon", "rtx", "video card", "vram"]),
    "FormFactor": any_of(["chassis", "desktop chassis", "form factor", "rack[- ]?mount", "rugged", "sff", "small form", "tower"]),
    "PowerSupply": any_of(["hot[- ]?swap", "power supply", "psu", "redundant power"]),
    "Network": any_of(["1 gbe", "10 gbe", "25 gbe", "ethernet", "network card", "network interface", "nic", "rj-?45", "sfp[+]?"]),
    "Display": any_of(["1080p", "1440p", "4k", "display", "led panel", "monitor", "uhd", "wqhd"]),
    "OperatingSystem": any_of(["linux", "operating system", "red hat", "rhel", "ubuntu", "windows (?:10|11|server)"]),
    "Warranty": r"(?i)warrant(?:y|ies)|\b\d+[- ]?years?\b(?=[^.]*warrant)",
}
#: Order of attributes in a fragment, which is also the order of categories in a summary.
ORDER = ["Processor", "Memory", "Storage", "Graphics", "FormFactor", "PowerSupply", "Network", "Display", "OperatingSystem", "Warranty"]
CATEGORIES = ["Processor", "Memory", "Storage", "Graphics", "Display", "Network", "PowerSupply", "FormFactor", "Motherboard", "OperatingSystem", "Warranty", "Quantity", "PartNumber", "Other"]
MEDIA = "NVMe SSD SATA SAS HDD M.2 U.2".split()

SYSTEMS = {
    "Server": any_of(["blade", r"\d+U", "poweredge", "power s?1[0-9]", "proliant", "rack[- ]?mount", "server"]),
    "Workstation": any_of(["precision", "thinkstation", "workstation"]),
    "Laptop": any_of(["elitebook", "laptop", "latitude", "mobile workstation", "notebook", "thinkpad"]),
    "Monitor": any_of(["display panel", "monitor"]),
    "Desktop": any_of(["desktop", "mini pc", "optiplex", "tower pc"]),
}

#: Labels of key-value lines; the first category that fits holds.
LABELS = [
    ("Processor", ["cpu", "processor"]),
    ("Memory", ["memory", "ram"]),
    ("Storage", ["disk", "hard drive", "hdd", "nvme", "ssd", "storage"]),
    ("Graphics", ["gpu", "graphics", "video card"]),
    ("Display", ["display", "monitor", "screen"]),
    ("Network", ["ethernet", "network", "nic"]),
    ("PowerSupply", ["power", "power supply", "psu"]),
    ("FormFactor", ["chassis", "enclosure", "form factor"]),
    ("Motherboard", ["mainboard", "motherboard", "system board"]),
    ("OperatingSystem", ["operating system", "os"]),
    ("Warranty", ["support", "warranty"]),
    ("PartNumber", ["model", "nsn", "part (?:#|no|number)?", "sku"]),
    ("Quantity", ["qty", "quantity"]),
]

BULLET = r"^\s*(?:\d+[.)]|[*•●▪-])\s+(\S.*)$"
KEY_VALUE = r"^\s*(?:[*•-]\s*)?([a-zA-Z][ ()/a-zA-Z]{1,28}?)[ \t]*[:]\s*(\S.*)$"


def _group(s: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(s, pattern, group)
    return F.when(found != "", found)


def with_unit(s: Column, pattern: str) -> Column:
    """First number and unit, spelled "64 GB" or "3.5 GHz"."""
    unit = F.upper(F.regexp_extract(s, pattern, 2))
    unit = F.when(unit == "GHZ", "GHz").when(unit == "MHZ", "MHz").otherwise(unit)
    return F.when(unit != "", F.concat(F.regexp_extract(s, pattern, 1), F.lit(" "), unit))


def medium(s: Column) -> Column:
    """First of the media by their order in the list, not by place in the text."""
    return F.coalesce(*[F.when(s.rlike(rf"(?i)\b{m.replace('.', '[.]')}\b"), F.lit(m)) for m in MEDIA])


def attributes(text: Column) -> Column:
    """array<struct<category, raw, value, unit>> of one fragment, in fixed order."""
    raw = F.trim(text)
    cores = F.concat(_group(raw, CORES), F.lit("-core"))
    processor = F.concat_ws(", ", cores, with_unit(raw, CLOCK))
    rack = F.concat(_group(raw, RACK), F.lit("U"))
    none = F.lit(None).cast("string")
    value = {
        "Processor": F.when(processor != "", processor),
        "Memory": with_unit(raw, CAPACITY),
        "Storage": with_unit(raw, CAPACITY),
        "Graphics": with_unit(raw, CAPACITY),
        "FormFactor": rack,
        "PowerSupply": F.concat(_group(raw, WATT), F.lit(" W")),
        "Display": F.concat(_group(raw, SCREEN), F.lit('"')),
        "Warranty": F.concat(_group(raw, YEARS), F.lit("-year")),
    }
    unit = {"Memory": F.upper(_group(raw, DDR)), "Storage": medium(raw)}
    each = []
    for c in ORDER:
        hit = raw.rlike(KEYWORDS[c])
        if c == "FormFactor":
            hit = hit | rack.isNotNull()
        each.append(F.when(hit, F.struct(F.lit(c).alias("category"), raw.alias("raw"), value.get(c, none).alias("value"), unit.get(c, none).alias("unit"))))
    return F.array_compact(F.array(*each))


def label_category(label: Column) -> Column:
    """Category of a key-value line's label, first pattern wins; null for other labels."""
    return F.coalesce(*[F.when(label.rlike("(?i)^\\s*(?:" + "|".join(w.replace(" ", r"\s*") for w in p) + ")\\s*$"), F.lit(c)) for c, p in LABELS])


def category_order(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category).cast("int")


def quantity(text: Column) -> Column:
    """First number of at most six digits."""
    return _group(text, r"\b([0-9]{1,6})\b").try_cast("int")
