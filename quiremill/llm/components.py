"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a grouped minimum, which Spark combines before the shuffle, and a join back; no node's neighbours ever
gather in one task. Rounds are written to the shared folder. It ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _digest(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return n, int(total or 0)


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with all v of a u beside u's smallest neighbour m, or u itself."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, root: the smallest node reachable, for every node of an edge (u, v)."""
    now = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    seen, i = _digest(now), 0
    while seen[0]:
        i += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # u's smaller neighbours and u itself all go to the smallest of them
        star = _star(large)
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now, last, seen = after, seen, _digest(after)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
