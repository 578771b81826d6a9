"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlab.session import discard, written


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """Stored (id, root) of every id in ``links`` (a, b) but the roots: the least id that links reach.

    Rounds of large stars and small stars: every id points its larger neighbours, then its smaller ones, to the
    least of them, until only stars are left. Rounds grow with the logarithm of the longest chain. Least neighbours
    are partial aggregates and edges meet them in a join that splits hot ids, so no neighbourhood is ever
    gathered. Each round is stored, one number of it reaches the driver, and the one before is removed.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), label
    )
    while not _stars(edges):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.union(least.select("a", "low")).where("a != b").distinct()
        old, edges = edges, written(small, label)
        discard(old)
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out.stored_at = edges.stored_at
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1")
    return odd.isEmpty()
