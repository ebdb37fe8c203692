"""Connected components of a link table, by alternating large-star and small-star rounds.

Both rounds are joins and ``min`` aggregates: a vertex with very many links is combined map-side
and its rows are spread by the skew-join rule, never gathered.  Each round is checkpointed to the
cluster's checkpoint folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _star(links: DataFrame, least: DataFrame) -> DataFrame:
    return links.join(least, "a")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of a bigint vertex type -> (vertex, root), root = smallest vertex reachable.
    Vertices without links are not listed.  No links give no rows."""
    links = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct())
    while True:
        # large star: link every larger neighbour, and the vertex, to the smallest of both
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _star(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: link every smaller neighbour, and the vertex, to the smallest of both
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _star(large, least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = cut_lineage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        changed = small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty()
        links = small
        if changed:
            return links.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root"))
