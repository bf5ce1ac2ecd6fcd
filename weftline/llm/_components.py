"""Connected components on a cluster: alternating large-star and small-star steps.

Each step sends every edge towards the smallest node in reach; a node's smallest neighbour is a
map-side aggregate and edges join it back, so no neighbour list is ever gathered in one place.  The
nodes of most edges, at most ``2 * HOT`` of them, are broadcast, so the edges of a star's centre are
not dealt to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import staged

HOT = 1000


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return row[0], row[1] or 0


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """From ``n`` edges (a > b) to edges (node, smallest), again with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"), F.count("*").alias("degree"))
    limit = max(HOT, n // HOT)  # 2 n ends of edges, so 2 * HOT nodes at most reach it
    hot = F.broadcast(least.where(F.col("degree") >= limit).select("u", "m"))
    cold = least.where(F.col("degree") < limit).select("u", "m")
    rest = both.join(hot.select("u"), F.col("a") == F.col("u"), "left_anti")
    joined = both.join(hot, F.col("a") == F.col("u")).unionByName(rest.join(cold, F.col("a") == F.col("u")))
    if large:  # neighbours above the node go to its smallest
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # neighbours below the node, and the node itself
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(a, b): every node of an edge but the smallest of its component, with that smallest node."""
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    mark = _mark(edges)
    while mark[0]:
        edges = staged(_star(staged(_star(edges, True, mark[0]), name), False, 2 * mark[0]), name)
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges
