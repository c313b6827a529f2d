"""Connected components by alternating large-star and small-star steps on a table of edges.

Each step joins every edge with the least neighbour of one of its ends; the minima are
partial aggregates, so a node with very many edges is reduced before the shuffle, and in the join its edges are
dealt out over many keys (``spread_join``).  Every round is written to the shared folder; nothing but
whether the edges are stars comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import drop, spread_join, stage


def _is_done(edges: DataFrame) -> bool:
    """Whether the edges (a > b) are stars: every node has one centre, and no centre has one."""
    if not edges.groupBy("a").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("centre")).distinct(), F.col("a") == F.col("centre"), "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: (a long, b long), as tasks give them: spanning stars of what each has found, so that a node has an edge or
    two for each of its keys as the larger end, and any number as the lesser one.  Returns (node, component) for every node
    that has an edge to another node; ``component`` is the least node that it reaches."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the centres of a node are few, so a first small-star step needs no join: all its centres get the least of them
    near = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    met = near.select(F.explode(F.transform(F.concat(F.array("a"), F.slice("bs", 2, F.size("bs"))), lambda x: F.struct(x.alias("a"), F.get("bs", F.lit(0)).alias("b")))).alias("e"))
    cur = stage(met.select("e.a", "e.b").distinct(), "edges")
    while not _is_done(cur):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spread_join(both.filter("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, low, "a", "b")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        nxt = stage(small, "edges")
        drop(cur)
        cur = nxt
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
