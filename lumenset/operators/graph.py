"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenset.functions.storage import materialize


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of the component. ``edges`` has two long columns, a and b.

    Each round links every node's larger neighbours to its least neighbour, then its smaller ones, with aggregates that
    combine before the shuffle and equi-joins, so a hub's rows are never gathered in one task. Every round is written
    to the shared folder. The number of rounds grows with the logarithm of the longest path. Nodes without an edge
    don't appear; self-links and repeated edges do no harm.
    """
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark.n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
