"""Connected components by alternating large-star and small-star steps over an edge table.

Each step is a grouped minimum (combined before the shuffle) and a join back, so a node with very many neighbours is neither
collected nor sorted in one place; adaptive execution splits its join partition. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootloom.llm.shared import kept


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    sideways = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return sideways.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for each node of the edges (a, b) that isn't its component's least node; root is that least node.

    Edges of a node with itself and repeated edges change nothing; an edge with a null is no edge; no edges give no rows.
    """
    edges = kept(edges.where("a <> b").select("a", "b").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        edges = kept(_small_star(_large_star(edges)), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
