"""Connected components by randomised contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): label is the smallest vertex reachable.

    Each round every vertex goes to the first of itself and its neighbours, and edges are drawn
    between where their ends went, until none is left. The last vertex of a component never
    stays, so the rounds end for every graph. The first round's order is that of the ids, which
    ends stars around their smallest id at once. Later orders are hashes anew for each round: a
    vertex is first among its neighbours with a chance of at most a half, so vertices are
    expected to shrink by a fixed share a round, whatever the graph and its ids are.
    """
    left = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    went: list[DataFrame] = []
    while not went or left.limit(1).count():
        place = lambda v, k=len(went): F.struct((F.xxhash64(F.lit(k), v) if k else F.col(v)).alias("at"), F.col(v).alias("v"))
        near = left.groupBy("a").agg(F.min(place("b")).alias("near"))
        went.append(stored(near.select(F.col("a").alias("v"), F.least("near", place("a"))["v"].alias("to")), "went"))
        for _ in range(2):  # one end, then the other
            left = left.join(went[-1].withColumnRenamed("v", "a"), "a").select(F.col("b").alias("a"), F.col("to").alias("b"))
        left = stored(left.filter("a <> b").distinct(), "edges")
    # Backwards, where each vertex ended: one that no later round has stayed where it was.
    ended = went.pop()
    while went:
        later = ended.select(F.col("v").alias("to"), F.col("to").alias("last"))
        ended = stored(went.pop().join(later, "to", "left").select("v", F.coalesce("last", "to").alias("to")), "ended")
    labels = ended.groupBy("to").agg(F.min("v").alias("label"))
    return stored(ended.join(labels, "to").select("v", "label"), "labels")
