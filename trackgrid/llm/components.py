"""Connected components as DataFrame rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackgrid.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges``; the root is the least node reachable.

    Every round points nodes at the least neighbour they know, first from the larger
    neighbours, then from the smaller ones; rounds grow with the logarithm of a
    component's diameter. Only minima are taken per node (partial aggregation) and
    joined back on the node, a join whose hot keys AQE splits. Rounds are
    tables in the shared folder; a round's table goes once the next one is written.
    NULL ends and loops count as no edge; without edges the result is empty.
    """
    a, b = F.col(left), F.col(right)
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    current = scratch.table(current, "edges")
    state = _state(current)
    while state[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = scratch.table(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop("large")
        scratch.drop("edges", keep=1)
        before, state = state, _state(current)
        if before == state:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _state(edges: DataFrame):
    """Number of edges and a sum over them, to see whether a round changed any."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
