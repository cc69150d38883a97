"""Connected components of a large, sparse graph, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame, name: str = "graph") -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); nodes have the
    same root exactly if a path joins them.

    Each round every node points to the lowest of itself and its neighbours in a
    random order that changes by round; pointed-to nodes stand for those that
    point to them, and edges within one node go. The nodes fall to about half
    in a round whatever the shape of the graph, so rounds grow as its logarithm.
    A hub costs no task of its own: minima are partial aggregates and the joins
    have a side with one row for each node, so Spark may split the other.
    """
    edges = shared.cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        step = shared.cut(least.select("u", F.least("m", rank("u"))["v"].alias("p")), f"{name}-step")
        steps.append(step)
        to = lambda c: step.select(F.col("u").alias(c), F.col("p").alias(f"p{c}"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("pa <> pb")
        edges = shared.cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), name)
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("p"), "root")
        roots = shared.cut(step.join(later, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root")), f"{name}-roots")
    return roots
