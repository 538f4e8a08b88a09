"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of the edges (a, b), the smallest node that it can reach.

    A round maps each node to the smallest of itself and its neighbours and edges to the images of their ends. What is
    left is a smaller graph with the same components, until no edge is left; then the maps are chained. Each round's
    tables are written; nothing but whether edges are left reaches the driver. Fails if ``rounds`` don't do."""
    edge = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    maps: list[DataFrame] = []
    for _ in range(rounds):
        low = edge.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        maps.append(written(low.union(edge.select("a", "a").distinct()).groupBy("node").agg(F.min("to").alias("to"))))
        ends = [maps[-1].select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in ("a", "b")]
        image = edge.join(ends[0], "a").join(ends[1], "b").where("a2 <> b2")
        edge = written(image.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        if edge.isEmpty():
            break
    else:
        raise RuntimeError(f"components don't settle in {rounds} rounds")
    root = maps.pop().withColumnRenamed("to", "root")
    while maps:
        step = maps.pop()
        root = written(step.join(root.select(F.col("node").alias("to"), "root"), "to", "left").select("node", F.coalesce("root", "to").alias("root")))
    return root
