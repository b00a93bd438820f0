"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the smallest node reachable.

    Each round every node takes the smallest of itself and its neighbours as parent, parents are
    followed twice, and links are rewritten between parents; links inside a component vanish. A
    round divides the nodes of a path by a constant, so rounds grow with the logarithm of the
    longest path. Each round's tables are written to the shared folder, so lineage stays short.
    Null ends are ignored.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = shared.written(edges, "edges")
    labels = shared.written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = shared.written(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("parent")), "parents")
        for _ in range(2):
            parents = _follow(parents, "parent", parents)
        parents = shared.written(parents, "parents")
        labels = shared.written(_follow(labels, "component", parents), "labels")
        moved = _follow(_follow(edges, "a", parents), "b", parents)
        edges = shared.written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    return labels


def _follow(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replace a column's nodes by their parents, where they have one."""
    step = parents.select(F.col("node").alias("__node"), F.col("parent").alias("__parent"))
    joined = rows.join(step, F.col(column) == F.col("__node"), "left")
    return joined.withColumn(column, F.coalesce("__parent", column)).drop("__node", "__parent")
