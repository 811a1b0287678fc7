"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of the edges ``a, b``.

    Each round maps a node to its smallest neighbour or itself, follows that map
    to its end (so a tree of any depth becomes a star), and renames both ends of
    the edges; edges within a star go. At least every other node with an edge
    disappears in a round. All tables of a round are written to the shared folder,
    so the plan does not grow and joins on a hub are plain joins of two tables,
    which adaptive execution splits. Null ends are no edges; an empty table has no
    components.
    """
    edges = materialise(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    label = materialise(nodes.select("node", F.col("node").alias("component")), "label")
    while not edges.isEmpty():
        # a node's smallest neighbour is smaller than itself or it keeps itself
        parent = materialise(
            edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
            .union(edges.select(F.col("a").alias("node"), F.col("a").alias("to")))
            .groupBy("node")
            .agg(F.min("to").alias("to")),
            "parent",
        )
        root = _to_roots(parent)
        label = materialise(
            label.join(root.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            ),
            "label",
        )
        half = materialise(
            edges.join(root.withColumnRenamed("node", "a"), "a").select(F.col("to").alias("x"), "b"),
            "half",
        )
        edges = materialise(
            half.join(root.withColumnRenamed("node", "b"), "b")
            .where("x <> to")
            .select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b"))
            .distinct(),
            "edges",
        )
    return label


def _to_roots(parent: DataFrame) -> DataFrame:
    """Every node with the end of its chain of parents, by pointer doubling."""
    while True:
        up = parent.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = materialise(
            parent.join(up, "to").select("node", "to", "next"), "jump"
        )
        if moved.where("to <> next").isEmpty():
            return parent
        parent = moved.select("node", F.col("next").alias("to"))
