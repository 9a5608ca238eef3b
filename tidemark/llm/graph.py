"""Connected components of an edge table, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b; undirected).

    ``component`` is the smallest node that can be reached.  Rounds of hooking
    and contraction: each component hooks to its smallest neighbour below it,
    pointers are flattened by doubling, and the edges are renamed and made
    distinct.  The number of components with an edge at least halves in every
    round, so the rounds grow with the logarithm of the longest path at most.
    All state lives in written tables; the driver sees only whether one is
    empty.  Edges with a null end and loops are left out; a node that has only
    a loop is not returned.  An empty table gives an empty table.
    """
    edges = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = scratch.keep(edges, "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        hooks = _flat(edges.groupBy("a").agg(F.min("b").alias("b")), scratch)
        named = labels.join(hooks.select(F.col("a").alias("component"), F.col("b").alias("_to")), "component", "left")
        named = scratch.keep(named.select("node", F.coalesce("_to", "component").alias("component")), "labels")
        rest = edges
        for end in ("a", "b"):
            to = hooks.select(F.col("a").alias(end), F.col("b").alias("_to"))
            rest = rest.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        rest = rest.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        rest = scratch.keep(rest, "edges")
        scratch.drop(edges, labels, hooks)
        edges, labels = rest, named
    return labels


def _flat(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """Every pointer a -> b goes to the root; pointers always fall, so there is one."""
    hooks = scratch.keep(hooks, "pointers")
    while True:
        up = hooks.select(F.col("a").alias("b"), F.col("b").alias("_to"))
        if hooks.join(up, "b", "left_semi").isEmpty():
            return hooks
        doubled = scratch.keep(hooks.join(up, "b", "left").select("a", F.coalesce("_to", "b").alias("b")), "pointers")
        scratch.drop(hooks)
        hooks = doubled
