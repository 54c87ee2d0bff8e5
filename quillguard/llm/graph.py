"""Connected components of an edge table that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of edges (a, b), label the smallest node of its component.

    Each round hooks every node to its smallest neighbour, shortens the chains that gives by pointer
    jumping, and contracts the edges; a round at least halves the nodes that still have edges. All
    steps are shuffles by node with a written table on both sides, so that a node with very many
    edges is split among tasks. Edges with a null end are left out; no edges give no rows.
    """
    left = scratch.save(edges.where("a <> b").select("a", "b").distinct(), f"{name}-edges-0")
    labels = None
    done = 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.save(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), f"{name}-up-{done}-0")
        jumps = 0
        while True:
            top = up.select(F.col("a").alias("p"), F.col("p").alias("pp")).where("pp < p")
            jumps += 1
            more = scratch.save(up.join(top, "p", "left").select("a", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), f"{name}-up-{done}-{jumps}")
            scratch.drop(f"{name}-up-{done}-{jumps - 1}")
            up = more.select("a", "p")
            if more.where("moved").isEmpty():
                break
        if labels is None:
            labels = scratch.save(up.select(F.col("a").alias("node"), F.col("p").alias("label")), f"{name}-labels-0")
        else:
            labels = scratch.save(labels.join(up, labels.label == up.a, "left").select("node", F.coalesce("p", "label").alias("label")), f"{name}-labels-{done}")
            scratch.drop(f"{name}-labels-{done - 1}")
        shorter = left.join(up, "a").select(F.col("p").alias("x"), F.col("b").alias("a")).join(up, "a").select(F.col("x").alias("a"), F.col("p").alias("b"))
        left = scratch.save(shorter.where("a <> b").distinct(), f"{name}-edges-{done + 1}")
        scratch.drop(f"{name}-edges-{done}")
        done += 1
    if labels is None:
        labels = left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
