"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnsift.session import cut_lineage


def _hooked(links: DataFrame) -> DataFrame:
    """Every node with the smallest node it is linked to, itself included."""
    ends = links.select(F.inline(F.array(
        F.struct(F.col("a").alias("node"), F.least("a", "b").alias("parent")),
        F.struct(F.col("b").alias("node"), F.least("a", "b").alias("parent")),
    )))
    return cut_lineage(ends.groupBy("node").agg(F.min("parent").alias("parent")))


def _flattened(parents: DataFrame) -> DataFrame:
    """Parents followed up to their root; the distance halves with each join."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        jumped = cut_lineage(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        if jumped.where("moved").isEmpty():
            return parents
        parents = jumped.select("node", "parent")


def _renamed(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    to = parents.select(F.col("node").alias(column), F.col("parent").alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a``, ``b``); the root is the smallest node of a component.

    Each round hooks every node to its smallest neighbour, follows the parents to their roots, and keeps the links
    between different roots.  Only the smallest node of a neighbourhood can survive a round, so few rounds are needed.  All
    steps are joins and combinable minima on tables in the shared folder; a component of any size is spread over tasks.
    """
    links = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    rounds = []
    while not links.isEmpty():
        parents = _flattened(_hooked(links))
        rounds.append(parents)
        links = cut_lineage(_renamed(_renamed(links, "a", parents), "b", parents).where("a <> b").distinct())
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    nodes = rounds[0].select("node", F.col("parent").alias("root"))
    for parents in rounds[1:]:
        nodes = _renamed(nodes, "root", parents)
    return nodes
