"""Connected components of a large link table, by contraction.

In each round every node points to its smallest neighbour (or itself). Pointers lead to smaller nodes only, so they form
trees; these are followed to their roots by doubling, links are rewritten to the roots, and links within a tree vanish. As
every node with a link is in a tree of two or more, nodes at least halve in each round, and a chain, however long, is one
tree: rounds and doublings grow with the logarithm of the nodes. Each step is a map-side combined minimum or a join whose
inputs are read from the shared folder, so Spark may split the rows of a node with many links over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored

__all__ = ["connected_components", "forget", "stored"]


def roots(to: DataFrame) -> DataFrame:
    """(node, to) with pointers followed to where they end; ``to`` is a stored table in which every node pointed at has a row."""
    while True:
        step = to.withColumnRenamed("to", "mid").join(to.select(F.col("node").alias("mid"), "to"), "mid")
        if step.where(F.col("to") != F.col("mid")).isEmpty():
            return to
        before, to = to, stored(step.select("node", "to"))
        forget(before)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (columns a and b); the component is its smallest node."""
    now = stored(links.where("a is not null and b is not null and a <> b").select("a", "b"))
    steps: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = roots(stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to"))))
        steps.append(to)
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("a_to")), to.select(F.col("node").alias("b"), F.col("to").alias("b_to"))
        after = now.join(a, "a").join(b, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        before, now = now, stored(after)
        forget(before)
    if not steps:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = steps[0].select("node", F.col("to").alias("component"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    if len(steps) > 1:
        found = stored(found)
        forget(*steps)
    return found
