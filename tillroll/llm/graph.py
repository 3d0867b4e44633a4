"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import settle


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of one sortable type; returns (node, component) for every node that has
    a link to another, the component being its smallest node.

    Each round hooks every node to its smallest neighbour, and keeps the links between the
    trees that arise; the number of rounds grows with the logarithm of the longest chain.
    A hub's links are pre-aggregated before each shuffle and split by AQE in the joins; nothing
    but a row count reaches the driver. Rounds are written to the shared folder, so a lost
    executor repeats one round at most. Links of a node with itself, null ends and repeated
    links change nothing. No links: no rows.
    """
    both = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    edges = settle(links.where("a <> b").select(*both).distinct())
    rounds = []
    while not edges.isEmpty():
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hooks = settle(hooks.select("node", F.least("node", "to").alias("to")))
        # from the hook on to the hook's own hook: trees flatten twice as fast
        next_hook = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hooks = settle(hooks.join(next_hook, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        rounds.append(hooks)
        a = hooks.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        b = hooks.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(a, "a").join(b, "b").where("ta <> tb")
        edges = settle(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def further(done: DataFrame, hooks: DataFrame) -> DataFrame:
        step = hooks.select(F.col("node").alias("component"), F.col("to").alias("_to"))
        return done.join(step, "component", "left").select(
            "node", F.coalesce("_to", "component").alias("component")
        )

    return reduce(further, rounds[1:], rounds[0].withColumnRenamed("to", "component"))
