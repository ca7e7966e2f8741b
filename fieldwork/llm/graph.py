"""Connected components of a graph kept as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwork.llm.common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has a link to another one; ``component`` is the
    smallest node reachable.  Null ends and links of a node to itself are ignored.

    Contraction: every round hooks each node to its smallest neighbour (an
    aggregate with map-side minima), follows the hooks twice, renames the ends of the
    links, and drops links that have become loops.  Nodes keep a table of
    their current representative.  Each round is written to the shared
    scratch folder; the loop ends when no link is left, however many rounds
    that takes.  Only one count a round reaches the driver.
    """
    links = (links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
             .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = written(links, "links")
    labels = None
    while links.head(1):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up"))
        hooks = written(hooks, "hooks")
        for _ in range(2):
            top = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hooks = hooks.join(top, "up").select("node", F.col("top").alias("up"))
        hooks = written(hooks, "hooks")
        if labels is None:
            labels = hooks.select("node", F.col("up").alias("component"))
        else:
            step = hooks.select(F.col("node").alias("component"), "up")
            labels = written(labels.join(step, "component", "left")
                             .select("node", F.coalesce("up", "component").alias("component")), "labels")
        ends = hooks.select(F.col("node").alias("a"), F.col("up").alias("na"))
        other = hooks.select(F.col("node").alias("b"), F.col("up").alias("nb"))
        links = written(links.join(ends, "a").join(other, "b").where("na <> nb")
                        .select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
