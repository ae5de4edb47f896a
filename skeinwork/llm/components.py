"""Connected components of a link table, by hooking roots onto lesser neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for nodes that have links; others are left out.

    links: a, b (either order, repeats allowed). Each round a root hooks onto its least
    neighbour if that is less, chains of hooks are halved until all point at their ends, and links are drawn between the roots
    that are left. In two rounds a root hooks or another hooks onto it, so their number halves; the rounds end when no link is left.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut(both, "cc-links")
    labels = None
    while labels is None or not both.isEmpty():
        hooked = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "cc-hooks")
        while True:
            # hooks lead to lesser nodes only, so there is no cycle
            further = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
            stepped = cut(hooked.join(further, "root").select("node", F.col("root").alias("old"), F.col("further").alias("root")), "cc-jump")
            hooked = stepped.select("node", "root")
            if stepped.where("root < old").isEmpty():
                break
        to = hooked.select(F.col("node").alias("of"), F.col("root").alias("to"))
        if labels is None:
            labels = hooked
        else:
            labels = cut(labels.join(to, labels["root"] == to["of"], "left").select("node", F.coalesce("to", "root").alias("root")), "cc-labels")
        ends = both.join(to, both["a"] == to["of"]).select(F.col("to").alias("a"), "b")
        ends = ends.join(to, ends["b"] == to["of"]).select("a", F.col("to").alias("b"))
        both = cut(ends.where("a <> b").distinct(), "cc-links")
    return labels
