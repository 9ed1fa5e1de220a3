"""Connected components of a table of links, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(links: DataFrame) -> DataFrame:
    """(node, component): each node of links (a, b) with the least node that it reaches. Labels take the least label
    among neighbours, then that label's own label, until none changes; each round is written to the shared folder.
    Links are kept both ways and with each node's link to itself, so one grouping gives the old and the new label. First,
    all nodes to which a node links downwards are linked to the least of them instead: stars that share their leaves
    shrink to one, so that the rounds read about as many links as there are nodes.
    Rows that are null are no links; one of a node with itself only says that the node exists."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")), *[F.struct(F.col(c).alias("node"), F.col(c).alias("other")) for c in "ab"])
    down = settled(links.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    least = down.groupBy("b").agg(F.min("a").alias("least"))
    stars = down.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("least").alias("a")).distinct()
    both = settled(stars.select(F.inline(ends)).distinct())
    labels = settled(both.groupBy("node").agg(F.min("other").alias("label")))
    while True:
        named = labels.select(F.col("node").alias("other"), "label")
        mine = F.max(F.when(F.col("node") == F.col("other"), F.col("label"))).alias("old")
        low = both.join(named, "other").groupBy("node").agg(mine, F.min("label").alias("low"))
        jump = low.join(named.select(F.col("other").alias("low"), F.col("label").alias("far")), "low")
        new = settled(jump.select("node", "old", F.least("low", "far").alias("label")))
        if new.where("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
