"""Connected components of a table of links, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """v, c for every vertex of links (a, b): c is the smallest vertex of its component.

    Each round takes the least label among a vertex and its neighbours and then the label of that label; labels are a stored
    table after each round. Nothing but a count of changes reaches the driver. Rounds grow with the logarithm
    of the longest chain.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("c").alias("m"))
        lower = labels.join(near, labels.v == near.a, "left").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        up = labels.select(F.col("v").alias("at"), F.col("c").alias("above"))
        after = stored(lower.join(up, lower.c == up.at, "left").select("v", F.least("c", "above").alias("c"), "old"), "labels")
        if after.filter("c <> old").limit(1).count() == 0:
            return after.select("v", "c")
        labels = after.select("v", "c")
