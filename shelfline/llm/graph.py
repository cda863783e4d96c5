"""Connected components of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``: the smallest id reachable.

    Every round each id takes the least label around it and then the label of
    that label, so long chains shorten by a factor each time.  Rounds are written
    tables; the driver sees one count a round.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("via"), F.col("component").alias("was"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("onward"))
        after = saved(stepped.join(jump, "via").select("id", F.least("via", "onward").alias("component"), "was"), "labels")
        labels = after.select("id", "component")
        if not after.where("component <> was").count():
            return labels
