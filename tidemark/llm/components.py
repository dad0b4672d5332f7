"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex of links(a, b): root is the smallest vertex reachable. A written table.

    Each round takes the smallest label among neighbours and then the label of that label, so long chains halve; each
    round's labels are a written table. A vertex with very many links is only aggregated, never gathered.
    """
    both = common.settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = common.settle(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        own = labels.join(near, "v").select("v", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("v").alias("root"), F.col("root").alias("far"))
        labels = common.settle(own.join(jump, "root", "left").select("v", "old", F.least("root", "far").alias("root")), "labels")
        if not labels.where("root <> old").limit(1).count():
            return labels.select("v", "root")
        labels = labels.select("v", "root")
