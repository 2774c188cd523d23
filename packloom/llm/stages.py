"""Tables written to the cluster's shared folder, and connected groups over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, root): smallest id each id of the edges (a, b) is connected to.

    Every round hooks each group to the smallest group it touches and halves the paths, so
    the rounds grow with the logarithm of the longest chain. Each round is written to the
    shared folder: a lost executor costs one round at most. Only a count reaches the driver.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = staged(both, "edges")
    labels = staged(both.select(F.col("a").alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # A group follows its old root to wherever any of its members was hooked.
        best = hooked.groupBy(F.col("old").alias("root")).agg(F.min("root").alias("best"))
        step = hooked.join(best, "root", "left").select("id", "old", F.least("root", F.coalesce("best", "root")).alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        step = staged(step.join(jump, "root", "left").select("id", "old", F.least("root", F.coalesce("beyond", "root")).alias("root")), "labels")
        labels = step.select("id", "root")
        if step.where("old <> root").isEmpty():
            return labels
