"""Connected components of a distributed edge list.

Each node takes the smallest label among its neighbours, passes it to its own
label's node, then takes its label's label, so chains halve every round. Edges and labels are dealt by node once and keep that
partitioning through their checkpoints in the cluster's shared folder; a round
moves messages (``min`` combines them first) and the two ways of a look-up.
Nothing is broadcast: many small relations would fill the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestql.llm.common import dealt_checkpoint, parallelism


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` (the smallest reachable node) for each node of ``a, b`` edges."""
    n = parallelism(edges.sparkSession)
    one_way = edges.select("a", "b").where("a != b")
    both = dealt_checkpoint(one_way.union(one_way.select(F.col("b"), F.col("a"))).distinct().repartition(n, "a"))
    labels = dealt_checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        sent = both.join(labels.withColumnRenamed("node", "a").hint("merge"), "a").select(F.col("b").alias("node"), "label")
        heard = sent.groupBy("node").agg(F.min("label").alias("heard"))
        # Edges go both ways, so every node hears something, and tells its label of it.
        near = labels.join(heard.hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("near"))
        told = near.groupBy(F.col("old").alias("node")).agg(F.min("near").alias("told"))
        lowered = near.join(told.hint("merge"), "node", "left").select("node", "old", F.least("near", "told").alias("low"))
        parents = lowered.select(F.col("node").alias("low"), F.col("low").alias("label"))
        after = dealt_checkpoint(lowered.join(parents.hint("merge"), "low").select("node", "label", "old").repartition(n, "node"))
        labels = after.select("node", "label")
        if after.where("label != old").isEmpty():
            return labels
