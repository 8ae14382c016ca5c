"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm import common


def connected(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of every id in ``edges`` (a, b: long).

    A round lowers each label to the least among the neighbours', then follows labels of labels, so
    the rounds grow with the logarithm of a component's diameter.  Labels are written to the shared
    folder after each round; nothing but a count reaches the driver."""
    both = common.materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = common.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        lowered = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "least").alias("low"))
        lowered = common.materialise(lowered, "lowered")
        target = lowered.select(F.col("id").alias("low"), F.col("low").alias("lower"))
        labels = common.materialise(lowered.join(target, "low").select("id", "old", F.least("low", "lower").alias("component")), "labels")
        if labels.where("component < old").isEmpty():
            return labels.select("id", "component")
        labels = labels.drop("old")
