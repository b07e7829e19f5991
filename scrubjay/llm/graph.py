"""Connected components of an edge table, by hooking and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): each node of ``edges`` (a, b) with the smallest id it reaches.

    Every root hooks to its smallest smaller neighbour, pointers jump to their roots, and
    edges move to the roots, until no edge joins two roots.  Hooks come from a grouped
    minimum (combined before the shuffle), so a node with very many edges is no hot spot,
    and each round's tables are written to the shared folder."""
    edges = edges.select("a", "b").where("a <> b")
    labels = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct() \
        .withColumn("component_id", F.col("id"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    turn = 0
    while True:
        edges = written(edges, f"components-edges{turn}")
        if edges.isEmpty():
            return labels
        up = written(edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")), f"components-up{turn}")
        while True:
            above = up.toDF("up", "up2")
            jumped = up.join(above, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved"))
            jumped = written(jumped, f"components-jump{turn}")
            up = jumped.select("id", "up")
            if jumped.where("moved").isEmpty():
                break
        root = up.toDF("component_id", "root")
        labels = written(labels.join(root, "component_id", "left").select("id", F.coalesce("root", "component_id").alias("component_id")),
                         f"components-labels{turn}")
        x, y = up.toDF("a", "ra"), up.toDF("b", "rb")
        edges = edges.join(x, "a", "left").join(y, "b", "left") \
            .select(F.coalesce("ra", "a").alias("u"), F.coalesce("rb", "b").alias("v")).where("u <> v") \
            .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        turn += 1
