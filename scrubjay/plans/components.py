"""Connected components of an edge table over longs.

Each root hooks to its smallest neighbouring root and pointers are followed to the end;
edges then move to the roots, until none joins two.  Trees halve at least with every turn, and
pointer chains with every jump, so a chain of n vertices takes about log n small jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def component_labels(edges: DataFrame) -> DataFrame:
    """(x, component): every vertex of ``edges`` (u, v; longs) with the smallest vertex it
    reaches.  Minima are combined before the shuffle, so a vertex with very many edges is
    reduced where its edges lie.  Loops and repeated edges change nothing, edges with a
    null end are left out, no edges give no rows."""
    edges = edges.where("u is not null and v is not null")
    ends = edges.select(F.col("u").alias("x")).unionByName(edges.select(F.col("v").alias("x")))
    labels = cut_lineage(ends.distinct().withColumn("component", F.col("x")))
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
    while True:
        edges = cut_lineage(edges)
        up = cut_lineage(edges.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("up")))
        if up.isEmpty():
            return labels
        while True:
            above = up.select(F.col("x").alias("up"), F.col("up").alias("up2"))
            jump = up.join(above, "up", "left")
            up = cut_lineage(jump.select("x", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")))
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        root = up.select(F.col("x").alias("component"), F.col("up").alias("root"))
        labels = cut_lineage(labels.join(root, "component", "left").select("x", F.coalesce("root", "component").alias("component")))
        a, b = up.select(F.col("x").alias("u"), F.col("up").alias("ru")), up.select(F.col("x").alias("v"), F.col("up").alias("rv"))
        moved = edges.join(a, "u", "left").join(b, "v", "left").select(
            F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
        edges = moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
