"""Connected components of an edge table by contraction, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import dropped, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id of an edge between two ids the smallest id it reaches.

    A round labels each id with its smallest neighbour, if that is smaller, follows labels to their ends by doubling, and puts
    the labels in the edges' place; edges within a label go. Every id with an edge left is labelled away or labels another, so
    the ids that are left at least halve with each round.
    """
    edges = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
        while True:  # labels only fall, so following them ends
            above = labels.select(F.col("id").alias("label"), F.col("label").alias("above"))
            new = written(labels.join(above, "label").select("id", F.col("above").alias("label"), (F.col("above") < F.col("label")).alias("moved")), "labels")
            moved = new.where("moved").limit(1).count()
            dropped(labels)
            labels = new.select("id", "label")
            if not moved:
                break
        x, y = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        left = written(edges.join(x, "a").join(y, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        dropped(edges)
        edges = left
        step = labels.select(F.col("id").alias("component"), "label")
        found = labels.withColumnRenamed("label", "component") if found is None else written(found.join(step, "component", "left").select("id", F.coalesce("label", "component").alias("component")), "found")
        if edges.limit(1).count() == 0:
            return found
