"""Connected components by joins: labels fall to the least node, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._store import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): the least node that it reaches. No edges, no rows.

    Repeated edges and edges to oneself change nothing; edges with a null end are ignored. Each round is a table in the shared folder; only a count of changes reaches the driver.
    """
    both = keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").dropDuplicates(["a", "b"]), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        told = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = keep(told.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        changed = new.where("label <> was").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(both)
            return labels.select("node", "label")
