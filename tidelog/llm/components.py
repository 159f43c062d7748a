"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", rows_per_file: int = 200_000) -> DataFrame:
    """node, label (the smallest node it reaches) for each node of the edges. Null ends are ignored.

    Each round takes the smallest label among a node's own and its neighbours', then the label of that label,
    so distances halve; labels are written as a table after each round, and rounds end when none changes.
    A node with many edges is one row of partial minima a task. Tables have a file for each `rows_per_file` edges.
    """
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = materialize(ends.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(ends.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    files = -(-both.count() // rows_per_file) or 1
    table = labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label")).coalesce(files), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(moved.join(over, "label").select("node", "old", F.least("label", "next").alias("label")).coalesce(files), "labels")
        over_now = new.filter(F.col("old") != F.col("label")).isEmpty()
        discard(table)
        table, labels = new, new.select("node", "label")
        if over_now:
            discard(both)
            return labels
