"""Extensions: relational views of change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_images(changes: DataFrame, key: str) -> DataFrame:
    """The rows that a log leaves: of each table and key the newest image, without deleted ones.

    max_by keeps one candidate a task and key, so hot keys fold before the shuffle.
    """
    image = F.coalesce("after", "before")
    newest = changes.withColumn("k", image[key]).groupBy("database", "table", "k").agg(F.max_by(F.struct("action", "after"), F.struct("seq", "row_index")).alias("last"))
    return newest.filter("last.action <> 'delete'").select("database", "table", "k", F.col("last.after").alias("image"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("topic", "action").agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
