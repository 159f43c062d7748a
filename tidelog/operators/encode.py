"""Change events to messages: topic, key and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = (
    "struct<database:string,table:string,action:string,before:map<string,string>,after:map<string,string>,"
    "org_row:array<array<string>>,event_header:struct<timestamp:bigint,log_pos:bigint>>"
)


def sorted_map(m: str) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def messages(changes: DataFrame) -> DataFrame:
    """topic, key, value (JSON with null images kept and names in order) and the order columns of each change event."""
    body = F.struct("database", "table", "action", sorted_map("before").alias("before"), sorted_map("after").alias("after"), "org_row", "event_header")
    return changes.select("topic", "key", F.to_json(body, {"ignoreNullFields": "false"}).alias("value"), "seq", "row_index")


def parsed(messages_: DataFrame) -> DataFrame:
    """Messages back to change events."""
    return messages_.select("topic", "key", "seq", "row_index", F.from_json("value", ENVELOPE).alias("e")).select("topic", "key", "seq", "row_index", "e.*")
