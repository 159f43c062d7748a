"""Row events to change events: checks, fan-out, pairing of update images, positional zip, envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.functions.filters import action_of, is_kind, kept_rows
from tidelog.model import DELETE, INSERT, UPDATE, Task

IMAGE_ORDERS = ("after_first", "before_first")


def row_events(events: DataFrame, task: Task) -> DataFrame:
    """The row events that a task keeps, with their action; unknown event types go. Filters come first and reach the scan."""
    return events.filter(is_kind("rows") & kept_rows(task)).withColumn("action", action_of("event_type")).filter(F.col("action") != "")


def reason() -> Column:
    """Why an event can't be decoded, as a whole; null if it can."""
    n = F.coalesce(F.size("rows"), F.lit(0))
    return (
        F.when(F.col("columns").isNull(), "no schema")
        .when(n < 1, "no rows")
        .when((F.col("action") == UPDATE) & (n % 2 == 1), "odd update images")
        .when(~F.forall("rows", lambda r: r.isNotNull() & (F.size(r) == F.size("columns"))), "wrong number of cells")
    )


def checked(rows: DataFrame) -> DataFrame:
    """rows with `reason`, worked out once where a frame is kept and read several times."""
    return rows if "reason" in rows.columns else rows.withColumn("reason", reason())


def quarantined(rows: DataFrame) -> DataFrame:
    """Events that can't be decoded, with the reason. rows: row events with action and columns."""
    return checked(rows).filter(F.col("reason").isNotNull())


def with_names(versions: DataFrame) -> DataFrame:
    """versions with `names` of their columns and plain_names, whether none repeats: once a version, not once an image."""
    names = F.transform("columns", lambda c: c["name"])
    return versions.withColumns({"names": names, "plain_names": F.size(F.array_distinct(names)) == F.size(names)})


def zipped(names: Column, plain: Column, cells: Column) -> Column:
    """Names to cells by position; of a name that repeats (so not plain) the last cell counts."""
    last = F.filter(F.arrays_zip(names.alias("k"), cells.alias("v")), lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["k"]))
    return F.when(plain, F.map_from_arrays(names, cells)).otherwise(F.map_from_entries(last))


def decoded(rows: DataFrame, task_id: str, image_order: str = "after_first") -> DataFrame:
    """One change event per row, or per pair of images of an update, of the events that pass the checks.

    Rows of one event share its position; row_index tells them apart. image_order says which image of an update's
    pair comes first: the one after the change, or (as the log's own protocol has it) the one before.
    """
    if image_order not in IMAGE_ORDERS:
        raise ValueError(f"image_order is one of {IMAGE_ORDERS}")
    good = rows.filter(F.col("reason").isNull() if "reason" in rows.columns else reason().isNull())
    good = good if "plain_names" in good.columns else with_names(good)
    pairs = F.transform(F.sequence(F.lit(0), (F.size("rows") / 2).cast("int") - 1), lambda i: F.slice("rows", i * 2 + 1, 2))
    groups = F.when(F.col("action") == UPDATE, pairs).otherwise(F.transform("rows", lambda r: F.array(r)))
    each = good.select("seq", "log_file", "log_pos", "ts", "db", "tbl", "action", "names", "plain_names", F.posexplode(groups).alias("row_index", "org_row"))
    image = lambda i: zipped(F.col("names"), F.col("plain_names"), F.get("org_row", F.lit(i)))
    after_at, before_at = (0, 1) if image_order == "after_first" else (1, 0)
    before = F.when(F.col("action") == DELETE, image(0)).when(F.col("action") == UPDATE, image(before_at))
    after = F.when(F.col("action") == INSERT, image(0)).when(F.col("action") == UPDATE, image(after_at))
    return each.select(
        F.col("db").alias("database"),
        F.col("tbl").alias("table"),
        "action",
        before.alias("before"),
        after.alias("after"),
        "org_row",
        F.struct(F.col("ts").alias("timestamp"), "log_pos").alias("event_header"),
        F.concat_ws(".", F.lit(task_id), "db", "tbl").alias("topic"),
        F.concat_ws(".", "db", "tbl").alias("key"),
        "seq",
        "log_file",
        F.col("row_index").cast("long").alias("row_index"),
    )


def typed(changes: DataFrame, schema: str, side: str = "after") -> DataFrame:
    """Extension: one table's images as typed columns; cells that don't convert are null. schema: "name type, ..."."""
    fields = StructType.fromDDL(schema).fields
    return changes.select(*[F.col(side)[f.name].try_cast(f.dataType).alias(f.name) for f in fields], "action", "seq", "row_index")
