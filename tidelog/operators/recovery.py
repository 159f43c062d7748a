"""Where a task starts again, which events it skips, and how its position moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.filters import applied_queries
from tidelog.model import Task


def start_position(states: DataFrame) -> DataFrame:
    """task_id, source (latest, marks or saved), start_name, start_pos and high_water of each task state.

    Position 0 means the latest; else the oldest mark, with the newest mark's position as high water; else the saved one.
    """
    marks = F.coalesce(F.size("marks"), F.lit(0))
    latest, marked = F.coalesce("position_pos", F.lit(0)) == 0, marks > 0
    first, last = F.get("marks", F.lit(0)), F.get("marks", marks - 1)
    return states.select(
        "task_id",
        F.when(latest, "latest").when(marked, "marks").otherwise("saved").alias("source"),
        F.when(~latest, F.when(marked, first["pos_name"]).otherwise(F.col("position_name"))).alias("start_name"),
        F.when(~latest, F.when(marked, first["pos"]).otherwise(F.col("position_pos"))).alias("start_pos"),
        F.when(~latest & marked, last["pos"]).alias("high_water"),
    )


def file_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)$", 1).cast("long")


def replay(events: DataFrame, states: DataFrame, order: str = "position") -> DataFrame:
    """The events with `processed`: false for those that a recovering task skips.

    A task in recovery processes events at failed marks, skips others, and leaves recovery at the first event beyond
    the high water mark. order "position" compares positions alone, "file" the file's number first. That first event
    is a minimum per task, so no window runs over the log. Tasks without marks, or at position 0, process all.
    """
    s = start_position(states).join(states.select("task_id", "marks"), "task_id").filter("source = 'marks'")
    key = lambda name, pos: F.struct(file_number(name).alias("f"), pos.alias("p")) if order == "file" else F.struct(pos.alias("p"))
    newest = F.element_at("marks", -1)
    failed = F.transform(F.filter("marks", lambda m: ~m["success"]), lambda m: key(m["pos_name"], m["pos"]))
    s = s.select("task_id", failed.alias("failed"), key(newest["pos_name"], newest["pos"]).alias("high"))
    marked = events.join(s, "task_id", "left")  # a row a task, which Spark broadcasts where they are few
    marked = marked.withColumn("at", key(F.col("log_file"), F.col("log_pos"))).withColumn("is_failed", F.coalesce(F.array_contains("failed", F.col("at")), F.lit(False)))
    leave = marked.filter(F.col("high").isNotNull() & ~F.col("is_failed") & (F.col("at") > F.col("high"))).groupBy("task_id").agg(F.min("seq").alias("leave"))
    out = marked.join(leave, "task_id", "left")
    processed = F.col("high").isNull() | F.col("is_failed") | F.coalesce(F.col("seq") >= F.col("leave"), F.lit(False))
    return out.select(*[F.col(c) for c in events.columns], processed.alias("processed"))


def positions(events: DataFrame, task: Task, first_name: str, gate: str = "open", stretch: int = 1 << 20) -> DataFrame:
    """seq, name, pos after each event that moves a task's position: rotations to another file, and applied statements.

    Such events are rare beside rows, which are filtered out before anything is ordered; and they are ordered within
    stretches of `stretch` seqs, so that only a row a stretch comes together.
    """
    rotate = F.col("kind") == "rotate"
    query = (F.col("kind") == "query") & applied_queries(task, gate)
    moving = events.filter(rotate | query).select("seq", "log_pos", rotate.alias("rotate"), "next_log_name", "next_pos", F.floor(F.col("seq") / stretch).alias("stretch"))
    # the last rotation of each stretch of the log, carried on to the stretches after it, and the rotations within one
    name = F.when(F.col("rotate"), F.col("next_log_name"))
    ends = moving.groupBy("stretch").agg(F.max_by(name, F.when(name.isNotNull(), F.col("seq"))).alias("end"))
    ends = ends.select("stretch", F.last("end", True).over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = F.last(name, True).over(Window.partitionBy("stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    named = moving.withColumn("within", within).join(ends, "stretch").withColumn("before", F.coalesce("within", "carried", F.lit(first_name)))
    moves = named.filter(~F.col("rotate") | (F.col("next_log_name") != F.col("before")))
    pos = F.when(F.col("rotate") & (F.col("next_pos") != 0), F.col("next_pos")).otherwise(F.col("log_pos"))
    return moves.select("seq", F.when(F.col("rotate"), F.col("next_log_name")).otherwise(F.col("before")).alias("name"), pos.alias("pos"))


def last_marks(events: DataFrame, keep: int = 2) -> DataFrame:
    """The newest row events of each task, the marks that it holds. Spark limits each task's rows before the shuffle."""
    newest = Window.partitionBy("task_id").orderBy(F.col("seq").desc())
    return events.filter("kind = 'rows'").withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= keep).drop("n")


def mark_states(events: DataFrame, completed: DataFrame, keep: int = 2) -> DataFrame:
    """task_id and marks of each task, as start_position() and replay() take them: its newest row events, oldest first,
    each with whether it was completed. completed: task_id, log_file, log_pos of events that a sink has taken.
    """
    done = completed.select("task_id", "log_file", "log_pos").distinct().withColumn("success", F.lit(True))
    found = last_marks(events, keep).join(done, ["task_id", "log_file", "log_pos"], "left")
    mark = F.struct("seq", F.col("log_file").alias("pos_name"), F.col("log_pos").alias("pos"), F.coalesce("success", F.lit(False)).alias("success"))
    ordered = F.array_sort(F.collect_list(mark))  # `keep` of them
    return found.groupBy("task_id").agg(ordered.alias("m")).select("task_id", F.transform("m", lambda m: F.struct(m["pos_name"].alias("pos_name"), m["pos"].alias("pos"), m["success"].alias("success"))).alias("marks"))
