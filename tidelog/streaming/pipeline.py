"""The change feed as a streaming query: each micro-batch goes through the batch operators.

The schema history is state beside the stream: the column lists after a batch are a table named by the batch, written
whole before the sink gets the batch. A batch that runs again starts from the same earlier table and writes the same,
so the state is as exact as the sink.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.filters import is_kind
from tidelog.model import COLUMNS, Task
from tidelog.operators.decode import checked, decoded, quarantined, row_events
from tidelog.operators.schemas import ddl_changes, schema_versions, with_schema
from tidelog.sources.sinks import Sink

SCHEMA_STATE = f"db string, tbl string, columns {COLUMNS}"


def newest_marks(batch: DataFrame, keep: int = 2) -> list[dict]:
    """The newest row events of a batch, oldest first, as marks that aren't completed. Filters don't matter to marks."""
    newest = batch.filter(is_kind("rows")).orderBy(F.col("seq").desc()).limit(keep).select("log_file", "log_pos").collect()
    return [{"pos_name": r.log_file, "pos": r.log_pos, "success": False} for r in reversed(newest)]


#: Batches whose state stays: Spark runs at most the newest one again.
KEPT_STATES = 3


class ChangeFeed:
    """foreachBatch handler of one task. task() is asked for each batch, so its lists can change while it runs.

    run names the checkpoints of a task in order: a sink knows a batch by run and number, and a new run goes on with the
    column lists that the one before it has left.
    """

    def __init__(self, spark: SparkSession, task: Callable[[], Task], sink: Sink, catalog: DataFrame, path: str, mode: str = "compat", gate: str = "open", image_order: str = "after_first", run: int = 0, label: str = "", marks: Callable[[list[dict]], None] | None = None):
        """label goes before run in the names of a sink's batches. marks gets the newest row events of each batch before
        it is sent and, as completed, after that."""
        self.spark, self.task, self.sink, self.catalog, self.path = spark, task, sink, catalog, path.rstrip("/")
        self.mode, self.gate, self.image_order, self.run, self.label = mode, gate, image_order, run, label
        self.marks = marks
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, batch_id: int) -> str:
        return f"{self.run:06d}-{batch_id:012d}"

    def _states(self, before: str) -> list[str]:
        """Names of the complete states before a batch, oldest first. Few are ever there."""
        if not self._fs.exists(self._path(f"{self.path}/schemas")):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/schemas")))
        return [n for n in names if n < before and self._fs.exists(self._path(f"{self.path}/schemas/{n}/_SUCCESS"))]

    def _state_before(self, before: str) -> DataFrame:
        """Column lists after the newest earlier batch; tables that came to the catalog since are added."""
        earlier = self._states(before)
        if not earlier:
            return self.catalog
        state = self.spark.read.schema(SCHEMA_STATE).parquet(f"{self.path}/schemas/{earlier[-1]}")
        return state.unionByName(self.catalog.select("db", "tbl", "columns").join(state, ["db", "tbl"], "left_anti"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        task, name = self.task(), self._name(batch_id)
        marks = newest_marks(batch) if self.marks else []
        if marks:
            self.marks(marks)
        versions = schema_versions(ddl_changes(batch, task, self.mode, self.gate), self._state_before(name)).persist()
        after = versions.filter("to_seq is null").select("db", "tbl", "columns")
        after.write.mode("overwrite").parquet(f"{self.path}/schemas/{name}")
        # checked once: both what is set aside and what is sent are read from here
        rows = checked(with_schema(row_events(batch, task), versions)).drop("columns").persist()
        try:
            quarantined(rows).drop("names", "plain_names").write.mode("overwrite").parquet(f"{self.path}/quarantine/batch={name}")
            self.sink.send(decoded(rows, task.task_id, self.image_order), f"{self.label}{self.run}-{batch_id}")
        finally:
            rows.unpersist()
            versions.unpersist()
        if marks:
            self.marks([m | {"success": True} for m in marks])
        for old in self._states(name)[: -KEPT_STATES + 1]:
            self._fs.delete(self._path(f"{self.path}/schemas/{old}"), True)

    def schemas(self) -> DataFrame:
        """The column lists as of the newest batch."""
        return self._state_before("~")

    def quarantine(self) -> DataFrame:
        """Events that were set aside, with the reason and the batch."""
        return self.spark.read.option("basePath", f"{self.path}/quarantine").parquet(f"{self.path}/quarantine/batch=*")
