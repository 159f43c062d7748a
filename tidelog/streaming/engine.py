"""Tasks: create, list, stop, resume, resume from the latest, update, delete, and start again after a restart."""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidelog.model import Task, TaskError, TaskUpdate
from tidelog.sources.kv import KeyValueStore
from tidelog.sources.sinks import SinkRegistry
from tidelog.streaming.pipeline import ChangeFeed

PREFIX, MARKS = "task/", "marks/"
STATES = "task_id string, position_name string, position_pos long, marks array<struct<pos_name:string,pos:long,success:boolean>>"


class Metrics(StreamingQueryListener):
    """Totals by query name: batches, input rows, and the last error."""

    def __init__(self):
        self.by_task: dict[str, dict] = {}

    def _of(self, name: str | None) -> dict:
        return self.by_task.setdefault(name or "", {"batches": 0, "input_rows": 0, "running": 0, "error": None})

    def onQueryStarted(self, event) -> None:
        self._of(event.name)["running"] = 1
        self._names = getattr(self, "_names", {}) | {str(event.id): event.name}

    def onQueryProgress(self, event) -> None:
        m = self._of(event.progress.name)
        m["batches"] += 1
        m["input_rows"] += event.progress.numInputRows

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        m = self._of(getattr(self, "_names", {}).get(str(event.id)))
        m["running"], m["error"] = 0, event.exception

    def text(self) -> str:
        """Prometheus exposition."""
        lines = []
        for name, kind in (("batches", "counter"), ("input_rows", "counter"), ("running", "gauge")):
            lines.append(f"# TYPE tidelog_{name} {kind}")
            lines += [f'tidelog_{name}{{task="{t}"}} {m[name]}' for t, m in sorted(self.by_task.items())]
        return "\n".join(lines) + "\n"


class TaskEngine:
    """Runs tasks over one source and keeps them under root, which survives the driver.

    source(task, starting) gives the stream of raw events; starting is None, or "latest" for a task that starts over
    there. catalog() gives db, tbl, columns of the tables as first seen. State, checkpoint and registry are per task,
    so tasks over tables of one name don't meet; a task that is created again under the id of a deleted one has a home
    of its own. A task is registered before it starts and registered as stopped after it has stopped, so that a crash
    between leaves one that a restart finds. Delivery: a batch is sent again after a crash; file sinks then hold it once.
    Passwords are kept apart from the registry, in a folder that only its owner may read.
    """

    def __init__(self, spark: SparkSession, root: str, source: Callable[[Task, str | None], DataFrame], catalog: Callable[[Task], DataFrame], metrics: Metrics | None = None, **feed):
        self.spark, self.root, self.source, self.catalog, self.feed = spark, root.rstrip("/"), source, catalog, feed
        self.store, self.sinks = KeyValueStore(spark, f"{self.root}/registry"), SinkRegistry()
        self.secrets = KeyValueStore(spark, f"{self.root}/secrets", private=True)
        self.queries: dict[str, StreamingQuery] = {}
        self.errors: dict[str, str] = {}
        self.metrics = metrics
        if metrics:
            spark.streams.addListener(metrics)

    def _entry(self, task_id: str) -> dict:
        try:
            return self.store.get(PREFIX + task_id)
        except KeyError:
            raise TaskError(f"no task {task_id}") from None

    def _save(self, entry: dict) -> None:
        self.store.set(PREFIX + entry["task"]["task_id"], entry)

    def _task(self, entry: dict) -> Task:
        """The task of an entry, with its passwords."""
        try:
            return Task.from_dict(entry["task"]).with_passwords(self.secrets.get(PREFIX + entry["task"]["task_id"]))
        except KeyError:
            return Task.from_dict(entry["task"])

    def create(self, task: Task, once: bool = False) -> dict:
        task = task.validated()
        if self.store.prefix(PREFIX + task.task_id).get(PREFIX + task.task_id):
            raise TaskError(f"task {task.task_id} exists")
        entry = {"task": task.to_dict(secrets=False), "server_id": random.randrange(1, 1 << 32), "stopped": False, "run": 0, "starting": None, "home": f"{task.task_id}-{uuid.uuid4().hex[:8]}"}
        self.secrets.set(PREFIX + task.task_id, task.passwords())
        self._save(entry)
        try:
            self._start(entry, once)
        except Exception:
            self._forget(entry)
            raise
        return {"task_id": task.task_id, "server_id": entry["server_id"]}

    def _home(self, entry: dict) -> str:
        return f"{self.root}/tasks/{entry['home']}"

    def _start(self, entry: dict, once: bool) -> None:
        task = self._task(entry)
        sink = self.sinks.register(task)
        try:
            home, run = self._home(entry), entry["run"]
            handler = ChangeFeed(self.spark, lambda: Task.from_dict(self._current(task.task_id, entry)), sink, self.catalog(task), f"{home}/state", run=run, label=f"{entry['home']}-", marks=lambda marks: self._mark(task.task_id, marks), **self.feed)
            writer = self.source(task, entry["starting"]).writeStream.queryName(task.task_id).option("checkpointLocation", f"{home}/checkpoint-{run}").foreachBatch(handler)
            self.queries[task.task_id] = (writer.trigger(availableNow=True) if once else writer).start()
            self.errors.pop(task.task_id, None)
        except Exception as e:
            self.sinks.close(task.task_id)
            self.errors[task.task_id] = str(e)
            raise

    def _current(self, task_id: str, entry: dict) -> dict:
        try:
            return self.store.get(PREFIX + task_id)["task"]
        except KeyError:
            return entry["task"]

    def tasks(self) -> list[dict]:
        """All tasks without their secrets, with what their queries say."""
        out = []
        for key, entry in self.store.prefix(PREFIX).items():
            task_id = key.removeprefix(PREFIX)
            query = self.queries.get(task_id)
            error = query.exception() if query else None
            out.append({"task": Task.from_dict(entry["task"]).to_dict(secrets=False), "server_id": entry["server_id"], "stopped": entry["stopped"], "active": bool(query and query.isActive), "error": str(error) if error else self.errors.get(task_id), "progress": query.lastProgress if query else None})
        return out

    def _halt(self, task_id: str) -> None:
        query = self.queries.pop(task_id, None)
        if query:
            query.stop()
        self.sinks.close(task_id)

    def stop(self, task_id: str) -> None:
        entry = self._entry(task_id)
        self._halt(task_id)
        self._save(entry | {"stopped": True})

    def resume(self, task_id: str, once: bool = False) -> None:
        """Go on where the task stopped."""
        self._again(self._entry(task_id) | {"stopped": False}, once)

    def resume_latest(self, task_id: str, once: bool = False) -> None:
        """Go on at the log's latest position, with a new checkpoint and the column lists that the task has come to know."""
        entry = self._entry(task_id)
        self._again(entry | {"stopped": False, "run": entry["run"] + 1, "starting": "latest"}, once)

    def _again(self, entry: dict, once: bool) -> None:
        self._halt(entry["task"]["task_id"])
        self._save(entry)
        self._start(entry, once)

    def update(self, change: TaskUpdate) -> None:
        """New lists, which the next batch follows."""
        entry = self._entry(change.validated().task_id)
        self._save(entry | {"task": Task.from_dict(entry["task"]).updated(change).to_dict()})

    def delete(self, task_id: str) -> None:
        """Stop, and forget the task with its checkpoints, column lists and quarantine. What its sink holds stays."""
        entry = self._entry(task_id)
        self._halt(task_id)
        self._forget(entry)

    def _forget(self, entry: dict) -> None:
        task_id = entry["task"]["task_id"]
        self.store.delete(PREFIX + task_id)
        self.secrets.delete(PREFIX + task_id)
        self.store.delete(MARKS + task_id)
        home = self.store._path(self._home(entry))
        self.store._fs.delete(home, True)

    def recover_all(self, once: bool = False) -> dict[str, str | None]:
        """Start all tasks that aren't stopped, as after a restart; a task that fails doesn't keep others from starting."""
        found: dict[str, str | None] = {}
        for key, entry in self.store.prefix(PREFIX).items():
            task_id = key.removeprefix(PREFIX)
            if not entry["stopped"] and task_id not in self.queries:
                try:
                    self._start(entry, once)
                    found[task_id] = None
                except Exception as e:  # noqa: BLE001
                    found[task_id] = str(e)
        return found

    def _mark(self, task_id: str, marks: list[dict], keep: int = 2) -> None:
        """Keep a task's newest marks; a batch that runs again replaces its own."""
        try:
            old = self.store.get(MARKS + task_id)
        except KeyError:
            old = []
        here = {(m["pos_name"], m["pos"]) for m in marks}
        self.store.set(MARKS + task_id, ([m for m in old if (m["pos_name"], m["pos"]) not in here] + marks)[-keep:])

    def states(self) -> DataFrame:
        """Where each task is, as recovery.start_position() and replay() take it: its newest mark, and its marks."""
        found = [(k.removeprefix(MARKS), m[-1]["pos_name"], m[-1]["pos"], [(x["pos_name"], x["pos"], x["success"]) for x in m]) for k, m in self.store.prefix(MARKS).items()]
        return self.spark.createDataFrame(found, STATES)

    def feed_of(self, task_id: str) -> ChangeFeed:
        """The state of a task's feed, for its column lists and quarantine."""
        entry = self._entry(task_id)
        return ChangeFeed(self.spark, lambda: Task.from_dict(entry["task"]), None, self.catalog(self._task(entry)), f"{self._home(entry)}/state", run=entry["run"], **self.feed)

    def runtime(self) -> dict:
        """What the driver and the queries use just now."""
        jvm = self.spark.sparkContext._jvm
        memory, threads = jvm.Runtime.getRuntime(), jvm.Thread.activeCount()
        queries = {k: q.lastProgress for k, q in self.queries.items()}
        return {"heap_used": memory.totalMemory() - memory.freeMemory(), "heap_max": memory.maxMemory(), "threads": threads, "cores": self.spark.sparkContext.defaultParallelism, "queries": queries}

    def wait(self, task_id: str, seconds: float | None = None) -> None:
        """Until a task that runs once is through; raises what ended it."""
        self.queries[task_id].awaitTermination(seconds)
