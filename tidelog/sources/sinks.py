"""Where change events go. A sink takes whole micro-batches; taking one again replaces it."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import FileConf, KafkaConf, Task, TaskError
from tidelog.operators.encode import messages


class Sink(Protocol):
    def open(self) -> None: ...

    def send(self, changes: DataFrame, batch: str) -> None: ...

    def close(self) -> None: ...


class FileSink:
    """Messages as files by topic; a batch has a folder of its own, so a repeated batch is there once."""

    def __init__(self, conf: FileConf):
        if not conf.path:
            raise TaskError("a file sink needs a path")
        self.path, self.format = conf.path.rstrip("/"), conf.format

    def open(self) -> None: ...

    def send(self, changes: DataFrame, batch: str) -> None:
        messages(changes).write.mode("overwrite").partitionBy("topic").format(self.format).save(f"{self.path}/batch={batch}")

    def close(self) -> None: ...


class KafkaSink:
    """Kafka with acknowledgement by all and five retries. Needs Spark's Kafka connector on the class path.

    A table's events have one key and so one partition. In order (the default) one task sends them one after another:
    a topic's partition takes them in the order in which they come, so no second task may send beside it, and a hot
    table is as fast as one producer. With ordered=False events keep their task, whatever table they are of, and have
    no key: they go to any partition, and receivers order them by log_pos where they need to.
    """

    format = "kafka"

    def __init__(self, conf: KafkaConf):
        if not conf.brokers:
            raise TaskError("a Kafka sink needs brokers")
        self.conf = conf

    def options(self) -> dict[str, str]:
        found = {"kafka.bootstrap.servers": ",".join(self.conf.brokers), "kafka.acks": "all", "kafka.retries": "5"}
        if self.conf.enable_sasl:
            escaped = [x.replace("\\", "\\\\").replace('"', '\\"') for x in (self.conf.user, self.conf.password)]
            login = 'org.apache.kafka.common.security.plain.PlainLoginModule required username="%s" password="%s";' % tuple(escaped)
            found |= {"kafka.security.protocol": "SASL_PLAINTEXT", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": login}
        return found

    def open(self) -> None: ...

    def send(self, changes: DataFrame, batch: str) -> None:
        rows = messages(changes)
        if self.conf.ordered:
            rows = rows.repartition("key").sortWithinPartitions("key", "seq", "row_index").select("topic", "key", "value")
        else:
            rows = rows.select("topic", F.lit(None).cast("string").alias("key"), "value")
        rows.write.format(self.format).mode("append").options(**self.options()).save()

    def close(self) -> None: ...


class UnsupportedSink:
    def __init__(self, kind: str):
        raise NotImplementedError(f"{kind} is not supported as a sink")


class SinkRegistry:
    """One sink a task; the first configured kind of kafka, nsq, mongo, es and files counts."""

    def __init__(self):
        self._sinks: dict[str, Sink] = {}

    def register(self, task: Task) -> Sink:
        if task.task_id in self._sinks:
            raise TaskError(f"task {task.task_id} has a sink already")
        kinds = [(task.kafka_conf, KafkaSink), (task.nsq_conf, lambda _: UnsupportedSink("nsq")), (task.mongo_db_conf, lambda _: UnsupportedSink("mongodb")), (task.es_conf, lambda _: UnsupportedSink("elasticsearch")), (task.file_conf, FileSink)]
        make = next(((conf, make) for conf, make in kinds if conf is not None), None)
        if make is None:
            raise TaskError(f"task {task.task_id} has no sink")
        sink = make[1](make[0])
        sink.open()
        self._sinks[task.task_id] = sink
        return sink

    def get(self, task_id: str) -> Sink:
        return self._sinks[task_id]

    def close(self, task_id: str) -> None:
        sink = self._sinks.pop(task_id, None)
        if sink:
            sink.close()


def read_files(spark, conf: FileConf) -> DataFrame:
    """What a file sink holds: topic, key, value, seq, row_index."""
    return spark.read.format(conf.format).schema("key string, value string, seq long, row_index long, topic string").option("basePath", conf.path).load(f"{conf.path}/batch=*").select("topic", "key", "value", "seq", F.col("row_index").cast("long").alias("row_index"))
