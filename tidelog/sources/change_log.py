"""Change logs as streams and tables: folders of raw-event files, a log source with file and position offsets, catalogs over JDBC."""

from __future__ import annotations

import importlib
import json
import os
import re
from collections.abc import Iterator
from itertools import islice
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidelog.model import RAW_EVENTS, MySQLConfig


def read_events(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spark.read.schema(RAW_EVENTS).format(format).load(path)


def stream_events(spark: SparkSession, path: str, format: str = "parquet", files_per_batch: int = 1_000) -> DataFrame:
    """A folder into which files of raw events arrive in the order of the log."""
    return spark.readStream.schema(RAW_EVENTS).format(format).option("maxFilesPerTrigger", files_per_batch).load(path)


def file_order(name: str) -> list[tuple[str, int]]:
    """Names in the order of the log: numbers count as such, so that a number may gain a digit."""
    return [(text, int(digits or 0)) for text, digits in re.findall(r"(\D*)(\d*)", name)]


def whole_lines(path: str, block: int = 1 << 16) -> int:
    """Where the last whole line of a file ends."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > 0:
            start = max(0, at - block)
            f.seek(start)
            found = f.read(at - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
    return 0


ARROW_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}


def events_batch(events: list[dict]) -> pa.RecordBatch:
    """Raw events as Arrow; cells that aren't text (numbers, say) become their JSON."""
    schema = pa.schema([(n, ARROW_TYPES[t]) for n, t in (f.split(" ", 1) for f in RAW_EVENTS.split(", "))])
    try:
        return pa.RecordBatch.from_pylist(events, schema)
    except (pa.ArrowTypeError, pa.ArrowInvalid):
        text = lambda c: c if c is None or isinstance(c, str) else json.dumps(c)
        plain = [e | {"rows": None if e.get("rows") is None else [None if r is None else [text(c) for c in r] for r in e["rows"]]} for e in events]
        return pa.RecordBatch.from_pylist(plain, schema)


class _Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ChangeLogReader(DataSourceStreamReader):
    """Offsets are {"file", "pos"}: events after pos in file, or in files after it, are still to come.

    Files are planned on the driver by size and read in pieces on the executors.
    """

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.piece_bytes = int(options.get("piecebytes", 32 << 20))
        self.starting = options.get("startingoffset", "earliest")

    def _files(self) -> list[str]:
        return sorted((n for n in os.listdir(self.path) if n.endswith(".jsonl")), key=file_order)

    def _end(self) -> dict:
        """After the last whole line of the last file, which may still be written to."""
        files = self._files()
        return {"file": files[-1], "pos": whole_lines(f"{self.path}/{files[-1]}")} if files else {"file": "", "pos": 0}

    def initialOffset(self) -> dict:
        if self.starting == "latest":
            return self._end()
        if self.starting == "earliest":
            return {"file": "", "pos": 0}
        return json.loads(self.starting)

    def latestOffset(self) -> dict:
        return self._end()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, first, last = [], file_order(start["file"]), file_order(end["file"])
        for name in self._files():
            if first <= file_order(name) <= last:
                a = start["pos"] if name == start["file"] else 0
                b = end["pos"] if name == end["file"] else os.path.getsize(f"{self.path}/{name}")
                out += [_Piece(f"{self.path}/{name}", x, min(b, x + self.piece_bytes)) for x in range(a, b, self.piece_bytes)]
        return out

    def read(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the piece, some thousands at a time."""
        events = []
        with open(piece.path, "rb") as f:
            f.seek(max(0, piece.start - 1))
            if piece.start:
                f.readline()
            while f.tell() < piece.end and (line := f.readline()):
                events.append(json.loads(line))
                if len(events) == 4_096:
                    yield events_batch(events)
                    events = []
        if events:
            yield events_batch(events)


class ChangeLogSource(DataSource):
    """format("change_log"): a folder of *.jsonl log files, one raw event a line, named in the order of the log.

    Options: path (mounted by driver and executors), startingOffset ("earliest", "latest" or {"file", "pos"}; pos is a
    byte), pieceBytes. Any client that writes such files feeds it; one that is asked is a ServerLogSource.
    """

    @classmethod
    def name(cls) -> str:
        return "change_log"

    def schema(self) -> str:
        return RAW_EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeLogReader({k.lower(): v for k, v in self.options.items()})


class LogClient(Protocol):
    """What a live source needs of a replication client. Positions are {"file", "pos"}; a position is that of the next event."""

    def position(self) -> dict:
        """Where the server's log ends just now."""

    def first(self) -> dict:
        """Where the oldest log that the server still has begins."""

    def events(self, start: dict, end: dict) -> Iterator[dict]:
        """The raw events from start up to end, in order; the same ones each time it is asked."""


def _client(options: dict) -> LogClient:
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)(options)


class _Span(InputPartition):
    def __init__(self, start: dict, end: dict):
        self.start, self.end = start, end


class ServerLogReader(DataSourceStreamReader):
    """A server's log is one sequence over one connection, so a batch is one partition."""

    def __init__(self, options: dict):
        self.options, self.starting = options, options.get("startingoffset", "earliest")

    def initialOffset(self) -> dict:
        if self.starting in ("earliest", "latest"):
            client = _client(self.options)
            return client.first() if self.starting == "earliest" else client.position()
        return json.loads(self.starting)

    def latestOffset(self) -> dict:
        return _client(self.options).position()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(start, end)] if start != end else []

    def read(self, span: _Span) -> Iterator[pa.RecordBatch]:
        events = _client(self.options).events(span.start, span.end)
        while found := list(islice(events, 4_096)):
            yield events_batch(found)


class ServerLogSource(DataSource):
    """format("server_log"): a server's log by a replication client. Options: client ("module:factory", which gets the
    options and gives a LogClient, on the driver and on executors), startingOffset as for change_log, and the client's own.
    """

    @classmethod
    def name(cls) -> str:
        return "server_log"

    def schema(self) -> str:
        return RAW_EVENTS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ServerLogReader({k.lower(): v for k, v in self.options.items()})


def log_end(path: str) -> dict:
    """The latest position of a log folder, as a starting offset."""
    return ChangeLogReader({"path": path}).latestOffset()


def jdbc_options(config: MySQLConfig) -> dict[str, str]:
    return {"url": f"jdbc:mysql://{config.host}:{config.port}/mysql", "user": config.user, "password": config.password, "numPartitions": "1", "driver": "com.mysql.cj.jdbc.Driver"}


CATALOG_SQL = "SELECT table_schema AS db, table_name AS tbl, ordinal_position AS ordinal, column_name AS field, column_type AS type, is_nullable AS nullable FROM information_schema.columns"
POSITION_SQL = "SHOW MASTER STATUS"


def _jdbc(spark: SparkSession, config: MySQLConfig, query: str, options: dict[str, str] | None) -> DataFrame:
    found = spark.read.format("jdbc").options(**jdbc_options(config) | {"query": query} | (options or {})).load()
    return found.toDF(*[c.lower() for c in found.columns])


def read_catalog(spark: SparkSession, config: MySQLConfig, options: dict[str, str] | None = None) -> DataFrame:
    """The server's columns as a catalog table (needs the server's JDBC driver on the class path). options go over the
    connection's own: another url, driver or query."""
    found = _jdbc(spark, config, CATALOG_SQL, options)
    return found.withColumn("ordinal", F.col("ordinal").cast("int")).withColumnRenamed("nullable", "null")


def read_server_position(spark: SparkSession, config: MySQLConfig, options: dict[str, str] | None = None) -> dict:
    """The latest position of the server's log, as a starting offset."""
    row = _jdbc(spark, config, POSITION_SQL, options).select("file", F.col("position").cast("long").alias("pos")).first()
    return {"file": row.file, "pos": row.pos}
