"""The data model: raw log events, change events, tasks and their state."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

#: The log as it arrives. seq is the arrival order of a log; rows are positional cells.
RAW_EVENTS = (
    "seq long, log_file string, log_pos long, ts long, kind string, event_type string, db string, tbl string, "
    "rows array<array<string>>, query string, default_schema string, error_code int, next_log_name string, next_pos long"
)
COLUMNS = "array<struct<name:string,type:string,not_null:boolean>>"
INSERT, UPDATE, DELETE = "insert", "update", "delete"
#: Row event types by action; both versions of each.
EVENT_ACTIONS = {
    "WRITE_ROWS_EVENTv1": INSERT,
    "WRITE_ROWS_EVENTv2": INSERT,
    "UPDATE_ROWS_EVENTv1": UPDATE,
    "UPDATE_ROWS_EVENTv2": UPDATE,
    "DELETE_ROWS_EVENTv1": DELETE,
    "DELETE_ROWS_EVENTv2": DELETE,
}


class TaskError(ValueError):
    """A task or an update of one is not valid, or clashes with another."""


@dataclass(frozen=True)
class MySQLConfig:
    user: str = ""
    password: str = ""
    host: str = ""
    port: int = 3306


@dataclass(frozen=True)
class KafkaConf:
    """ordered: a table's events arrive in the order of the log, which takes one task a table; else they are spread."""

    brokers: tuple[str, ...] = ()
    enable_sasl: bool = False
    user: str = ""
    password: str = ""
    ordered: bool = True


@dataclass(frozen=True)
class FileConf:
    """Files of change events, one folder a topic; this engine's own sink."""

    path: str = ""
    format: str = "parquet"


@dataclass(frozen=True)
class Task:
    """What to read, which tables to keep, where to send. Empty lists keep everything.

    tables and exclude_table hold "db.table" or "db.*"; matching is exact, and exclusion wins.
    """

    task_id: str
    mysql: MySQLConfig = field(default_factory=MySQLConfig)
    database: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    exclude_table: tuple[str, ...] = ()
    kafka_conf: KafkaConf | None = None
    nsq_conf: dict | None = None
    mongo_db_conf: dict | None = None
    es_conf: dict | None = None
    file_conf: FileConf | None = None

    def validated(self) -> Task:
        if not self.task_id:
            raise TaskError("a task needs an id")
        return self

    def updated(self, change: TaskUpdate) -> Task:
        change.validated()
        return replace(self, database=change.database, tables=change.tables, exclude_table=change.exclude_table)

    def passwords(self) -> dict[str, str]:
        """By the part of the task that has them."""
        return {part: conf.password for part in ("mysql", "kafka_conf") if (conf := getattr(self, part)) and conf.password}

    def with_passwords(self, found: dict[str, str]) -> Task:
        return replace(self, **{part: replace(getattr(self, part), password=p) for part, p in found.items() if getattr(self, part)})

    def to_dict(self, secrets: bool = True) -> dict:
        return asdict(self if secrets else self.with_passwords(dict.fromkeys(self.passwords(), "***")))

    @staticmethod
    def from_dict(d: dict) -> Task:
        lists = {k: tuple(d.get(k) or ()) for k in ("database", "tables", "exclude_table")}
        kafka = d.get("kafka_conf")
        return Task(
            task_id=d.get("task_id", ""),
            mysql=MySQLConfig(**(d.get("mysql") or {})),
            kafka_conf=KafkaConf(**(kafka | {"brokers": tuple(kafka.get("brokers") or ())})) if kafka else None,
            nsq_conf=d.get("nsq_conf"),
            mongo_db_conf=d.get("mongo_db_conf"),
            es_conf=d.get("es_conf"),
            file_conf=FileConf(**d["file_conf"]) if d.get("file_conf") else None,
            **lists,
        )


@dataclass(frozen=True)
class TaskUpdate:
    task_id: str
    database: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    exclude_table: tuple[str, ...] = ()

    def validated(self) -> TaskUpdate:
        if not self.task_id:
            raise TaskError("an update needs a task id")
        return self


@dataclass(frozen=True)
class Mark:
    """An event in flight: its position and whether it was completed."""

    pos_name: str
    pos: int
    success: bool
