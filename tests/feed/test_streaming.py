"""Streams against their batch twins, restarts, the log source, the store, sinks and the task engine."""

import json
import os
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tests.feed.test_feed import raw, row_event, statement
from tidelog.model import FileConf, KafkaConf, MySQLConfig, RAW_EVENTS, Task, TaskError, TaskUpdate
from tidelog.operators import decode, encode, recovery, schemas
from tidelog.plans import seeds
from tidelog.sources.change_log import ChangeLogReader, ChangeLogSource, ServerLogSource, events_batch, file_order, jdbc_options, log_end, read_catalog, read_server_position, stream_events, whole_lines
from tidelog.sources.kv import KeyValueStore
from tidelog.sources.sinks import FileSink, KafkaSink, SinkRegistry, read_files
from tidelog.streaming.engine import Metrics, TaskEngine


def initial(spark):
    return spark.range(1).select(F.lit("shop").alias("db"), F.lit("t").alias("tbl"), seeds.columns(("id", "a")).alias("columns"))


def test_store(spark, tmp_path):
    kv = KeyValueStore(spark, f"file://{tmp_path}/kv")
    assert kv.prefix("") == {}
    kv.set("task/a", {"x": [1, "é"]})
    kv.set("task/b", 2)
    kv.set("other", None)
    kv.set("task/b", 3)
    assert kv.get("task/a") == {"x": [1, "é"]} and kv.prefix("task/") == {"task/a": {"x": [1, "é"]}, "task/b": 3}
    assert sorted((r.key, r.value) for r in kv.frame("task/").collect()) == [("task/a", '{"x": [1, "\\u00e9"]}'), ("task/b", "3")]
    kv.delete("task/a")
    with pytest.raises(KeyError):
        kv.get("task/a")


def test_sinks():
    registry = SinkRegistry()
    with pytest.raises(TaskError):
        registry.register(Task("none"))
    for kind in ("nsq_conf", "mongo_db_conf", "es_conf"):
        with pytest.raises(NotImplementedError):
            registry.register(Task("x", **{kind: {}}))
    task = Task("k", kafka_conf=KafkaConf(("h:9092",), True, "u", 'p"w'), file_conf=FileConf("/x"))
    assert isinstance(registry.register(task), KafkaSink)
    with pytest.raises(TaskError):
        registry.register(task)
    options = registry.get("k").options()
    assert options["kafka.acks"] == "all" and 'password="p\\"w"' in options["kafka.sasl.jaas.config"]
    registry.close("k")
    registry.register(task)


def write_log(tmp_path, name, events):
    names = [f.strip().split(" ")[0] for f in RAW_EVENTS.split(", ")]
    with open(tmp_path / name, "a") as f:
        for e in events:
            f.write(json.dumps({n: e.get(n) for n in names}) + "\n")


def test_log_source_resumes_by_file_and_position(spark, tmp_path):
    spark.dataSource.register(ChangeLogSource)
    log = tmp_path / "log"
    log.mkdir()
    write_log(log, "bin.000001.jsonl", [row_event(i, [[str(i), "é" * i]]) for i in range(1, 40)])

    def run(**options):
        stream = spark.readStream.format("change_log").option("path", str(log)).option("pieceBytes", 300)
        for k, v in options.items():
            stream = stream.option(k, v)
        stream.load().select("seq").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(1, 40))
    write_log(log, "bin.000001.jsonl", [row_event(i, [[str(i), "a"]]) for i in range(40, 45)])
    write_log(log, "bin.000002.jsonl", [row_event(i, [[str(i), "a"]]) for i in range(45, 50)])
    assert run() == list(range(1, 50))
    assert log_end(str(log)) == {"file": "bin.000002.jsonl", "pos": (log / "bin.000002.jsonl").stat().st_size}


def test_catalog_and_position_over_jdbc(spark):
    """The reads as they are, on the database that Spark brings along."""
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    options = {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark._jvm.java.lang.Class.forName(options["driver"])
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    for q in (
        "CREATE SCHEMA information_schema",
        "CREATE TABLE information_schema.columns (table_schema VARCHAR(9), table_name VARCHAR(9), ordinal_position BIGINT, column_name VARCHAR(9), column_type VARCHAR(20), is_nullable VARCHAR(3))",
        "INSERT INTO information_schema.columns VALUES ('shop', 't', 2, 'b', 'decimal(9,2)', 'NO'), ('shop', 't', 1, 'a', 'int', 'YES'), ('shop', 'u', 1, 'x', 'text', 'YES')",
        "CREATE TABLE master_status (file VARCHAR(20), position BIGINT)",
        "INSERT INTO master_status VALUES ('bin.000007', 4294967295)",
    ):
        con.createStatement().execute(q)
    config = MySQLConfig("", "", "h")
    found = {(r.db, r.tbl): [(c.name, c.type, c.not_null) for c in r.columns] for r in schemas.from_catalog(read_catalog(spark, config, options)).collect()}
    assert found == {("shop", "t"): [("a", "int", False), ("b", "decimal(9,2)", True)], ("shop", "u"): [("x", "text", False)]}
    assert read_server_position(spark, config, options | {"query": "SELECT file, position FROM master_status"}) == {"file": "bin.000007", "pos": 4294967295}
    assert jdbc_options(MySQLConfig("u", "p", "h", 33))["url"] == "jdbc:mysql://h:33/mysql"


def test_a_live_source_by_a_client(spark, tmp_path):
    """Positions as offsets: restarts go on where they were, and "latest" begins at the server's position."""
    spark.dataSource.register(ServerLogSource)
    log = tmp_path / "server"
    log.mkdir()
    write_log(log, "bin.000001", [row_event(i, [[str(i), "a"]]) for i in range(1, 6)])

    def run(name, **options):
        stream = spark.readStream.format("server_log").options(client="tests.feed.stand_in_server:Client", folder=str(log), **options)
        stream.load().select("seq", "rows").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp{name}")).option("path", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.schema("seq long").parquet(str(tmp_path / name)).collect())

    assert run("all") == [1, 2, 3, 4, 5] and run("new", startingOffset="latest") == []
    write_log(log, "bin.000001", [row_event(6, [["6", "a"]])])
    write_log(log, "bin.000002", [row_event(i, [[str(i), "a"]]) for i in (7, 8)])
    assert run("all") == list(range(1, 9)) and run("new", startingOffset="latest") == [6, 7, 8]
    assert run("all") == list(range(1, 9)) and run("some", startingOffset='{"file": "bin.000001", "pos": 4}') == [5, 6, 7, 8]


def engine(spark, tmp_path, log, **more):
    def source(task, starting):
        return stream_events(spark, str(log), "json").filter("seq >= 100") if starting == "latest" else stream_events(spark, str(log), "json")

    return TaskEngine(spark, f"file://{tmp_path}/engine", source, lambda task: initial(spark), **more)


def events_of(spark, conf):
    return sorted((r.seq, r.row_index, r.action, (r.after or r.before)["id"], len(r.after or r.before)) for r in encode.parsed(read_files(spark, conf)).collect())


def test_tasks_live_through_stop_update_and_restart(spark, tmp_path):
    log, conf = tmp_path / "log", FileConf(f"file://{tmp_path}/out")
    log.mkdir()
    write_log(log, "1.json", [row_event(1, [["1", "x"], ["2", "y"]]), statement(2, "alter table shop.t add b int"), row_event(3, [["3", "z", "9"]]), row_event(4, [["1", "x", None]], tbl="u")])
    metrics = Metrics()
    e = engine(spark, tmp_path, log, metrics=metrics)
    task = Task("task_001", MySQLConfig("u", "secret", "h"), database=("shop",), tables=("shop.t",), file_conf=conf)
    reply = e.create(task, once=True)
    assert reply["task_id"] == "task_001" and reply["server_id"] > 0
    e.wait("task_001", 120)
    want = [(1, 0, "insert", "1", 2), (1, 1, "insert", "2", 2), (3, 0, "insert", "3", 3)]
    assert events_of(spark, conf) == want
    with pytest.raises(TaskError):
        e.create(task)
    listed = e.tasks()[0]
    assert listed["task"]["mysql"]["password"] == "***" and not listed["stopped"]

    e.stop("task_001")
    assert e.tasks()[0]["stopped"] and e.recover_all() == {}
    write_log(log, "2.json", [row_event(5, [["5", "w", "1"]]), row_event(6, [["6", "w"]])])
    # a new engine over the same root, as after a restart: the schema history and the position are kept
    e = engine(spark, tmp_path, log)
    e.resume("task_001", once=True)
    e.wait("task_001", 120)
    want.append((5, 0, "insert", "5", 3))
    assert events_of(spark, conf) == want
    bad = e.feed_of("task_001").quarantine()
    assert [(r.seq, r.reason) for r in bad.collect()] == [(6, "wrong number of cells")]

    e.update(TaskUpdate("task_001", ("shop",), (), ("shop.t",)))
    write_log(log, "3.json", [row_event(7, [["7", "w", "1"]])])
    e._halt("task_001")
    assert engine(spark, tmp_path, log).recover_all(once=True) == {"task_001": None}
    for q in spark.streams.active:
        q.awaitTermination(120)
    assert events_of(spark, conf) == want  # the update excluded the table

    e = engine(spark, tmp_path, log)
    assert [p.name for p in (tmp_path / "engine/tasks").iterdir()] == [e._entry("task_001")["home"]]
    e.delete("task_001")
    assert e.tasks() == [] and not list((tmp_path / "engine/tasks").iterdir()) and e.secrets.prefix("") == {}
    with pytest.raises(TaskError):
        e.resume("task_001")
    assert 'tidelog_input_rows{task="task_001"}' in metrics.text()


def test_a_deleted_task_can_be_created_again(spark, tmp_path):
    """The new task has nothing of the old one: it starts at the beginning, from the catalog."""
    log, conf = tmp_path / "log", FileConf(f"file://{tmp_path}/out")
    log.mkdir()
    write_log(log, "1.json", [row_event(1, [["1", "x"]]), statement(2, "alter table shop.t add b int"), row_event(3, [["3", "z", "9"]])])
    e, want = engine(spark, tmp_path, log), [(1, 0, "insert", "1", 2), (3, 0, "insert", "3", 3)]
    for times in (1, 2):
        e.create(Task("t", file_conf=conf), once=True)
        e.wait("t", 120)
        assert events_of(spark, conf) == sorted(want * times)  # a sink keeps what it was sent before
        e.delete("t")


def test_crashes_between_the_steps_of_a_task(spark, tmp_path, monkeypatch):
    log, conf = tmp_path / "log", FileConf(f"file://{tmp_path}/out")
    log.mkdir()
    write_log(log, "1.json", [row_event(1, [["1", "x"]])])
    e = engine(spark, tmp_path, log)

    class Crash(BaseException):
        """Ends the driver, so that nothing after it runs."""

    def crash(*_):
        raise Crash

    with monkeypatch.context() as m, pytest.raises(Crash):  # registered, but not started yet
        m.setattr(TaskEngine, "_start", crash)
        e.create(Task("t", MySQLConfig(password="pw"), file_conf=conf))
    e = engine(spark, tmp_path, log)
    assert e.recover_all(once=True) == {"t": None} and e._task(e._entry("t")).mysql.password == "pw"
    e.wait("t", 120)
    assert [r[0] for r in events_of(spark, conf)] == [1]
    with monkeypatch.context() as m, pytest.raises(Crash):  # halted, but not yet marked as stopped
        m.setattr(TaskEngine, "_save", crash)
        e.stop("t")
    e = engine(spark, tmp_path, log)
    assert e.recover_all(once=True) == {"t": None}
    e.wait("t", 120)
    with monkeypatch.context() as m, pytest.raises(Crash):  # a registry that was being written
        m.setattr(KeyValueStore, "_file", crash)
        e.store.set("task/t", {})
    assert engine(spark, tmp_path, log).tasks()[0]["task"]["task_id"] == "t"
    with pytest.raises(NotImplementedError):
        e.create(Task("n", nsq_conf={}))
    assert len(e.tasks()) == 1  # what can't start isn't kept


def test_marks_of_a_batch_that_was_not_sent(spark, tmp_path, monkeypatch):
    """They stay failed until the batch is sent; by them a replay knows what to send again."""
    log, conf = tmp_path / "log", FileConf(f"file://{tmp_path}/out")
    log.mkdir()
    write_log(log, "1.json", [row_event(i, [[str(i), "x"]]) for i in (1, 2, 3)])
    e = engine(spark, tmp_path, log)
    assert e.states().collect() == []
    e.create(Task("t", tables=("shop.none",), file_conf=conf), once=True)  # filtered events are marked too
    e.wait("t", 120)
    marks = lambda: [(m.pos, m.success) for m in e.states().first().marks]
    assert marks() == [(20, True), (30, True)]
    write_log(log, "2.json", [row_event(4, [["4", "x"]])])
    with monkeypatch.context() as m:
        m.setattr(FileSink, "send", lambda *_: 1 / 0)
        e.resume("t", once=True)
        with pytest.raises(StreamingQueryException):
            e.wait("t", 120)
    assert marks() == [(30, True), (40, False)]
    start = recovery.start_position(e.states()).first()
    assert (start.source, start.start_pos, start.high_water) == ("marks", 30, 40)
    again = raw(spark, [row_event(i, [["1", "x"]]) for i in (3, 4, 5)]).withColumn("task_id", F.lit("t"))
    assert {r.seq: r.processed for r in recovery.replay(again, e.states()).collect()} == {3: False, 4: True, 5: True}
    e.resume("t", once=True)
    e.wait("t", 120)
    assert marks() == [(30, True), (40, True)]
    e.delete("t")
    assert e.states().collect() == []


def test_passwords_stay_out_of_the_registry(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    e = engine(spark, tmp_path, log)
    e.create(Task("t", MySQLConfig("u", "secret1"), file_conf=FileConf(f"file://{tmp_path}/o")), once=True)
    e.update(TaskUpdate("t", ("shop",)))
    assert "secret1" not in "".join(p.read_text() for p in (tmp_path / "engine/registry").glob("*.json"))
    assert (tmp_path / "engine/secrets").stat().st_mode & 0o77 == 0
    assert e._task(e._entry("t")).mysql.password == "secret1"
    e.wait("t", 120)


def test_the_store_keeps_the_newest_whole_version(spark, tmp_path):
    kv = KeyValueStore(spark, f"file://{tmp_path}/kv")
    for i in range(12):
        kv.set("a/b", i)
    (tmp_path / "kv" / ".a%2Fb.x.part").write_text("{")  # a writer that died
    names = sorted(p.name for p in (tmp_path / "kv").iterdir() if p.name.endswith(".json"))
    assert names == ["a%2Fb~000000000011.json"] and kv.get("a/b") == 11
    (tmp_path / "kv" / "a%2Fb~000000000010.json").write_text('{"key": "a/b", "value": "10"}')  # or before it deleted the old one
    assert kv.prefix("a") == {"a/b": 11} and [r.value for r in kv.frame().collect()] == ["11"]
    kv.delete("a/b")
    assert kv.prefix("") == {} and kv.frame().collect() == []


def test_log_files_by_number_and_whole_lines(spark, tmp_path):
    names = ["bin.999999.jsonl", "bin.1000000.jsonl", "bin.000002.jsonl"]
    assert sorted(names, key=file_order) == ["bin.000002.jsonl", "bin.999999.jsonl", "bin.1000000.jsonl"]
    for n, seq in zip(names, (2, 3, 1)):
        write_log(tmp_path, n, [row_event(seq, [["1", None]])])
    end = log_end(str(tmp_path))
    with open(tmp_path / names[1], "a") as f:
        f.write('{"seq": 4, "kin' + "x" * 100_000)  # being written
    assert log_end(str(tmp_path)) == end and end["file"] == names[1]
    reader = ChangeLogReader({"path": str(tmp_path)})
    got = [r for p in reader.partitions({"file": names[0], "pos": 0}, end) for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["seq"] for r in got) == [2, 3]
    odd = events_batch([{"seq": 1, "rows": [[1, None, "x", 2.5], None]}]).to_pylist()[0]["rows"]
    assert odd == [["1", None, "x", "2.5"], None] and whole_lines(os.devnull) == 0


class _Taken(DataSourceWriter):
    def __init__(self, options):
        self.folder = options["folder"]

    def write(self, rows):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps([r.asDict() for r in rows]))
        return WriterCommitMessage()


class KafkaStandIn(DataSource):
    """Takes what the sink sends, a file a task."""

    @classmethod
    def name(cls):
        return "kafka_stand_in"

    def writer(self, schema, overwrite):
        assert not overwrite and self.options["kafka.bootstrap.servers"] == "h:1,i:2" and [f.name for f in schema] == ["topic", "key", "value"]
        return _Taken(self.options)


@pytest.mark.parametrize("ordered", [True, False])
def test_kafka_messages(spark, tmp_path, monkeypatch, ordered):
    spark.dataSource.register(KafkaStandIn)
    sink = KafkaSink(KafkaConf(("h:1", "i:2"), ordered=ordered))
    options = sink.options()
    monkeypatch.setattr(sink, "format", "kafka_stand_in")
    monkeypatch.setattr(sink, "options", lambda: options | {"folder": str(tmp_path)})
    log = raw(spark, [row_event(i, [[str(i), "x"], [str(i), "y"]], tbl="tu"[i % 2]) for i in range(60)]).repartition(5)
    rows = decode.row_events(log, Task("k")).withColumn("columns", seeds.columns(("id", "a")))
    sink.send(decode.decoded(rows, "k"), "0-0")
    tasks = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    sent = [(m["topic"], m["key"], json.loads(m["value"])) for t in tasks for m in t]
    assert len(sent) == 120 and {m[0] for m in sent} == {"k.shop.t", "k.shop.u"} and {m[1] for m in sent} == ({"shop.t", "shop.u"} if ordered else {None})
    if ordered:
        for key in ("shop.t", "shop.u"):
            per_task = [[int(json.loads(m["value"])["after"]["id"]) for m in t if m["key"] == key] for t in tasks]
            assert [p for p in per_task if p] == [sorted(x for p in per_task for x in p)]


def test_resume_from_the_latest(spark, tmp_path):
    log, conf = tmp_path / "log", FileConf(f"file://{tmp_path}/out")
    log.mkdir()
    write_log(log, "1.json", [row_event(1, [["1", "x"]]), row_event(101, [["101", "x"]])])
    e = engine(spark, tmp_path, log)
    e.create(Task("t", file_conf=conf), once=True)
    e.wait("t", 120)
    conf_rows = events_of(spark, conf)
    assert [r[0] for r in conf_rows] == [1, 101]
    e.resume_latest("t", once=True)
    e.wait("t", 120)
    assert [r[0] for r in events_of(spark, conf)] == [1, 101, 101]  # the new run reads from the latest on, beside the old one


def test_resume_from_the_latest_keeps_the_column_lists(spark, tmp_path):
    log, conf = tmp_path / "log", FileConf(f"file://{tmp_path}/out")
    log.mkdir()
    write_log(log, "1.json", [row_event(1, [["1", "x"]]), statement(2, "alter table shop.t add b int")])
    e = engine(spark, tmp_path, log)
    e.create(Task("t", file_conf=conf), once=True)
    e.wait("t", 120)
    for seq in range(100, 106):  # so many batches that old states go
        write_log(log, f"{seq}.json", [row_event(seq, [[str(seq), "x", "y"]])])
        (e.resume_latest if seq == 100 else e.resume)("t", once=True)
        e.wait("t", 120)
    assert [(r[0], r[4]) for r in events_of(spark, conf)] == [(1, 2)] + [(seq, 3) for seq in range(100, 106)]
    assert len(list((tmp_path / "engine/tasks").glob("*/state/schemas/*"))) <= 3
    assert [c.name for c in e.feed_of("t").schemas().first().columns] == ["id", "a", "b"]


def test_a_failing_task_does_not_stop_others(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    e = engine(spark, tmp_path, log)
    e.store.set("task/bad", {"task": Task("bad", nsq_conf={}).to_dict(), "server_id": 1, "stopped": False, "run": 0, "starting": None, "home": "bad"})
    e.store.set("task/good", {"task": Task("good", file_conf=FileConf(f"file://{tmp_path}/o")).to_dict(), "server_id": 1, "stopped": False, "run": 0, "starting": None, "home": "good"})
    found = e.recover_all(once=True)
    assert found["good"] is None and "not supported" in found["bad"]
    e.wait("good", 120)


def test_split_logs_and_reruns_give_one_result(spark, tmp_path):
    """The same events in one file or five, with a batch run twice, are sent once each."""
    events = [statement(20, "alter table shop.t add b int"), statement(30, "alter table shop.t drop a")] + [row_event(i, [[str(i), "x"] if i <= 20 else [str(i), "x", "y"] if i <= 30 else [str(i), "y"]]) for i in range(1, 45) if i not in (20, 30)]
    events.sort(key=lambda e: e["seq"])
    found = []
    for files in (1, 5):
        home = tmp_path / str(files)
        (home / "log").mkdir(parents=True)
        conf = FileConf(f"file://{home}/out")
        e = engine(spark, home, home / "log")
        e.create(Task("t", file_conf=conf), once=True)
        e.wait("t", 120)
        size = -(-len(events) // files)
        for k in range(files):
            write_log(home / "log", f"{k}.json", events[k * size : (k + 1) * size])
            e.resume("t", once=True)
            e.wait("t", 120)
        found.append(events_of(spark, conf))
    assert found[0] == found[1] and len(found[0]) == 42
    sink = e.sinks.get("t")
    sink.send(spark.createDataFrame([], "x int").select(*[F.lit(None).cast(t).alias(n) for n, t in [("database", "string"), ("table", "string"), ("action", "string"), ("before", "map<string,string>"), ("after", "map<string,string>"), ("org_row", "array<array<string>>"), ("event_header", "struct<timestamp:bigint,log_pos:bigint>"), ("topic", "string"), ("key", "string"), ("seq", "long"), ("row_index", "long")]]).limit(0), f"{e._entry('t')['home']}-0-1")
    assert len(events_of(spark, conf)) < 42  # a batch that is sent again takes its own place
