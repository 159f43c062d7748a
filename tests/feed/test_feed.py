"""Filters, DDL, schema history, decoding, recovery: truth tables and golden lists, and properties over random logs."""

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.functions import ddl
from tidelog.functions.filters import action_of, kept_rows
from tidelog.model import COLUMNS, RAW_EVENTS, Task, TaskError, TaskUpdate
from tidelog.operators import decode, encode, recovery, schemas, views
from tidelog.plans import catalog, seeds


def raw(spark, rows):
    """rows: dicts of raw event fields."""
    names = [f.strip().split(" ")[0] for f in RAW_EVENTS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_EVENTS)


def row_event(seq, rows, event_type="WRITE_ROWS_EVENTv2", db="shop", tbl="t", **more):
    return {"seq": seq, "log_file": "bin.000001", "log_pos": seq * 10, "ts": 1624355996, "kind": "rows", "event_type": event_type, "db": db, "tbl": tbl, "rows": rows, **more}


def statement(seq, query, schema="shop", error_code=0):
    return {"seq": seq, "log_file": "bin.000001", "log_pos": seq * 10, "kind": "query", "query": query, "default_schema": schema, "error_code": error_code}


@pytest.mark.parametrize(
    ("database", "tables", "exclude", "kept", "dropped"),
    [
        ([], [], [], ["a.t"], []),
        (["a"], [], [], ["a.t"], ["b.t"]),
        (["a"], ["a.*"], [], ["a.t"], ["b.t"]),
        (["a"], ["a.t"], [], ["a.t"], ["a.u"]),
        ([], ["a.t"], [], ["a.t"], ["b.t"]),
        (["a"], ["b.t"], [], [], ["a.t", "b.t"]),
        (["a"], ["a.*"], ["a.t"], ["a.u"], ["a.t"]),
        (["a"], ["a.t"], ["a.*"], [], ["a.t"]),
        (["a"], ["t"], [], [], ["a.t"]),
        (["A"], [], [], [], ["a.t"]),
        ([], [], ["*.t"], ["a.t"], []),
    ],
)
def test_filter_truth_table(spark, database, tables, exclude, kept, dropped):
    df = spark.createDataFrame([tuple(x.split(".")) for x in kept + dropped] + [(None, "t"), ("a", None)], "db string, tbl string")
    task = Task("t", database=tuple(database), tables=tuple(tables), exclude_table=tuple(exclude))
    assert sorted(f"{r.db}.{r.tbl}" for r in df.filter(kept_rows(task)).collect()) == sorted(kept)


def test_filters_reach_the_scan(spark, tmp_path):
    seeds.orders_log(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "log"))
    rows = decode.row_events(spark.read.parquet(str(tmp_path / "log")), catalog.FILTERED)
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    pushed = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert "In(db, [db0,db1,db2])" in pushed and "EqualTo(kind,rows)" in pushed


def test_actions(spark):
    df = spark.createDataFrame([("WRITE_ROWS_EVENTv1",), ("UPDATE_ROWS_EVENTv2",), ("DELETE_ROWS_EVENTv2",), ("XID_EVENT",), (None,)], "e string")
    assert [r[0] for r in df.select(action_of("e")).collect()] == ["insert", "update", "delete", "", ""]


#: Column lists after each statement that changes or moves them, each alone over the start columns.
FOLDED = {
    1: "id,kind,host,page,lang,total", 3: "id,kind,host,lang,num", 4: "id,kind,host,page,lang,num,note", 5: "id,kind,host,age,page,lang,num", 6: "flag,id,kind,host,page,lang,num", 7: "id,kind,host,page,lang,num",
    9: "id,kind,host,page,lang", 10: "id,kind,host,page,lang,num,via", 12: "id,kind,host,page,lang,num", 13: "id,kind,host,page,lang,num,INDEX", 14: "id,kind,host,page,lang,num,a", 17: "id,kind,host,page,lang,num", 20: "id,kind,host,page,lang,num",
}


def visits(spark):
    return spark.range(1).select(F.lit("shop").alias("db"), F.lit("visit").alias("tbl"), seeds.columns(seeds.START_COLUMNS).alias("columns"))


def test_golden_statements_alone(spark):
    got = {}
    for i, q in seeds.STATEMENTS:
        last = schemas.schema_versions(schemas.ddl_changes(raw(spark, [statement(i, q)]), Task("t", database=("shop",))), visits(spark)).filter("to_seq is null").first()
        if last.version:
            got[i] = ",".join(c.name for c in last.columns)
            assert [c.name for c in last.old] == list(seeds.START_COLUMNS)
    assert got == FOLDED


def test_golden_statements_one_after_another(spark):
    """The whole list folds in order, with old lists following."""
    events = raw(spark, [statement(i, q) for i, q in seeds.STATEMENTS])
    versions = schemas.schema_versions(schemas.ddl_changes(events, Task("t", database=("shop",))), visits(spark)).orderBy("version").collect()
    names = lambda cs: [c.name for c in cs]
    assert names(versions[0].columns) == list(seeds.START_COLUMNS) and versions[0].from_seq == -1
    for a, b in zip(versions, versions[1:]):
        assert names(b.old) == names(a.columns) and a.to_seq == b.from_seq
    assert versions[-1].to_seq is None
    assert names(versions[-1].columns) == ["flag", "id", "kind", "host", "age", "lang", "total", "note", "via", "INDEX", "a"]
    assert [v.from_seq for v in versions[1:]] == [1, 3, 4, 5, 6, 7, 9, 10, 12, 13, 14, 20]  # 17 adds what 14 has added


def test_strict_statements(spark):
    cases = {
        "ALTER  TABLE `shop`.`t`  CHANGE COLUMN `b` b2 decimal(10,2) NULL;": ["a", "b2", "c"],
        "alter table t add column x int after a, drop b, rename column c to c2": ["a", "x", "c2"],
        "alter table t add x enum('p','q') first, add index ix (a, b), drop primary key": ["x", "a", "b", "c"],
        "/* x, y */ alter table t modify b int -- no": ["a", "b", "c"],
        "create table z (a int)": ["a", "b", "c"],
    }
    initial = spark.range(1).select(F.lit("shop").alias("db"), F.lit("t").alias("tbl"), seeds.columns(("a", "b", "c")).alias("columns"))
    for q, want in cases.items():
        versions = schemas.schema_versions(schemas.ddl_changes(raw(spark, [statement(5, q)]), Task("t"), "strict"), initial)
        assert [c.name for c in versions.filter("to_seq is null").first().columns] == want, q


def test_types_survive_a_change_and_catalog_reads(spark):
    rows = [("shop", "t", 2, "b", "int", "YES"), ("shop", "t", 1, "a", "varchar(9)", "No")]
    initial = schemas.from_catalog(spark.createDataFrame(rows, "db string, tbl string, ordinal int, field string, type string, null string"))
    v = schemas.schema_versions(schemas.ddl_changes(raw(spark, [statement(1, "alter table t change b z bigint")]), Task("t")), initial)
    assert [(c.name, c.type, c.not_null) for c in v.filter("to_seq is null").first().columns] == [("a", "varchar(9)", True), ("z", "int", False)]


def test_after_a_name_that_two_columns_have(spark):
    """A statement adds one column: after the first."""
    queries = ["alter table shop.visit change page host", "alter table shop.visit add x int after host"]
    versions = schemas.schema_versions(schemas.ddl_changes(raw(spark, [statement(i, q) for i, q in enumerate(queries)]), Task("t")), visits(spark))
    assert [c.name for c in versions.filter("to_seq is null").first().columns] == ["id", "kind", "host", "x", "host", "lang", "num"]


def test_changes_in_python_are_those_in_sql(spark):
    r = random.Random(3)
    name = lambda: r.choice(["a", "b", "c", "d", None])
    rows = []
    for i in range(600):
        columns = None if i % 50 == 0 else [(name() or "a" if i % 3 else name(), "t", True) for _ in range(r.randrange(5))]
        rows.append((i, columns, (r.choice(["add", "add", "drop", "change"]), name(), name(), r.choice(["first", "after", "last", None]), name())))
    df = spark.createDataFrame(rows, f"i int, columns {COLUMNS}, change {ddl.CHANGE}")
    got = df.select("i", ddl.shifts(F.col("columns"), F.col("change")).alias("moved"), ddl.applied(F.col("columns"), F.col("change")).alias("c")).collect()
    for r in got:
        _, columns, change = rows[r.i]
        moved, after = ddl.moved(columns, *change)
        assert moved == bool(r.moved), rows[r.i]
        assert not moved or after == (None if r.c is None else [tuple(c) for c in r.c]), rows[r.i]


def test_a_long_history_folds_in_time(spark):
    """Three tables of the catalog, one twice and one without changes, and one that it lacks; 20,000 changes a table."""
    n = 20_000
    k = F.col("id")
    change = F.struct(F.when(k % 2 == 0, "add").otherwise("drop").alias("action"), F.concat(F.lit("n"), F.floor(k / 2) % 7).alias("name"), F.lit(None).cast("string").alias("new_name"), F.lit("last").alias("place"), F.lit(None).cast("string").alias("after"))
    steps = spark.range(n).crossJoin(spark.createDataFrame([("a",), ("b",), ("lost",)], "db string")).select(k.alias("seq"), "db", F.lit("t").alias("tbl"), F.lit(0).alias("step"), change.alias("change"))
    initial = spark.createDataFrame([("a", "t", [("x", "int", True)]), ("b", "t", []), ("b", "t", [("y", "", False)]), ("c", "t", [("z", "", False)])], f"db string, tbl string, columns {COLUMNS}")
    stop = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = schemas.schema_versions(steps, initial).collect()
    finally:
        stop.cancel()
    found = Counter((r.db, r.version, r.from_seq, r.to_seq, tuple(map(tuple, r.old)), tuple(map(tuple, r.columns))) for r in got)
    want = Counter({("c", 0, -1, None, (), (("z", "", False),)): 1})
    for db, first in (("a", (("x", "int", True),)), ("b", ()), ("b", (("y", "", False),))):
        lists = [first if i % 2 == 0 else (*first, (f"n{i // 2 % 7}", "", False)) for i in range(n + 1)]
        want.update((db, i, i - 1, i if i < n else None, lists[i - 1] if i else (), lists[i]) for i in range(n + 1))
    assert found == want


def changes(spark, rows, columns=("id", "p_type", "v0"), **more):
    r = decode.row_events(raw(spark, rows), Task("task_001")).withColumn("columns", seeds.columns(columns))
    return decode.decoded(r, "task_001", **more), decode.quarantined(r)


def test_envelopes_and_errors(spark):
    events = [
        row_event(1, [["1", "p", "x"], ["2", "p", None]]),
        row_event(2, [["1", "p", "new"], ["1", "p", "old"]], "UPDATE_ROWS_EVENTv2"),
        row_event(3, [["1", "p", "x"]], "DELETE_ROWS_EVENTv2"),
        row_event(4, [["1", "p", "x"]] * 3, "UPDATE_ROWS_EVENTv2"),
        row_event(5, [["1", "p"]]),
        row_event(6, [["1", "p", "x"], ["1", "p"]]),
        row_event(7, []),
        row_event(8, None),
        row_event(9, [["1", "p", "x"]], "XID_EVENT"),
    ]
    good, bad = changes(spark, events)
    got = {(r.seq, r.row_index): r for r in good.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0), (3, 0)]
    assert got[1, 1].before is None and got[1, 1].after == {"id": "2", "p_type": "p", "v0": None}
    assert got[2, 0].after["v0"] == "new" and got[2, 0].before["v0"] == "old" and len(got[2, 0].org_row) == 2
    assert got[3, 0].after is None and got[3, 0].topic == "task_001.shop.t" and got[3, 0].key == "shop.t"
    assert {r.seq: r.reason for r in bad.collect()} == {4: "odd update images", 5: "wrong number of cells", 6: "wrong number of cells", 7: "no rows", 8: "no rows"}
    values = {(r.seq, r.row_index): r.value for r in encode.messages(good).collect()}
    assert values[1, 1] == '{"database":"shop","table":"t","action":"insert","before":null,"after":{"id":"2","p_type":"p","v0":null},"org_row":[["2","p",null]],"event_header":{"timestamp":1624355996,"log_pos":10}}'
    assert changes(spark, events[1:2], image_order="before_first")[0].first().after["v0"] == "old"
    with pytest.raises(ValueError):
        changes(spark, events[:1], image_order="any")
    assert changes(spark, events[:1], columns=("a", "b", "a"))[0].first().after == {"a": "x", "b": "p"}


@pytest.mark.parametrize("seed", range(3))
def test_a_log_folds_to_its_source(spark, seed):
    """Random inserts, updates, deletes and column changes; the latest images are what a table would hold."""
    rng, columns, table, events = random.Random(seed), ["id", "a"], {}, []
    for seq in range(1, 60):
        move = rng.random()
        if move < 0.1:
            name = f"c{seq}"
            columns.append(name)
            events.append(statement(seq, f"alter table shop.t add {name} int"))
            table = {k: v | {name: None} for k, v in table.items()}
        elif move < 0.6 or not table:
            row = {c: f"{c}{seq}" for c in columns} | {"id": str(seq)}
            table[row["id"]] = row
            events.append(row_event(seq, [[row[c] for c in columns]]))
        elif move < 0.85:
            old = table[rng.choice(sorted(table))]
            new = old | {"a": f"new{seq}"}
            table[new["id"]] = new
            events.append(row_event(seq, [[r[c] for c in columns] for r in (new, old)], "UPDATE_ROWS_EVENTv2"))
        else:
            old = table.pop(rng.choice(sorted(table)))
            events.append(row_event(seq, [[old[c] for c in columns]], "DELETE_ROWS_EVENTv2"))
    log, task = raw(spark, events), Task("t")
    initial = spark.range(1).select(F.lit("shop").alias("db"), F.lit("t").alias("tbl"), seeds.columns(("id", "a")).alias("columns"))
    versions = schemas.schema_versions(schemas.ddl_changes(log, task), initial)
    rows = schemas.with_schema(decode.row_events(log, task), versions)
    assert decode.quarantined(rows).isEmpty()
    got = {r.k: r.image for r in views.latest_images(decode.decoded(rows, "t"), "id").collect()}
    strip = lambda t: {k: {c: v for c, v in r.items() if v is not None} for k, r in t.items()}
    assert strip(got) == strip(table)


@pytest.mark.parametrize(
    ("marks", "files", "order", "events", "processed"),
    [
        ([], "1111", "position", [600, 650, 700, 750], [1, 1, 1, 1]),
        ([(1, 600, True), (1, 700, False)], "1111", "position", [650, 700, 750, 720], [0, 1, 1, 1]),
        ([(1, 600, True), (1, 700, True)], "1111", "position", [650, 700, 750, 760], [0, 0, 1, 1]),
        ([(1, 9000, True), (2, 200, False)], "1222", "position", [9100, 100, 200, 300], [1, 1, 1, 1]),
        ([(1, 8000, True), (1, 9000, True)], "1222", "position", [8500, 300, 400, 500], [0, 0, 0, 0]),
        ([(1, 8000, True), (1, 9000, True)], "1222", "file", [8500, 300, 400, 500], [0, 1, 1, 1]),
        ([(1, 9000, True), (2, 200, False)], "1222", "file", [9100, 100, 200, 300], [0, 0, 1, 1]),
    ],
)
def test_recovery_fixtures(spark, marks, files, order, events, processed):
    state = spark.createDataFrame([("t", "bin.000001", 500, [(f"bin.00000{f}", p, ok) for f, p, ok in marks])], "task_id string, position_name string, position_pos long, marks array<struct<pos_name:string,pos:long,success:boolean>>")
    log = spark.createDataFrame([(i, "t", f"bin.00000{f}", p) for i, (f, p) in enumerate(zip(files, events))], "seq long, task_id string, log_file string, log_pos long")
    got = recovery.replay(log, state, order).orderBy("seq").collect()
    assert [int(r.processed) for r in got] == processed


def test_positions_over_stretches(spark):
    """However the log is cut into stretches, names carry on; against a plain loop."""
    rng, events, want, name = random.Random(3), [], [], "f0"
    for seq in range(0, 400, 3):
        if rng.random() < 0.3:
            new, pos = f"f{rng.randrange(4)}", rng.choice([0, 4])
            events.append({"seq": seq, "log_pos": 77, "kind": "rotate", "next_log_name": new, "next_pos": pos})
            if new != name:
                name = new
                want.append((seq, name, pos or 77))
        elif rng.random() < 0.5:
            events.append({"seq": seq, "log_pos": seq + 1, "kind": "query", "query": "x", "default_schema": "", "error_code": 0})
            want.append((seq, name, seq + 1))
    for stretch in (1, 7, 100, 1 << 20):
        got = recovery.positions(raw(spark, events), Task("t"), "f0", stretch=stretch)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_marks_feed_the_replay(spark):
    log = spark.createDataFrame([(i, t, "bin.000001", i * 100, "rows") for i in range(1, 6) for t in ("a", "b", "c")] + [(9, "c", "bin.000002", 4, "query")], "seq long, task_id string, log_file string, log_pos long, kind string")
    done = spark.createDataFrame([("a", "bin.000001", 400), ("a", "bin.000001", 500), ("b", "bin.000001", 500), ("b", "bin.000001", 500)], "task_id string, log_file string, log_pos long")
    states = recovery.mark_states(log, done)
    assert {r.task_id: [(m.pos, m.success) for m in r.marks] for r in states.collect()} == {"a": [(400, True), (500, True)], "b": [(400, False), (500, True)], "c": [(400, False), (500, False)]}
    saved = states.select("task_id", F.lit("bin.000001").alias("position_name"), F.lit(500).cast("long").alias("position_pos"), "marks")
    got = recovery.replay(log.filter("seq >= 4"), saved)
    assert {(r.task_id, r.seq) for r in got.collect() if r.processed} == {("b", 4), ("c", 4), ("c", 5)}


@pytest.mark.parametrize(("name", "pos", "want"), [("bin.000001", 4, None), ("bin.000002", 4, ("bin.000002", 4)), ("bin.000002", 0, ("bin.000002", 77))])
def test_rotations(spark, name, pos, want):
    log = raw(spark, [{"seq": 1, "log_pos": 77, "kind": "rotate", "next_log_name": name, "next_pos": pos}])
    assert [(r.name, r.pos) for r in recovery.positions(log, Task("t"), "bin.000001").collect()] == ([want] if want else [])


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidelog.session import shared_dir

    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(RuntimeError):
            shared_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master)))


def test_task_validation():
    with pytest.raises(TaskError):
        Task("").validated()
    with pytest.raises(TaskError):
        TaskUpdate("").validated()


def test_typed_view(spark):
    good, _ = changes(spark, [row_event(1, [["1", "p", "2.50"], ["x", "p", None]])])
    assert [(r.id, r.v0) for r in decode.typed(good, "id int, v0 decimal(9,2)").orderBy("row_index").collect()] == [(1, __import__("decimal").Decimal("2.50")), (None, None)]
