"""Schema history: versions of each table's column list over the log, and rows joined with the version they were written by."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ddl
from tidelog.functions.filters import applied_queries, is_kind, schema_gate
from tidelog.model import COLUMNS, Task
from tidelog.operators.decode import with_names

#: seq of the versions that a catalog seeds: before every event.
START = -1


def from_catalog(catalog: DataFrame) -> DataFrame:
    """db, tbl, columns from rows of a catalog: db, tbl, ordinal, field, type, null. "NO" in any case is not null."""
    column = F.struct(F.col("ordinal"), F.col("field").alias("name"), F.col("type"), (F.upper("null") == "NO").alias("not_null"))
    columns = F.transform(F.array_sort(F.collect_list(column)), lambda c: F.struct(c["name"].alias("name"), F.coalesce(c["type"], F.lit("")).alias("type"), F.coalesce(c["not_null"], F.lit(False)).alias("not_null")))
    return catalog.groupBy("db", "tbl").agg(columns.cast(COLUMNS).alias("columns"))


def ddl_changes(events: DataFrame, task: Task, mode: str = "compat", gate: str = "open") -> DataFrame:
    """seq, db, tbl, step, change: the column changes that a task applies, clause by clause."""
    queries = events.filter(is_kind("query") & applied_queries(task, gate))
    # parsed once, as the output of a generator: filters on it don't spell the parser out again
    parsed = queries.select("seq", F.explode(F.array(ddl.parse(F.col("query"), F.coalesce("default_schema", F.lit("")), mode))).alias("p"))
    kept = parsed.filter(F.col("p").isNotNull() & F.col("p.error").isNull() & schema_gate(task, gate, F.col("p.schema")))
    return kept.select("seq", F.col("p.schema").alias("db"), F.col("p.table").alias("tbl"), F.posexplode("p.changes").alias("step", "change"))


VERSIONS = f"db string, tbl string, version long, from_seq long, to_seq long, old {COLUMNS}, columns {COLUMNS}"
ARROW_COLUMNS = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("not_null", pa.bool_())]))
ARROW_VERSIONS = pa.schema([("db", pa.string()), ("tbl", pa.string()), ("version", pa.int64()), ("from_seq", pa.int64()), ("to_seq", pa.int64()), ("old", ARROW_COLUMNS), ("columns", ARROW_COLUMNS)])
#: Columns in the lists of a batch of versions, about.
BATCH_COLUMNS = 1 << 16


def _lists(lists: list[list[ddl.Item] | None]) -> pa.Array:
    """Column lists as Arrow has them, each distinct column converted once."""
    code: dict[ddl.Item, int] = {}
    flat = pa.array([code.setdefault(c, len(code)) for columns in lists for c in columns or ()], pa.int32())
    items = pa.array([dict(zip(("name", "type", "not_null"), c, strict=True)) for c in code], ARROW_COLUMNS.value_type)
    ends = list(accumulate((len(columns or ()) for columns in lists), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items.take(flat), type=ARROW_COLUMNS, mask=pa.array([columns is None for columns in lists]))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Versions from rows in order: each table's list as the catalog has it, then its changes. Of a table only the newest
    version is held, until the next one closes it."""
    out, held, table, newest = [], 0, None, []

    def flushed() -> pa.RecordBatch:
        *plain, old, columns = zip(*out, strict=True)
        arrays = [pa.array(c, kind) for c, kind in zip(plain, ARROW_VERSIONS.types[:-2], strict=True)]
        return pa.record_batch([*arrays, _lists(old), _lists(columns)], schema=ARROW_VERSIONS)

    def close(v: tuple, to_seq: int | None) -> None:
        nonlocal held
        out.append((*v[:4], to_seq, *v[4:]))
        held += 1 + len(v[4] or ()) + len(v[5] or ())

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("db", "tbl", "seed", "seq", "columns", "action", "name", "new_name", "place", "after")), strict=True):
            key, (seed, seq, columns, *change) = row[:2], row[2:]
            if seed:
                if key != table or None in key:  # a catalog that has a table twice gives it two histories
                    for v in newest:
                        close(v, None)
                    table, newest = key, []
                newest.append((*key, 0, START, [], columns and [tuple(c.values()) for c in columns]))
            elif key == table:
                for i, v in enumerate(newest):
                    moved, after = ddl.moved(v[5], *change)
                    if moved:
                        close(v, seq)
                        newest[i] = (*key, v[2] + 1, seq, v[5], after)
            if held >= BATCH_COLUMNS:
                yield flushed()
                out.clear()
                held = 0
    for v in newest:
        close(v, None)
    if out:
        yield flushed()


def schema_versions(changes: DataFrame, initial: DataFrame) -> DataFrame:
    """db, tbl, version, from_seq, to_seq, old, columns.

    A version holds for events with from_seq < seq <= to_seq (null: open). A table's list and its changes come to one
    task in order and fold as they pass, so a history costs time in proportion to its versions' lists and no memory
    but for the newest. Tables that the catalog doesn't have are not followed.
    """
    fields = ("action", "name", "new_name", "place", "after")
    seeds = initial.select("db", "tbl", F.lit(True).alias("seed"), F.lit(START).cast("long").alias("seq"), F.lit(0).alias("step"), F.col("columns").cast(COLUMNS).alias("columns"), *[F.lit(None).cast("string").alias(c) for c in fields])
    steps = changes.select("db", "tbl", F.lit(False).alias("seed"), F.col("seq").cast("long").alias("seq"), F.col("step").cast("int").alias("step"), F.lit(None).cast(COLUMNS).alias("columns"), *[F.col("change")[c].alias(c) for c in fields])
    known = steps.filter(F.col("db").isNotNull() & F.col("tbl").isNotNull())
    ordered = seeds.unionByName(known).repartition("db", "tbl").sortWithinPartitions("db", "tbl", F.col("seed").desc(), "seq", "step", *fields)
    return ordered.mapInArrow(_folded, VERSIONS)


def with_schema(rows: DataFrame, versions: DataFrame) -> DataFrame:
    """Row events with `columns`, `names` and `plain_names` of the version that held for them; null where the table is unknown.

    An equi-join on (db, tbl) with the interval as a condition: the versions side is small and is broadcast where its
    size allows, else AQE splits a hot table's rows. Several clauses of one statement leave empty intervals, which match nothing.
    """
    v = with_names(versions.select(F.col("db").alias("v_db"), F.col("tbl").alias("v_tbl"), "from_seq", "to_seq", "columns"))
    holds = (F.col("seq") > F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") <= F.col("to_seq")))
    return rows.join(v, (F.col("db") == F.col("v_db")) & (F.col("tbl") == F.col("v_tbl")) & holds, "left").drop("v_db", "v_tbl", "from_seq", "to_seq")
