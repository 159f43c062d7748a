"""Which events a task keeps, as columns compiled once from its lists.

The lists become IN and AND/OR over the plain columns db and tbl, so Catalyst pushes them to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.model import EVENT_ACTIONS, Task


def action_of(event_type: Column | str) -> Column:
    """insert, update or delete; empty for any other event type, null included."""
    event_type = F.col(event_type) if isinstance(event_type, str) else event_type
    by_action: dict[str, list[str]] = {}
    for kind, action in EVENT_ACTIONS.items():
        by_action.setdefault(action, []).append(kind)
    out = F.lit("")
    for action, kinds in by_action.items():
        out = F.when(event_type.isin(kinds), action).otherwise(out)
    return out


def is_kind(kind: str) -> Column:
    """Router: the event is of a kind and has a position."""
    return (F.col("kind") == kind) & F.col("log_pos").isNotNull()


def in_databases(databases: tuple[str, ...], db: str = "db") -> Column:
    return F.col(db).isin(*databases) if databases else F.lit(True)


def in_table_list(tables: tuple[str, ...], db: str = "db", tbl: str = "tbl") -> Column:
    """The row's "db.*" or "db.table" is in the list; other entries match nothing."""
    whole, single = [], {}
    for entry in dict.fromkeys(tables):
        d, dot, t = entry.partition(".")
        if dot and t == "*":
            whole.append(d)
        elif dot:
            single.setdefault(d, []).append(t)
    tests = [F.col(db).isin(*whole)] if whole else []
    tests += [(F.col(db) == d) & F.col(tbl).isin(*ts) for d, ts in single.items()]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def kept_rows(task: Task, db: str = "db", tbl: str = "tbl") -> Column:
    """Database list, then table list, then exclusion, which wins; rows without a table map go."""
    keep = F.col(db).isNotNull() & F.col(tbl).isNotNull() & in_databases(task.database, db)
    if task.tables:
        keep = keep & in_table_list(task.tables, db, tbl)
    if task.exclude_table:
        keep = keep & ~in_table_list(task.exclude_table, db, tbl)
    return keep


def applied_queries(task: Task, gate: str = "open") -> Column:
    """Statements to apply: not BEGIN, successful, and of a kept default database.

    gate "strict": an empty database list keeps none, as schema tracking was first specified; "open": it keeps all,
    as for rows. An empty default schema passes; the statement's own schema is checked later.
    """
    schema = F.coalesce(F.col("default_schema"), F.lit(""))
    keep = (F.col("query") != "BEGIN") & (F.coalesce(F.col("error_code"), F.lit(0)) == 0)
    return keep & ((schema == "") | schema_gate(task, gate, schema))


def schema_gate(task: Task, gate: str, schema: Column) -> Column:
    if task.database:
        return schema.isin(*task.database)
    return F.lit(gate == "open")
