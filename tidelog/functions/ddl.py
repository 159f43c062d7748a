"""ALTER TABLE statements as columns: parsing, and folding into a table's column list.

mode "compat" reads statements by plain tokens: the literal `alter table` anywhere in lower case, then a split on
single spaces; quotes stay, only the first clause counts, and an unknown position loses the column. mode "strict"
(an extension) takes comments, quotes, white space, several clauses, RENAME COLUMN and index clauses as meant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.model import COLUMNS

#: One change of a column list. place: first, after or last.
CHANGE = "struct<action:string,name:string,new_name:string,place:string,after:string>"
PARSED = f"struct<schema:string,table:string,action:string,changes:array<{CHANGE}>,error:string>"
ALTER = "alter table"


def _change(action, name, new_name=None, place=None, after=None) -> Column:
    col = lambda c: F.lit(None).cast("string") if c is None else (F.lit(c) if isinstance(c, str) else c)
    return F.struct(col(action).alias("action"), col(name).alias("name"), col(new_name).alias("new_name"), col(place).alias("place"), col(after).alias("after"))


def _no_changes() -> Column:
    return F.array().cast(f"array<{CHANGE}>")


def parse_compat(query: Column, default_schema: Column) -> Column:
    """PARSED; null where the statement isn't an ALTER TABLE. error: a token that the statement lacks."""
    at = F.locate(ALTER, F.lower(query), 1)
    tokens = F.split(F.regexp_replace(F.substring(query, at, F.length(query)), r"^\s+|\s+$", ""), " ", -1)
    token = lambda i: F.get(tokens, F.lit(i))
    n = F.size(tokens)
    named, action = token(2), F.lower(token(3))
    parts = F.split(named, r"\.")
    dotted = F.instr(named, ".") > 0
    with_word = F.lower(token(4)) == "column"
    column = F.when(with_word, token(5)).otherwise(token(4))
    last, before_last = F.lower(F.get(tokens, n - 1)), F.lower(F.get(tokens, n - 2))
    place = F.when(last == "first", "first").when(before_last == "after", "after").otherwise("last")
    change = (
        F.when(action == "drop", _change("drop", column))
        .when(action == "add", _change("add", column, None, place, F.when(place == "after", F.get(tokens, n - 1))))
        .when(action == "change", _change("change", token(4), token(5)))
    )
    lacks = (n < 4) | (action.isin("drop", "add") & ((n < 5) | (with_word & (n < 6)))) | ((action == "change") & (n < 6))
    parsed = F.struct(
        F.when(dotted, F.get(parts, F.lit(0))).otherwise(default_schema).alias("schema"),
        F.when(dotted, F.get(parts, F.lit(1))).otherwise(named).alias("table"),
        action.alias("action"),
        F.when(lacks | change.isNull(), _no_changes()).otherwise(F.array(change)).alias("changes"),
        F.when(lacks, F.lit("missing token")).alias("error"),
    )
    return F.when(at > 0, parsed)


#: Words that open a clause about something else than a column.
NOT_COLUMNS = ("index", "key", "unique", "primary", "foreign", "constraint", "fulltext", "spatial", "check", "partition")


def parse_strict(query: Column, default_schema: Column) -> Column:
    """PARSED with all clauses of the statement; commas within parentheses don't part clauses."""
    clean = F.regexp_replace(query, r"(?s)/\*.*?\*/|--[^\n]*(\n|$)", " ")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(clean, "`", ""), r"[\s;]+$", ""), r"\s+", " ")
    head = r"(?is)^ ?alter (?:online |offline )?(?:ignore )?table (\S+) (.*)$"
    named, body = F.regexp_extract(clean, head, 1), F.regexp_extract(clean, head, 2)
    parts = F.split(named, r"\.")
    clauses = F.transform(F.split(body, r",(?![^()]*\))"), lambda c: F.split(F.trim(c), " "))

    def one(t: Column) -> Column:
        word = lambda i: F.get(t, i)
        verb, second = F.lower(word(F.lit(0))), F.lower(word(F.lit(1)))
        k = F.when(second == "column", F.lit(2)).otherwise(F.lit(1))
        n = F.size(t)
        last, before_last = F.lower(word(n - 1)), F.lower(word(n - 2))
        place = F.when(last == "first", "first").when(before_last == "after", "after").otherwise("last")
        about_column = ~second.isin(*NOT_COLUMNS)
        return (
            F.when((verb == "drop") & about_column, _change("drop", word(k)))
            .when((verb == "add") & about_column, _change("add", word(k), None, place, F.when(place == "after", word(n - 1))))
            .when(verb == "change", _change("change", word(k), word(k + 1)))
            .when((verb == "rename") & (second == "column"), _change("change", word(F.lit(2)), word(F.lit(4))))
        )

    parsed = F.struct(
        F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(default_schema).alias("schema"),
        F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(named).alias("table"),
        F.lower(F.get(F.split(body, " "), F.lit(0))).alias("action"),
        F.filter(F.transform(clauses, one), lambda c: c.isNotNull()).alias("changes"),
        F.lit(None).cast("string").alias("error"),
    )
    return F.when(named != "", parsed)


def parse(query: Column, default_schema: Column, mode: str = "compat") -> Column:
    return {"compat": parse_compat, "strict": parse_strict}[mode](query, default_schema)


def new_column(name: Column) -> Column:
    """A column that a statement adds has a name only."""
    return F.struct(name.alias("name"), F.lit("").alias("type"), F.lit(False).alias("not_null"))


def applied(columns: Column, change: Column) -> Column:
    """The column list after a change; unmatched names change nothing, an unknown `after` adds nothing, one that several
    columns have adds after the first."""
    name, added = change["name"], F.array(new_column(change["name"]))
    dropped = F.filter(columns, lambda c: c["name"] != name)
    at = F.coalesce(F.array_position(F.transform(columns, lambda c: c["name"]), change["after"]), F.lit(0)).cast("int")
    after = F.when(at > 0, F.concat(F.slice(columns, 1, at), added, F.slice(columns, at + 1, F.size(columns)))).otherwise(columns)
    renamed = F.transform(columns, lambda c: F.struct(F.when(c["name"] == name, change["new_name"]).otherwise(c["name"]).alias("name"), c["type"].alias("type"), c["not_null"].alias("not_null")))
    grown = F.when(change["place"] == "first", F.concat(added, columns)).when(change["place"] == "after", after).otherwise(F.concat(columns, added))
    return F.when(change["action"] == "drop", dropped).when(change["action"] == "change", renamed).when(has_column(columns, name), columns).otherwise(grown).cast(COLUMNS)


def has_column(columns: Column, name: Column) -> Column:
    return F.exists(columns, lambda c: c["name"] == name)


def shifts(columns: Column, change: Column) -> Column:
    """The change moves the definition to `old`: any but an add of a column that is there."""
    return ~((change["action"] == "add") & has_column(columns, change["name"]))


#: A column as Python has it: name, type, not_null.
Item = tuple[str | None, str | None, bool | None]


def moved(columns: list[Item] | None, action: str, name: str | None, new_name: str | None, place: str | None, after: str | None) -> tuple[bool, list[Item] | None]:
    """shifts() and applied() for one list in Python, nulls as in SQL; the list is not changed but made anew."""
    if action == "drop":
        return True, columns and [c for c in columns if name is not None and c[0] is not None and c[0] != name]
    if action == "change":
        return True, columns and [(new_name, *c[1:]) if name is not None and c[0] == name else c for c in columns]
    if columns is None or any(name is None or c[0] is None or c[0] == name for c in columns):
        return False, columns
    added = (name, "", False)
    if place == "first":
        return True, [added, *columns]
    if place != "after":
        return True, [*columns, added]
    at = next((i + 1 for i, c in enumerate(columns) if after is not None and c[0] == after), 0)
    return True, [*columns[:at], added, *columns[at:]] if at else columns
