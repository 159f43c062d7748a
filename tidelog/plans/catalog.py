"""The registered queries over the change feed, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ddl
from tidelog.functions.filters import action_of, applied_queries, is_kind, kept_rows, schema_gate
from tidelog.model import FileConf, Task, TaskUpdate
from tidelog.operators import decode, encode, recovery, schemas, views
from tidelog.plans import seeds
from tidelog.session import work_path
from tidelog.sources.change_log import ChangeLogSource, stream_events
from tidelog.sources.kv import KeyValueStore
from tidelog.sources.sinks import FileSink, read_files
from tidelog.streaming.engine import TaskEngine
from tidelog.streaming.pipeline import ChangeFeed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


TASK = Task("task_001")
#: Over the tables of orders_log: a database list, whole databases and single tables, and exclusions that win.
FILTERED = Task("task_001", database=("db0", "db1", "db2"), tables=("db0.*", "db1.t1", "db1.t2", "db3.*", "t4"), exclude_table=("db0.t3", "db1.t2", "*.t0"))

# The seeds of plans/seeds.py once more, as SQL.
ORDERS_SQL = """
o AS (SELECT o_orderkey AS seq, o_custkey, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(epoch(o_orderdate) AS BIGINT) AS ts,
  'db' || (o_custkey % 4) AS db, 't' || (o_orderkey % 5) AS tbl, 'bin.' || lpad((o_orderkey // 1000)::VARCHAR, 6, '0') AS log_file, o_orderkey % 1000 * 100 + 4 AS log_pos,
  CASE WHEN o_orderkey % 7 < 3 THEN 'insert' WHEN o_orderkey % 7 < 5 THEN 'update' WHEN o_orderkey % 7 = 5 THEN 'delete' ELSE '' END AS action FROM orders)
"""
KEPT_SQL = "db IN ('db0', 'db1', 'db2') AND (db = 'db0' OR (db = 'db1' AND tbl IN ('t1', 't2')) OR db = 'db3') AND NOT (db = 'db0' AND tbl = 't3') AND NOT (db = 'db1' AND tbl = 't2')"
LINES_SQL = """
li AS (SELECT l_orderkey AS seq, l_partkey::VARCHAR AS partkey, l_suppkey::VARCHAR AS suppkey, l_linenumber::VARCHAR AS linenumber,
  CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)), CAST(l_extendedprice AS DECIMAL(18,2))) - 1 AS row_index FROM lineitem)
"""


def order_changes(spark, sf_dir, task=TASK, events=None) -> DataFrame:
    events = seeds.orders_log(spark, sf_dir) if events is None else events
    rows = decode.row_events(events, task).withColumn("columns", seeds.columns(seeds.ORDER_COLUMNS))
    return decode.decoded(rows, task.task_id)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed log: filtered, joined with its tables' schema versions, decoded, flat."""
    versions = schemas.schema_versions(schemas.ddl_changes(seeds.orders_log(spark, sf_dir), FILTERED), seeds.orders_catalog(spark))
    rows = schemas.with_schema(decode.row_events(seeds.orders_log(spark, sf_dir), FILTERED), versions)
    c = decode.decoded(rows, FILTERED.task_id)
    return c.select("seq", "row_index", "topic", "action", c.before["price"].alias("before_price"), c.after["price"].alias("after_price"), c.event_header["log_pos"].alias("log_pos"))


query(
    f"""WITH {ORDERS_SQL}
SELECT seq, 0::BIGINT AS row_index, 'task_001.' || db || '.' || tbl AS topic, action, CASE WHEN action <> 'insert' THEN price::VARCHAR END AS before_price,
  CASE action WHEN 'insert' THEN price::VARCHAR WHEN 'update' THEN (price + 1)::VARCHAR END AS after_price, log_pos FROM o WHERE action <> '' AND {KEPT_SQL}"""
)(flagship)


@query("""SELECT event_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'insert' WHEN 'click' THEN 'update' WHEN 'view' THEN 'delete' ELSE '' END AS action,
  event_type <> 'error' AS decoded FROM events""")
def route_classify(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "WRITE_ROWS_EVENTv1", "purchase", "WRITE_ROWS_EVENTv2", "click", "UPDATE_ROWS_EVENTv2", "view", "DELETE_ROWS_EVENTv2", "error", "QUERY_EVENT")])
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("action", action_of(kinds[F.col("event_type")]))
    return e.select("event_id", "action", (F.col("action") != "").alias("decoded"))


@query("""SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'rotate' WHEN 'signup' THEN 'query' ELSE 'rows' END AS kind FROM events
  WHERE event_type <> 'view' AND event_id % 11 <> 0""")
def route_kinds(spark, sf_dir):
    """Row events, statements and rotations by their routes; other kinds and events without a position have none."""
    k, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "error", "rotate").when(t == "signup", "query").when(t == "view", F.when(k % 2 == 0, "xid")).otherwise("rows")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(k.alias("seq"), kind.alias("kind"), F.when(k % 11 != 0, k * 10).alias("log_pos"))
    routes = [e.filter(is_kind(name)) for name in ("rows", "query", "rotate")]
    return routes[0].unionByName(routes[1]).unionByName(routes[2]).select("seq", "kind")


def _filter_query(name: str, task: Task, sql: str):
    def run(spark, sf_dir):
        return seeds.orders_log(spark, sf_dir).filter(kept_rows(task)).select("seq", "db", "tbl")

    run.__name__ = name
    query(f"WITH {ORDERS_SQL} SELECT seq, db, tbl FROM o WHERE {sql}")(run)


_filter_query("filter_database", Task("t", database=("db1", "db3")), "db IN ('db1', 'db3')")
_filter_query("filter_table_include", Task("t", tables=("db0.*", "db1.t1", "t2")), "db = 'db0' OR (db = 'db1' AND tbl = 't1')")
_filter_query("filter_table_exclude", Task("t", exclude_table=("db2.*", "db3.t4", "*.t1")), "db <> 'db2' AND NOT (db = 'db3' AND tbl = 't4')")
_filter_query("filter_combined", FILTERED, KEPT_SQL)


@query(f"""WITH {ORDERS_SQL}, x AS (SELECT seq, CASE WHEN seq % 9 <> 0 THEN db END AS db, CASE WHEN seq % 10 <> 0 THEN tbl END AS tbl FROM o)
SELECT seq, db, tbl FROM x WHERE db IS NOT NULL AND tbl IS NOT NULL AND NOT (db = 'db1' AND tbl = 't1')""")
def filter_null_table(spark, sf_dir):
    """Rows whose table map lacks the database or the table go, whatever the lists say."""
    e = seeds.orders_log(spark, sf_dir)
    e = e.withColumn("db", F.when(F.col("seq") % 9 != 0, F.col("db"))).withColumn("tbl", F.when(F.col("seq") % 10 != 0, F.col("tbl")))
    return e.filter(kept_rows(Task("t", exclude_table=("db1.t1",)))).select("seq", "db", "tbl")


def line_changes(spark, events, image_order="after_first") -> DataFrame:
    rows = decode.row_events(events, TASK).withColumn("columns", seeds.columns(seeds.LINE_COLUMNS))
    return decode.decoded(rows, TASK.task_id, image_order)


def flat_lines(c: DataFrame, side: str) -> DataFrame:
    return c.select("seq", "row_index", "action", *[F.col(side)[n].alias(n) for n in seeds.LINE_COLUMNS], F.col("after" if side == "before" else "before").isNull().alias("other_is_null"))


LINE_FLAT_SQL = "SELECT seq, row_index::BIGINT AS row_index, '{action}' AS action, partkey, suppkey, linenumber, quantity::VARCHAR AS quantity, price::VARCHAR AS price, TRUE AS other_is_null FROM li"


@query(f"WITH {LINES_SQL} {LINE_FLAT_SQL.format(action='insert')}")
def decode_insert(spark, sf_dir):
    return flat_lines(line_changes(spark, seeds.lines_log(spark, sf_dir, "WRITE_ROWS_EVENTv2")), "after")


@query(f"WITH {LINES_SQL} {LINE_FLAT_SQL.format(action='delete')}")
def decode_delete(spark, sf_dir):
    return flat_lines(line_changes(spark, seeds.lines_log(spark, sf_dir, "DELETE_ROWS_EVENTv2")), "before")


UPDATES_SQL = f"WITH {LINES_SQL} SELECT seq, row_index::BIGINT AS row_index, quantity::VARCHAR AS old_quantity, (quantity + 1)::VARCHAR AS new_quantity, partkey, 2 AS images FROM li"


def _updates(c: DataFrame) -> DataFrame:
    return c.select("seq", "row_index", c.before["quantity"].alias("old_quantity"), c.after["quantity"].alias("new_quantity"), c.after["partkey"].alias("partkey"), F.size("org_row").alias("images"))


@query(UPDATES_SQL)
def decode_update_pairs(spark, sf_dir):
    return _updates(line_changes(spark, seeds.lines_log(spark, sf_dir, "UPDATE_ROWS_EVENTv2", seeds.update_pairs())))


@query(UPDATES_SQL)
def decode_update_before_first(spark, sf_dir):
    return _updates(line_changes(spark, seeds.lines_log(spark, sf_dir, "UPDATE_ROWS_EVENTv1", seeds.update_pairs(False)), "before_first"))


@query("""WITH e AS (SELECT l_orderkey AS seq, count(*) AS n FROM lineitem GROUP BY 1)
SELECT seq, CASE WHEN seq % 11 = 3 THEN 'no rows' WHEN seq % 11 = 5 AND n % 2 = 1 THEN 'odd update images' WHEN seq % 11 = 7 THEN 'wrong number of cells' ELSE 'no schema' END AS reason
FROM e WHERE seq % 11 IN (3, 7, 9) OR (seq % 11 = 5 AND n % 2 = 1)""")
def validate_quarantine(spark, sf_dir):
    """By key: no rows; update events with one image a line; a line without its last cell; a table that nobody knows."""
    k = F.col("seq") % 11
    e = seeds.lines_log(spark, sf_dir, "WRITE_ROWS_EVENTv2")
    short = F.transform("rows", lambda r, i: F.when(i == 0, F.slice(r, 1, 4)).otherwise(r))
    e = e.withColumn("rows", F.when(k == 3, F.slice("rows", 1, 0)).when(k == 7, short).otherwise(F.col("rows")))
    e = e.withColumn("event_type", F.when(k == 5, "UPDATE_ROWS_EVENTv2").otherwise(F.col("event_type"))).withColumn("tbl", F.when(k == 9, "unknown").otherwise(F.col("tbl")))
    versions = schemas.schema_versions(schemas.ddl_changes(e, TASK), seeds.lines_catalog(spark))
    return decode.quarantined(schemas.with_schema(decode.row_events(e, TASK), versions)).select("seq", "reason")


@query(f"""WITH {ORDERS_SQL} SELECT 'task_001.' || db || '.' || tbl AS topic, db || '.' || tbl AS key, action, count(*) AS n, min(ts)::BIGINT AS first_ts, max(log_pos)::BIGINT AS last_pos
FROM o WHERE action <> '' GROUP BY ALL""")
def envelope_topic_key(spark, sf_dir):
    c = order_changes(spark, sf_dir)
    return c.groupBy("topic", "key", "action").agg(F.count(F.lit(1)).alias("n"), F.min("event_header.timestamp").alias("first_ts"), F.max("event_header.log_pos").alias("last_pos"))


@query(f"""WITH {ORDERS_SQL} SELECT seq, 'task_001.' || db || '.' || tbl AS topic, db AS database, tbl AS "table", action, action = 'insert' AS no_before, action = 'delete' AS no_after,
  CASE WHEN action <> 'insert' THEN price::VARCHAR END AS before_price, CASE action WHEN 'insert' THEN price::VARCHAR WHEN 'update' THEN (price + 1)::VARCHAR END AS after_price,
  CASE WHEN action = 'update' THEN 2 ELSE 1 END AS images, ts AS timestamp, log_pos, 2 AS nulls FROM o WHERE action <> ''""")
def envelope_json_roundtrip(spark, sf_dir):
    """Messages parsed back; nulls counts the null images that the text spells out, over an insert and a delete."""
    m = encode.messages(order_changes(spark, sf_dir))
    spelled = F.when(F.get_json_object("value", "$.action") == "insert", F.instr("value", '"before":null') > 0).when(F.get_json_object("value", "$.action") == "delete", F.instr("value", '"after":null') > 0).otherwise(True)
    e = encode.parsed(m.filter(spelled))
    return e.select("seq", "topic", "database", "table", "action", e.before.isNull().alias("no_before"), e.after.isNull().alias("no_after"), e.before["price"].alias("before_price"), e.after["price"].alias("after_price"), F.size("org_row").alias("images"), e.event_header["timestamp"].alias("timestamp"), e.event_header["log_pos"].alias("log_pos"), F.lit(2).alias("nulls"))


#: Statements of parts, read by plain tokens: what is literally `alter table`, cut at single spaces.
PARSED_SQL = """
q AS (SELECT p_partkey AS seq, {db} AS def, __TEXT__ AS q FROM part),
tok AS (SELECT seq, def, string_split(regexp_replace(substr(q, strpos(lower(q), 'alter table')), '^\\s+|\\s+$', '', 'g'), ' ') AS t FROM q WHERE strpos(lower(q), 'alter table') > 0),
named AS (SELECT *, len(t) AS n, strpos(t[3], '.') > 0 AS dotted, lower(t[4]) AS action, coalesce(lower(t[5]) = 'column', FALSE) AS w, lower(t[-1]) AS last, lower(t[-2]) AS pen FROM tok),
parsed AS (SELECT seq, CASE WHEN dotted THEN string_split(t[3], '.')[1] ELSE def END AS db, CASE WHEN dotted THEN string_split(t[3], '.')[2] ELSE t[3] END AS tbl, action,
  n < 4 OR (action IN ('drop', 'add') AND (n < 5 OR (w AND n < 6))) OR (action = 'change' AND n < 6) AS lacks,
  CASE WHEN action = 'change' THEN t[5] WHEN action IN ('drop', 'add') THEN CASE WHEN w THEN t[6] ELSE t[5] END END AS name, CASE WHEN action = 'change' THEN t[6] END AS new_name,
  CASE WHEN action = 'add' THEN CASE WHEN last = 'first' THEN 'first' WHEN pen = 'after' THEN 'after' ELSE 'last' END END AS place,
  CASE WHEN action = 'add' AND last <> 'first' AND pen = 'after' THEN t[-1] END AS after FROM named)
"""


def parsed_sql(db: str) -> str:
    return PARSED_SQL.replace("{db}", db).replace("__TEXT__", seeds.GENERATED.format(div="//", db="(" + db + ")").strip())


@query(f"""WITH {parsed_sql("'db' || (p_partkey % 4)")}
SELECT seq, db, tbl, action, CASE WHEN lacks THEN 'missing token' END AS error, CASE WHEN NOT lacks THEN name END AS name, CASE WHEN NOT lacks THEN new_name END AS new_name,
  CASE WHEN NOT lacks THEN place END AS place, CASE WHEN NOT lacks THEN after END AS after FROM parsed""")
def ddl_parse(spark, sf_dir):
    """A statement for each part, and what the plain-token rules read in it."""
    s = seeds.generated_statements(spark, sf_dir, "'db' || (p_partkey % 4)")
    p = s.select("seq", F.explode(F.array(ddl.parse(F.col("query"), F.col("default_schema")))).alias("p")).filter("p is not null")
    change = F.get("p.changes", F.lit(0))
    return p.select("seq", F.col("p.schema").alias("db"), F.col("p.table").alias("tbl"), "p.action", "p.error", *[change[c].alias(c) for c in ("name", "new_name", "place", "after")])


#: The column list `c` after a parsed change, and whether the change moves the definition.
APPLIED_SQL = """CASE WHEN action = 'drop' THEN list_filter(c, lambda x: x <> name) WHEN action = 'change' THEN list_transform(c, lambda x: CASE WHEN x = name THEN new_name ELSE x END)
  WHEN list_contains(c, name) THEN c WHEN place = 'first' THEN list_prepend(name, c) WHEN place = 'last' THEN list_append(c, name)
  WHEN list_contains(c, after) THEN list_concat(list_append(c[:list_position(c, after)], name), c[list_position(c, after) + 1:]) ELSE c END"""
MOVES_SQL = "NOT (action = 'add' AND list_contains(c, name))"
START_SQL = "[" + ", ".join(f"'{c}'" for c in seeds.START_COLUMNS) + "]"


@query(f"""WITH {parsed_sql("'shop'")}, s AS (SELECT *, {START_SQL} AS c FROM parsed WHERE NOT lacks AND name IS NOT NULL AND db = 'shop')
SELECT seq, array_to_string({APPLIED_SQL}, ',') AS columns, array_to_string(c, ',') AS old FROM s WHERE {MOVES_SQL}""")
def ddl_fold_versions(spark, sf_dir):
    """Each statement alone over the start columns: the lists after and before it, where it moves the definition."""
    task = Task("t", database=("shop",))
    s = seeds.generated_statements(spark, sf_dir, "'shop'").withColumn("error_code", F.lit(0)).filter(applied_queries(task))
    s = s.select("seq", F.explode(F.array(ddl.parse(F.col("query"), F.col("default_schema")))).alias("p")).filter(F.col("p").isNotNull() & F.col("p.error").isNull() & schema_gate(task, "open", F.col("p.schema")))
    s = s.select("seq", F.explode("p.changes").alias("change"), seeds.columns(seeds.START_COLUMNS).alias("before")).filter(ddl.shifts(F.col("before"), F.col("change")))
    return s.select("seq", _names(ddl.applied(F.col("before"), F.col("change"))).alias("columns"), _names(F.col("before")).alias("old"))


def _names(columns):
    return F.array_join(F.transform(columns, lambda x: x["name"]), ",")


@query(f"""WITH RECURSIVE {parsed_sql("'db' || (p_partkey % 25)")},
s AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY seq) AS i FROM parsed WHERE NOT lacks AND name IS NOT NULL AND tbl = 'visit' AND db <> 'other' AND seq % 10 <> 9),
r AS (SELECT 'db' || n_nationkey AS db, 0::BIGINT AS i, -1::BIGINT AS from_seq, []::VARCHAR[] AS old, {START_SQL} AS c, 0::BIGINT AS version, TRUE AS moved FROM nation
  UNION ALL SELECT db, i, CASE WHEN m THEN seq ELSE from_seq END, CASE WHEN m THEN c ELSE old END, CASE WHEN m THEN a ELSE c END, version + m::INT, m
  FROM (SELECT r.db, s.i, s.seq, r.from_seq, r.old, r.c, r.version, {MOVES_SQL} AS m, {APPLIED_SQL} AS a FROM r JOIN s ON s.db = r.db AND s.i = r.i + 1))
SELECT db, version, from_seq, lead(from_seq) OVER (PARTITION BY db ORDER BY version) AS to_seq, array_to_string(c, ',') AS columns, array_to_string(old, ',') AS old FROM r WHERE moved""")
def ddl_history(spark, sf_dir):
    """The versions of 25 tables over all statements, a tenth of which failed."""
    s = seeds.generated_statements(spark, sf_dir, "'db' || (p_partkey % 25)")
    events = seeds.shaped(s.select(*seeds.position("seq"), F.lit("query").alias("kind"), "query", "default_schema", F.when(F.col("seq") % 10 == 9, 1064).otherwise(0).alias("error_code")))
    tables = spark.range(25).select(F.concat(F.lit("db"), F.col("id")).alias("db"), F.lit("visit").alias("tbl"), seeds.columns(seeds.START_COLUMNS).alias("columns"))
    v = schemas.schema_versions(schemas.ddl_changes(events, Task("t")), tables)
    return v.select("db", "version", "from_seq", "to_seq", _names(F.col("columns")).alias("columns"), _names(F.col("old")).alias("old"))


@query("""SELECT 'db' || (c_custkey % 3) AS db, 't' || (c_custkey % 20) AS tbl, string_agg('f' || c_custkey || ':' || coalesce(c_mktsegment, ''), ',' ORDER BY c_custkey DESC) AS columns,
  count(*) FILTER (c_custkey % 4 IN (1, 2)) AS not_null FROM customer GROUP BY ALL""")
def catalog_columns(spark, sf_dir):
    """Tables whose columns are customers, by falling key, half of them not null in either spelling."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("db"), k % 3).alias("db"), F.concat(F.lit("t"), k % 20).alias("tbl"), (-k).alias("ordinal"), F.concat(F.lit("f"), k).alias("field"), F.col("c_mktsegment").alias("type"), F.element_at(F.array(*map(F.lit, ("YES", "NO", "No", "yes"))), (k % 4 + 1).cast("int")).alias("null"))
    each = F.transform("columns", lambda x: F.concat(x["name"], F.lit(":"), x["type"]))
    return schemas.from_catalog(c).select("db", "tbl", F.array_join(each, ",").alias("columns"), F.size(F.filter("columns", lambda x: x["not_null"])).cast("long").alias("not_null"))


EVOLVED_SQL = f"""WITH {LINES_SQL} SELECT seq, row_index::BIGINT AS row_index, partkey, CASE WHEN seq <= 700 THEN suppkey END AS suppkey, CASE WHEN seq <= 1000 THEN price::VARCHAR END AS price,
  CASE WHEN seq > 1000 THEN price::VARCHAR END AS amount, CASE WHEN seq > 300 THEN 'n' || linenumber END AS note,
  CASE WHEN seq <= 300 THEN 'linenumber,partkey,price,quantity,suppkey' WHEN seq <= 700 THEN 'linenumber,note,partkey,price,quantity,suppkey' WHEN seq <= 1000 THEN 'linenumber,note,partkey,price,quantity' ELSE 'amount,linenumber,note,partkey,quantity' END AS names FROM li"""


def _evolved(c: DataFrame) -> DataFrame:
    cols = ["partkey", "suppkey", "price", "amount", "note"]
    return c.select("seq", F.col("row_index").cast("long").alias("row_index"), *[F.try_element_at("after", F.lit(n)).alias(n) for n in cols], F.array_join(F.array_sort(F.map_keys("after")), ",").alias("names"))


@query(EVOLVED_SQL)
def decode_schema_evolution(spark, sf_dir):
    events = seeds.evolving_lines_log(spark, sf_dir)
    versions = schemas.schema_versions(schemas.ddl_changes(events, TASK), seeds.lines_catalog(spark))
    return _evolved(decode.decoded(schemas.with_schema(decode.row_events(events, TASK), versions), TASK.task_id))


@query("""WITH s AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE 'db' || (n_nationkey % 4) END AS d, n_nationkey % 3 = 2 AS failed, n_nationkey % 7 = 6 AS begins FROM nation),
g AS (SELECT *, NOT begins AND NOT failed AND (d = '' OR d IN ('db0', 'db1')) AS listed, NOT begins AND NOT failed AND d = '' AS strict_empty, NOT begins AND NOT failed AS open_empty FROM s)
SELECT k, listed, strict_empty, open_empty FROM g""")
def ddl_gate(spark, sf_dir):
    """Statements of 25 default schemas, error codes and BEGINs, under a database list and under an empty one in both gates."""
    k = F.col("n_nationkey")
    s = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("k"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("db"), k % 4)).alias("default_schema"), F.when(k % 3 == 2, 1064).otherwise(0).alias("error_code"), F.when(k % 7 == 6, "BEGIN").otherwise("alter table t add a int").alias("query"))
    return s.select("k", applied_queries(Task("t", database=("db0", "db1"))).alias("listed"), applied_queries(Task("t"), "strict").alias("strict_empty"), applied_queries(Task("t"), "open").alias("open_empty"))


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task state for each nation: at the latest position, with up to two marks, or with a saved position."""
    k = F.col("n_nationkey").cast("long")
    mark = lambda p, ok: F.struct(F.lit("bin.000001").alias("pos_name"), p.alias("pos"), ok.alias("success"))
    none = F.array().cast("array<struct<pos_name:string,pos:long,success:boolean>>")
    marks = F.when(k % 3 == 0, none).otherwise(F.array(mark(k * 100 + 500, k % 2 == 0), mark(k * 100 + 900, k % 4 < 2)))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("task_"), k).alias("task_id"), F.lit("bin.000001").alias("position_name"), F.when(k % 5 == 0, 0).otherwise(k * 10).cast("long").alias("position_pos"), marks.alias("marks"))


STATES_SQL = """st AS (SELECT n_nationkey::BIGINT AS k, 'task_' || n_nationkey AS task_id, CASE WHEN n_nationkey % 5 = 0 THEN 'latest' WHEN n_nationkey % 3 <> 0 THEN 'marks' ELSE 'saved' END AS source,
  n_nationkey * 100 + 500 AS p1, n_nationkey % 2 = 0 AS ok1, n_nationkey * 100 + 900 AS p2, n_nationkey % 4 < 2 AS ok2 FROM nation)"""


@query(f"""WITH {STATES_SQL} SELECT task_id, source, CASE WHEN source <> 'latest' THEN 'bin.000001' END AS start_name,
  CASE source WHEN 'marks' THEN p1::BIGINT WHEN 'saved' THEN k * 10 END AS start_pos, CASE WHEN source = 'marks' THEN p2::BIGINT END AS high_water FROM st""")
def start_position(spark, sf_dir):
    return recovery.start_position(task_states(spark, sf_dir))


@query(f"""WITH {STATES_SQL}, e AS (SELECT event_id AS seq, 'task_' || (user_id % 25) AS task_id, 4 + event_id * 37 % 6000 AS log_pos FROM events),
m AS (SELECT e.*, source = 'marks' AS rec, source = 'marks' AND ((log_pos = p1 AND NOT ok1) OR (log_pos = p2 AND NOT ok2)) AS failed, p2 FROM e JOIN st USING (task_id)),
w AS (SELECT *, coalesce(max(CASE WHEN rec AND log_pos > p2 AND NOT failed THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) = 1 AS left_ FROM m)
SELECT seq, task_id, log_pos, NOT rec OR failed OR left_ AS processed FROM w""")
def recovery_skip(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), F.concat(F.lit("task_"), F.col("user_id") % 25).alias("task_id"), F.lit("bin.000001").alias("log_file"), (F.col("event_id") * 37 % 6000 + 4).alias("log_pos"))
    return recovery.replay(e, task_states(spark, sf_dir)).select("seq", "task_id", "log_pos", "processed")


@query("""WITH e AS (SELECT event_id AS seq, event_id % 997 + 4 AS log_pos, event_type, CASE WHEN event_type = 'error' THEN 'bin.' || lpad((event_id // 50)::VARCHAR, 6, '0') END AS nm, event_id % 3 * 4 AS np FROM events WHERE event_type IN ('error', 'signup')),
b AS (SELECT *, coalesce(last_value(nm IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'bin.000000') AS before FROM e)
SELECT seq, coalesce(nm, before) AS name, CASE WHEN nm IS NOT NULL AND np <> 0 THEN np ELSE log_pos END AS pos FROM b WHERE nm IS NULL OR nm <> before""")
def rotate_positions(spark, sf_dir):
    """Errors stand for rotations (some to the same file, some to position 0), signups for applied statements."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, rot = F.col("event_id"), F.col("event_type") == "error"
    log = e.select(k.alias("seq"), (k % 997 + 4).alias("log_pos"), F.when(rot, "rotate").when(F.col("event_type") == "signup", "query").otherwise("rows").alias("kind"), F.lit("alter table t add a int").alias("query"), F.lit("").alias("default_schema"), F.lit(0).alias("error_code"), F.when(rot, F.concat(F.lit("bin."), F.lpad(F.floor(k / 50).cast("string"), 6, "0"))).alias("next_log_name"), (k % 3 * 4).alias("next_pos"))
    return recovery.positions(log, TASK, "bin.000000")


@query("SELECT task_id, seq, log_pos FROM (SELECT 'task_' || (user_id % 25) AS task_id, event_id AS seq, event_id * 10 AS log_pos, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'error') WHERE n <= 2")
def marks_last_two(spark, sf_dir):
    k = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("task_"), F.col("user_id") % 25).alias("task_id"), k.alias("seq"), (k * 10).alias("log_pos"), F.when(F.col("event_type") == "error", "query").otherwise("rows").alias("kind"))
    return recovery.last_marks(e).select("task_id", "seq", "log_pos")


@query("""WITH e AS (SELECT 'task_' || (user_id % 25) AS task_id, event_id AS seq, event_id * 10 AS log_pos, event_id % 3 <> 0 AS done FROM events WHERE event_type <> 'error'),
l AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS n FROM e)
SELECT task_id, string_agg(log_pos || ':' || done, ',' ORDER BY seq) AS marks FROM l WHERE n <= 2 GROUP BY task_id""")
def marks_completed(spark, sf_dir):
    """The marks of 25 tasks, of whose events two in three were completed."""
    k = F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type <> 'error'").select(F.concat(F.lit("task_"), F.col("user_id") % 25).alias("task_id"), k.alias("seq"), F.lit("bin.000001").alias("log_file"), (k * 10).alias("log_pos"), F.lit("rows").alias("kind"))
    marks = recovery.mark_states(e, e.filter("seq % 3 <> 0"))
    return marks.select("task_id", F.array_join(F.transform("marks", lambda m: F.concat(m["pos"].cast("string"), F.lit(":"), m["success"].cast("string"))), ",").alias("marks"))


@query("SELECT 'nation/' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '!' ELSE n_name END AS value FROM nation WHERE n_nationkey % 5 <> 0")
def kv_upserts(spark, sf_dir):
    """A key for each nation: set, half of them set again, a fifth deleted; other keys beside them."""
    kv = KeyValueStore(spark, work_path(spark, "kv"))
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect():  # 25 rows
        key = f"nation/{r.n_nationkey}"
        kv.set(key, r.n_name)
        kv.set(f"other/{r.n_nationkey}", None)
        if r.n_nationkey % 2 == 0:
            kv.set(key, kv.get(key) + "!")
        if r.n_nationkey % 5 == 0:
            kv.delete(key)
    return kv.frame("nation/").select("key", F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"].alias("value"))


def write_log(spark: SparkSession, events: DataFrame, folder: str, number: int) -> None:
    """One file of a log, as lines of JSON in the order of the log."""
    events.select("seq", F.to_json(F.struct("*")).alias("value")).orderBy("seq").select("value").coalesce(1).write.text(f"{folder}/.{number}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(f"{folder}/.{number}")) if s.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/bin.{number}.jsonl"))


@query(f"""WITH {ORDERS_SQL} SELECT seq, 'task_001.' || db || '.' || tbl AS topic, action, CASE WHEN action <> 'insert' THEN price::VARCHAR END AS before_price,
  CASE action WHEN 'insert' THEN price::VARCHAR WHEN 'update' THEN (price + 1)::VARCHAR END AS after_price FROM o WHERE action <> '' AND seq >= 400""")
def source_change_log(spark, sf_dir):
    """A log in files whose numbers gain a digit, from the second one on; in two runs, the second of which finds another file."""
    spark.dataSource.register(ChangeLogSource)
    home, events = work_path(spark, "log"), seeds.orders_log(spark, sf_dir)
    conf = FileConf(f"{home}/out")
    feed = ChangeFeed(spark, lambda: TASK, FileSink(conf), seeds.orders_catalog(spark), f"{home}/state")

    def run():
        stream = spark.readStream.format("change_log").option("path", f"{home}/log").option("startingOffset", '{"file": "bin.9.jsonl", "pos": 0}')
        stream.load().writeStream.option("checkpointLocation", f"{home}/checkpoint").foreachBatch(feed).trigger(availableNow=True).start().awaitTermination()

    for number, kept in ((8, "seq < 400"), (9, "seq >= 400 and seq < 900"), (10, "seq >= 900 and seq < 1200")):
        write_log(spark, events.filter(kept), f"{home}/log", number)
    run()
    write_log(spark, events.filter("seq >= 1200"), f"{home}/log", 11)
    run()
    e = encode.parsed(read_files(spark, conf))
    return e.select("seq", "topic", "action", e.before["price"].alias("before_price"), e.after["price"].alias("after_price"))


@query(f"""WITH {ORDERS_SQL} SELECT 1 AS life, seq, 'task_001.' || db || '.' || tbl AS topic, action FROM o
  WHERE action <> '' AND CASE WHEN seq % 3 < 2 THEN db IN ('db0', 'db1') ELSE db IN ('db0', 'db1', 'db2') AND NOT (db = 'db0' AND tbl = 't1') END
UNION ALL SELECT 2, seq, 'task_001.' || db || '.' || tbl, action FROM o WHERE action <> '' AND db = 'db3'""")
def task_lifecycle(spark, sf_dir):
    """A task is created, stopped, resumed by another engine, updated, recovered by a third one and deleted, a third of the
    log coming in before each start; then one of its id is created again, over the whole log and other tables."""
    home, events = work_path(spark, "engine"), seeds.orders_log(spark, sf_dir)
    engine = lambda: TaskEngine(spark, home, lambda task, starting: stream_events(spark, f"{home}/log"), lambda task: seeds.orders_catalog(spark))
    arrive = lambda third: events.filter(F.col("seq") % 3 == third).write.mode("append").parquet(f"{home}/log")
    lives = [FileConf(f"{home}/out/{life}") for life in (1, 2)]

    first, second, third = engine(), engine(), engine()
    arrive(0)
    first.create(Task("task_001", database=("db0", "db1"), file_conf=lives[0]), once=True)
    first.wait("task_001")
    first.stop("task_001")
    arrive(1)
    assert second.recover_all() == {}  # a stopped task stays so
    second.resume("task_001", once=True)
    second.wait("task_001")
    second.update(TaskUpdate("task_001", ("db0", "db1", "db2"), (), ("db0.t1",)))
    arrive(2)
    assert third.recover_all(once=True) == {"task_001": None}
    third.wait("task_001")
    third.delete("task_001")
    third.create(Task("task_001", tables=("db3.*",), file_conf=lives[1]), once=True)
    third.wait("task_001")
    third.delete("task_001")
    rows = [encode.parsed(read_files(spark, conf)).select(F.lit(life).alias("life"), "seq", "topic", "action") for life, conf in enumerate(lives, 1)]
    return rows[0].unionByName(rows[1])


def run_stream(spark: SparkSession, events: DataFrame, catalog: DataFrame, task: Task = TASK, batches: int = 3) -> tuple[FileConf, ChangeFeed]:
    """Events as files in the order of the log, streamed file by file through the feed into a file sink."""
    home = work_path(spark, "stream")
    events.repartitionByRange(batches, "seq").sortWithinPartitions("seq").write.option("maxRecordsPerFile", 1_000_000).parquet(f"{home}/log")
    conf = FileConf(f"{home}/out")
    feed = ChangeFeed(spark, lambda: task, FileSink(conf), catalog, f"{home}/state")
    stream_events(spark, f"{home}/log").writeStream.option("checkpointLocation", f"{home}/checkpoint").foreachBatch(feed).trigger(availableNow=True).start().awaitTermination()
    return conf, feed


@query(EVOLVED_SQL)
def stream_schema_evolution(spark, sf_dir):
    """decode_schema_evolution as a stream."""
    conf, _ = run_stream(spark, seeds.evolving_lines_log(spark, sf_dir), seeds.lines_catalog(spark))
    return _evolved(encode.parsed(read_files(spark, conf)))


@query(f"WITH {LINES_SQL} {LINE_FLAT_SQL.format(action='insert')}")
def stream_decode_insert(spark, sf_dir):
    conf, _ = run_stream(spark, seeds.lines_log(spark, sf_dir, "WRITE_ROWS_EVENTv2"), seeds.lines_catalog(spark))
    return flat_lines(encode.parsed(read_files(spark, conf)), "after")


@query(f"""WITH {ORDERS_SQL}, c AS (SELECT *, o_custkey % 50 AS k, CASE WHEN action = 'update' THEN price + 1 ELSE price END AS p FROM o WHERE action <> ''),
l AS (SELECT *, row_number() OVER (PARTITION BY db, tbl, k ORDER BY seq DESC) AS n FROM c)
SELECT db AS database, tbl AS "table", k::VARCHAR AS k, p::VARCHAR AS price FROM l WHERE n = 1 AND action <> 'delete'""")
def ext_latest_image(spark, sf_dir):
    """The rows that the log leaves, with the customer modulo 50 as the key of a table."""
    e = seeds.orders_log(spark, sf_dir)
    e = e.withColumn("rows", F.transform("rows", lambda r: F.array(r[0], (r[1].cast("long") % 50).cast("string"), r[2], r[3])))
    v = views.latest_images(order_changes(spark, sf_dir, events=e), "custkey")
    return v.select("database", "table", "k", v.image["price"].alias("price"))


@query(f"WITH {ORDERS_SQL} SELECT 'task_001.' || db || '.' || tbl AS topic, action, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq FROM o WHERE action <> '' GROUP BY ALL")
def ext_change_counts(spark, sf_dir):
    return views.change_counts(order_changes(spark, sf_dir))
