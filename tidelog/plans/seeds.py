"""Change logs derived from the driver's tables, deterministic by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import COLUMNS, RAW_EVENTS

#: ALTER statements and their edge cases: (id, statement). Columns before: START_COLUMNS; database list: shop.
STATEMENTS = [
    (1, "/* c */alter table shop.visit change num total int(64) default 20 null"),
    (2, "alter table shop.visit modify column num int(64) default 20 null"),
    (3, "alter table shop.visit drop column page"),
    (4, "/* app */ alter table shop.visit add note varchar(100) null"),
    (5, "alter table shop.visit add age int(4) default 20 after host"),
    (6, "alter table visit add flag int (5) default 4  first"),
    (7, "ALTER TABLE shop.visit CHANGE `num` n2 float(20,6) NULL"),
    (8, "ALTER TABLE shop.visit MODIFY COLUMN num decimal(20,6) NULL"),
    (9, "ALTER TABLE shop.visit DROP COLUMN num"),
    (10, "ALTER TABLE shop.visit ADD via varchar(100) NULL"),
    (11, "ALTER TABLE shop.visit ADD lang varchar(100) NULL"),
    (12, "ALTER TABLE shop.visit CHANGE COLUMN num n2 int"),
    (13, "ALTER TABLE shop.visit ADD INDEX ix (host)"),
    (14, "ALTER TABLE shop.visit ADD a int, ADD b int"),
    (15, "ALTER TABLE other.t ADD a int"),
    (16, "ALTER  TABLE shop.visit ADD a int"),
    (17, "ALTER TABLE shop.visit ADD a int AFTER nope"),
    (18, "ALTER TABLE shop.visit"),
    (19, "CREATE TABLE t (a int)"),
    (20, "ALTER TABLE shop.visit DROP page;"),
    (21, "ALTER TABLE `shop`.`visit` ADD a int"),
    (22, "ALTER TABLE shop.visit RENAME COLUMN num TO n2"),
    (23, "BEGIN"),
]
START_COLUMNS = ("id", "kind", "host", "page", "lang", "num")

#: A statement for each part, put together from its key; {div} is the dialect's integer division, {db} the default schema.
GENERATED = """
CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/* c */' WHEN 2 THEN '  ' ELSE '/* alter */ ' END
|| CASE p_partkey % 9 WHEN 0 THEN 'alter table' WHEN 1 THEN 'ALTER  TABLE' WHEN 2 THEN 'Alter Table' WHEN 3 THEN 'CREATE TABLE' ELSE 'ALTER TABLE' END
|| ' ' || CASE p_partkey {div} 2 % 8 WHEN 0 THEN 'visit' WHEN 1 THEN '`visit`' WHEN 2 THEN 'other.visit' WHEN 3 THEN 'visit' WHEN 4 THEN {db} || '.visit.x' ELSE {db} || '.visit' END
|| CASE p_partkey {div} 7 % 12 WHEN 0 THEN '' WHEN 1 THEN ' modify' WHEN 2 THEN ' rename' WHEN 3 THEN ' drop' WHEN 4 THEN ' DROP' WHEN 5 THEN ' change' WHEN 6 THEN ' Change' ELSE ' ADD' END
|| CASE p_partkey {div} 5 % 4 WHEN 0 THEN ' column' WHEN 1 THEN ' COLUMN' ELSE '' END
|| CASE p_partkey {div} 11 % 9 WHEN 0 THEN '' WHEN 1 THEN ' host' WHEN 2 THEN ' `page`' WHEN 3 THEN ' lang' WHEN 4 THEN ' num;' WHEN 5 THEN ' id' ELSE ' n' || (p_partkey {div} 3 % 12) END
|| CASE p_partkey {div} 13 % 3 WHEN 0 THEN '' WHEN 1 THEN ' n' || (p_partkey % 12) ELSE ' kind' END
|| CASE p_partkey {div} 17 % 7 WHEN 0 THEN ' int' WHEN 1 THEN ' int FIRST' WHEN 2 THEN ' int after host' WHEN 3 THEN ' int AFTER nope' WHEN 4 THEN ' varchar(9) null  first ' WHEN 5 THEN ' int after n1' ELSE '' END
"""


def generated_statements(spark: SparkSession, sf_dir: str, db: str) -> DataFrame:
    """seq, default_schema and query of a statement for each part. db: SQL for the default schema by p_partkey."""
    text = GENERATED.format(div="div", db="(" + db + ")")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return as_read(parts.select(F.col("p_partkey").alias("seq"), F.expr(db).alias("default_schema"), F.expr(text).alias("query")))


LINE_COLUMNS = ("partkey", "suppkey", "linenumber", "quantity", "price")
ORDER_COLUMNS = ("orderkey", "custkey", "status", "price")


def money(c: str) -> Column:
    return F.round(F.col(c).cast("decimal(20,4)"), 2).cast("decimal(18,2)")


def shaped(df: DataFrame) -> DataFrame:
    """Raw events with the columns that df lacks as nulls, in order."""
    fields = [f.strip().split(" ", 1) for f in RAW_EVENTS.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def as_read(df: DataFrame) -> DataFrame:
    """df with its columns as a scan would give them: later filters don't spell out how they were made."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("e")).select("e.*")


def columns(names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit("").alias("type"), F.lit(False).alias("not_null")) for n in names]).cast(COLUMNS)


def position(seq: str) -> list[Column]:
    s = F.col(seq)
    return [F.concat(F.lit("bin."), F.lpad(F.floor(s / 1000).cast("string"), 6, "0")).alias("log_file"), (s % 1000 * 100 + 4).alias("log_pos"), s.alias("seq")]


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts, updates (image after first), deletes and unknown events over 20 tables of 4 databases."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("price", money("o_totalprice"))
    k = F.col("o_orderkey")
    cells = lambda price: F.array(k.cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderstatus"), price.cast("string"))
    r = k % 7
    kind = F.when(r < 2, "WRITE_ROWS_EVENTv2").when(r == 2, "WRITE_ROWS_EVENTv1").when(r < 5, "UPDATE_ROWS_EVENTv2").when(r == 5, "DELETE_ROWS_EVENTv1").otherwise("TABLE_MAP_EVENT")
    rows = F.when(r.isin(3, 4), F.array(cells(F.col("price") + 1), cells(F.col("price")))).otherwise(F.array(cells(F.col("price"))))
    return shaped(
        o.select(*position("o_orderkey"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.lit("rows").alias("kind"), kind.alias("event_type"), F.concat(F.lit("db"), F.col("o_custkey") % 4).alias("db"), F.concat(F.lit("t"), k % 5).alias("tbl"), rows.alias("rows"))
    )


def orders_catalog(spark: SparkSession) -> DataFrame:
    names = spark.range(20).select(F.concat(F.lit("db"), (F.col("id") % 4).cast("string")).alias("db"), F.concat(F.lit("t"), F.floor(F.col("id") / 4).cast("string")).alias("tbl"))
    return names.withColumn("columns", columns(ORDER_COLUMNS))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and ls: an order's lines as sorted structs of all their cells."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    s = F.struct(F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.col("l_linenumber").alias("linenumber"), money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"))
    return li.groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(s)).alias("ls"))


def line_cells(x: Column, more: Column | None = None) -> Column:
    return F.array(*[(x[c] + more if c == "quantity" and more is not None else x[c]).cast("string") for c in LINE_COLUMNS])


def lines_log(spark: SparkSession, sf_dir: str, event_type: str, rows: Column | None = None) -> DataFrame:
    """A multi-row event of table shop.lineitem for each order."""
    rows = F.transform("ls", lambda x: line_cells(x)) if rows is None else rows
    return as_read(shaped(lines(spark, sf_dir).select(*position("key"), F.col("key").alias("ts"), F.lit("rows").alias("kind"), F.lit(event_type).alias("event_type"), F.lit("shop").alias("db"), F.lit("lineitem").alias("tbl"), rows.alias("rows"))))


def update_pairs(first_is_after: bool = True) -> Column:
    """Images of updates that raise the quantity by one."""
    new, old = (lambda x: line_cells(x, F.lit(1))), line_cells
    pair = (lambda x: F.array(new(x), old(x))) if first_is_after else (lambda x: F.array(old(x), new(x)))
    return F.flatten(F.transform("ls", pair))


def lines_catalog(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("shop").alias("db"), F.lit("lineitem").alias("tbl"), columns(LINE_COLUMNS).alias("columns"))


#: Statements among the line events: (seq, statement); they hold for later events.
LINE_DDL = [(300, "alter table shop.lineitem add note varchar(10) null"), (700, "ALTER TABLE lineitem DROP COLUMN suppkey"), (1000, "alter table shop.lineitem change price amount decimal(18,2)")]


def evolving_lines_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts whose cells follow LINE_DDL, and the statements."""
    k = F.col("key")

    def cells(x):
        number = F.concat(F.lit("n"), x["linenumber"].cast("string"))
        five = line_cells(x)
        return F.when(k <= 300, five).when(k <= 700, F.concat(five, F.array(number))).otherwise(F.concat(F.slice(five, 1, 1), F.slice(five, 3, 3), F.array(number)))

    rows = lines_log(spark, sf_dir, "WRITE_ROWS_EVENTv2", F.transform("ls", cells))
    ddl = spark.createDataFrame(LINE_DDL, "seq long, query string")
    return rows.unionByName(shaped(ddl.select(*position("seq"), F.lit(0).alias("ts"), F.lit("query").alias("kind"), "query", F.lit("shop").alias("default_schema"), F.lit(0).alias("error_code"))))
