"""What several operators of this subpackage use: the definition of a word, normalisation, table reads."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import materialize

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words in order; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty. lower() does the same where all characters are ASCII."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where a vocabulary file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def parts_of(docs: DataFrame, text_col: str = "text", part_bytes: int = 20 << 20, known_up_to: int = 1 << 40) -> int:
    """Into how many parts to deal what comes from these texts, so that a part's share of them stays bounded: by their
    size, and at least as many as shuffle partitions.

    The size is what Spark knows of the table's files, twice that as they are packed. Where Spark knows nothing (it then
    takes the table for immense) or the table is immense, the texts' bytes are added up in a pass over their column.
    """
    size = 2 * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > known_up_to:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of sums, its total over the rows that come before in a total order.

    Rows are sorted by ranges and written; each range has its own running sums, and the ranges before it count as one
    number each, so no task holds more than a range or a row a range.
    """
    placed = materialize(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    per = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    ahead = per.select("_range", *[zero(F.sum(f"_{n}").over(before(Window.orderBy("_range")))).alias(f"_{n}") for n in sums])
    inside = before(Window.partitionBy("_range").orderBy(*order))
    found = placed.withColumns({n: zero(F.sum(c).over(inside)) for n, c in sums.items()}).join(ahead, "_range")
    return found.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


@contextlib.contextmanager
def small_batches(spark: SparkSession, batch_bytes: int = 8 << 20) -> Iterator[None]:
    """What is run within hands rows to Python in batches of about so many bytes."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(batch_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def release() -> None:
    """Give freed memory back to the system: an executor's Python workers wait between tasks with what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
