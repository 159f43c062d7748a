"""Token counts by source, language and tokenizer version, kept as sums of signed deltas.

A batch of changes folds to a few signed totals and is committed as one folder named by its batch id. The
folder is written whole and counts only with its success marker, so a batch that is committed again, or
again after a crash, changes nothing. Totals are the sum of all batches; compaction folds batches into one
base without changing what commits see.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals of changes with columns op, source, lang, tokenizer, tokens and old_tokens.

    insert adds a document and its tokens, delete takes both away, revise adds tokens - old_tokens. Null
    counts are 0; null keys are keys like others; another op is an error. Each row counts, repeated or not.
    A document that moves to another key is a delete and an insert. No texts are read, other columns are ignored, and
    empty changes have no totals.
    """
    tokens, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
    wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(F.col("op"), F.lit("null"))))
    signed = F.when(F.col("op") == "insert", tokens).when(F.col("op") == "delete", -tokens).when(F.col("op") == "revise", tokens - old).otherwise(wrong.cast("long"))
    one = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return changes.select(*KEYS, one.cast("long").alias("documents"), signed.alias("tokens")).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


def content() -> Column:
    """One number for what a batch adds, whatever the order of its rows."""
    return F.coalesce(F.bit_xor(F.xxhash64(*KEYS, "documents", "tokens")), F.lit(0)).alias("content")


class TokenRollup:
    """A rollup under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _names(self, kind: str) -> list[str]:
        """Complete folders of a kind: bases, or batches since the newest base."""
        if not self._exists(kind):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{kind}"))]
        return sorted(n for n in found if self._exists(f"{kind}/{n}/_SUCCESS"))

    def _held(self) -> DataFrame:
        """batch and content of the batches that the newest base holds. Any number of them, so never collected whole."""
        bases = self._names("bases")
        schema = "batch string, content long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/held/{bases[-1]}") if bases else self.spark.createDataFrame([], schema)

    def _since(self) -> list[str]:
        """Ids of the batches that the newest base doesn't hold yet; a compaction that died may have left others."""
        names = [n.removeprefix("batch=") for n in self._names("batches")]
        held = {r.batch for r in self._held().filter(F.col("batch").isin(names)).collect()} if names else set()  # of `names` only
        return [n for n in names if n not in held]

    def _rows(self, batches: list[str]) -> DataFrame:
        """What some batches add, with their ids."""
        paths = [f"{self.path}/batches/batch={n}" for n in batches]
        schema = f"{SCHEMA}, batch string"
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/batches").parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _contents(self, batches: list[str]) -> DataFrame:
        names = self.spark.createDataFrame([(n,) for n in batches], "batch string")
        found = self._rows(batches).groupBy("batch").agg(content())
        return names.join(found, "batch", "left").select("batch", F.coalesce("content", F.lit(0)).alias("content"))

    def batches(self) -> DataFrame:
        """batch and content of every committed batch."""
        return self._held().unionByName(self._contents(self._since()))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing changes, if it was committed before. Commits are one at a time.

        A batch that comes again is folded again and held against what was committed: other content under a used id
        is an error.
        """
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits, '_', '.' and '-' only")
        signed, kept = deltas(changes), self._exists(f"batches/batch={batch_id}/_SUCCESS")
        known = (self._contents([batch_id]) if kept else self._held().filter(F.col("batch") == batch_id)).select("content").first()
        if known is None:
            signed.write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch_id}")
            return True
        if signed.agg(content()).first().content != known.content:
            raise ValueError(f"batch id {batch_id!r} was committed with other content")
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all batches; keys whose totals are all 0 stay out."""
        rows, bases = self._rows(self._since()).drop("batch"), self._names("bases")
        if bases:
            rows = rows.unionByName(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/bases/{bases[-1]}"))
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")

    def compact(self) -> None:
        """Fold all batches into a new base; a crash before its marker leaves the old state."""
        since = self._since()
        label = f"{len(self._names('bases')):08d}"
        self.batches().write.mode("overwrite").parquet(f"{self.path}/held/{label}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/bases/{label}")
        for n in since:
            self._fs.delete(self._path(f"{self.path}/batches/batch={n}"), True)
