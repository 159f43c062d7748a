"""From documents to token ids: rules, exact copies, near copies, the mix of sources, encoding.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and but for the last returns the
columns of documents. Stages decide by id and text, so rows that share an id but not a text have each their own fate;
rows that share both stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bpe import encode
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.jaccard_join import jaccard_groups, text_key
from tidelog.llm.mixing import mix, row_key
from tidelog.llm.quality_rules import keep_good
from tidelog.llm.shared import ascii_lower, table, tokenizer_path
from tidelog.session import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 rejects go."""
    return keep_good(docs, "v1")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    stay = exact_dedup(docs).filter("kept").select("doc_id", "text_sha256").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.sha2(ascii_lower(F.col("d.text")), 256) == F.col("s.text_sha256"))
    return docs.alias("d").join(stay.alias("s"), same, "left_semi")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity links one document stays, of the smallest id; rows without an id stay."""
    drop = jaccard_groups(docs).filter("not kept").select("doc_id", "text_key").distinct()
    same = (F.col("d.doc_id") == F.col("s.doc_id")) & (text_key(F.col("d.text")) == F.col("s.text_key"))
    return docs.alias("d").join(drop.alias("s"), same, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. The one at the end of the budget counts whole."""
    taken = mix(docs, with_key=True).filter("taken > 0").select("key", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    taken = taken.groupBy("key").agg(F.max("times").alias("times"))
    joined = docs.alias("d").join(taken.alias("s"), row_key(F.col("d.doc_id"), F.col("d.text")) == F.col("s.key"))
    return joined.select("d.*", F.explode(F.sequence(F.lit(1), F.col("s.times"))).alias("_time")).drop("_time")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row of the mix."""
    return encode(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixing", mixing), ("bpe", bpe)]

#: Similarity groups and token ids are beyond SQL; tests compare the pipeline with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
