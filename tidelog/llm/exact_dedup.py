"""Exact dedup: combine locally, by salted digest, then over the salts, with the full content in every key.

1. *Local.* Each task folds its own equal texts (partial aggregation, before anything is shuffled).
2. *Salted.* Partial groups meet by (digest, salt, text); a hot text is spread over `n_salts` tasks.
3. *Global.* Each salt's winner meets the others by (digest, text): at most `n_salts` rows a text.

The text itself is part of every grouping key, so two texts with one digest stay two groups. Rows find
their group by digest alone only where that digest has a single text, which is counted; the other
digests, if any, are joined by digest and text. Of the largest group, AQE splits the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import ascii_lower
from tidelog.session import materialize


def digest(norm: str) -> Column:
    return F.unhex(F.sha2(norm, 256))


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_salts: int = 16) -> DataFrame:
    """One row per distinct normalised text: digest, norm, keep_id (largest id), group_size."""
    norm = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm")).select("id", "norm", digest("norm").alias("digest"), F.pmod(F.xxhash64("id"), F.lit(n_salts)).alias("salt"))
    salted = norm.groupBy("digest", "salt", "norm").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_salts: int = 16) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and form one group with empty ones. Of equal texts the row with the largest
    id stays; a null id never wins against another id, and a group of null ids keeps them (keep_id null).
    Rows that repeat the winning id and text can't be told apart and all stay. Other columns are ignored,
    whatever their names; an empty table gives an empty result. A very long text is a key like others: a row of one
    task, shuffled whole twice.
    """
    groups = materialize(content_groups(docs, id_col, text_col, n_salts).select("digest", "keep_id", "group_size", F.xxhash64("norm").alias("content")), "exact-groups")
    clashing = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm")).select("id", digest("norm").alias("digest"))
    if clashing.isEmpty():
        joined = rows.join(groups, "digest")
    else:  # one digest, several texts: those are told apart by their content
        full = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("norm")).withColumn("digest", digest("norm"))
        among = full.join(clashing, "digest", "left_semi").join(content_groups(docs, id_col, text_col, n_salts), ["digest", "norm"]).select("digest", "id", "keep_id", "group_size")
        joined = rows.join(clashing, "digest", "left_anti").join(groups, "digest").select("digest", "id", "keep_id", "group_size").unionByName(among)
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
