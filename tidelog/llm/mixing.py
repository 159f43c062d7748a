"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a fixed pseudo-random order (md5 of the id and of the text's md5, so that
rows without an id are spread too), run through up to `max_epochs` times. A document's virtual finish time is the tokens of its source up to and including it,
divided by the source's target. Serving all queues by finish time up to the total budget gives each source
its target but for a document. Both running sums (inside a source, over all finish times) are taken in two
levels: sums of buckets, then rows inside one bucket, so that no task holds a source or the whole order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.shared import running, word_count
from tidelog.session import materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source (null last): source_size, weight and target, for a budget of 150% of all sizes.

    Targets are water levels: a source whose share exceeds twice its size stops there and the excess goes
    to the others by weight. In the order of size / weight the stopped sources are a prefix; source i is
    stopped if what the sources before it leave, dealt by weight to the rest, fills it. All in integers.
    """
    lcm = math.lcm(*weights)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running(per, [F.col("source").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * 2
    ratio = (F.col("source_size") * F.lit(lcm) / F.col("weight")).cast("decimal(38,0)")
    filled = materialize(running(ranked, [ratio, F.col("rank")], {"before": cap, "lighter": F.col("weight")}), "mix-sources")
    total, weight = (x or 0 for x in filled.agg(F.sum("source_size"), F.sum("weight")).first())
    stopped = (F.lit(total * 3).cast("long") - F.col("before") * 2).cast("decimal(38,0)") * F.col("weight") >= (F.lit(weight) - F.col("lighter")).cast("decimal(38,0)") * cap * 2
    filled = filled.withColumn("stopped", stopped)
    taken, open_ = (x or 0 for x in filled.agg(F.sum(F.when(F.col("stopped"), cap)), F.sum(F.when(~F.col("stopped"), F.col("weight")))).first())
    share = (F.lit(total * 3 - taken * 2) * F.col("weight")) / F.lit(float(2 * open_ or 1))
    target = F.when(F.col("stopped"), cap.cast("double")).otherwise(share)
    return filled.select("source", "source_size", "weight", target.alias("target"), F.lit(total).cast("long").alias("total"))


def row_key(doc_id: Column, text: Column) -> Column:
    """md5 of an id and of a text's md5: the order of documents within their source."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 2, with_key: bool = False) -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken (words the mix takes, repeats counted), and
    row_key() as `key` if asked, which tells rows of one id with different texts apart.

    The document at the end of the budget is taken in part. Null text is of size 0, null source is a source
    of its own and sorts last; size 0 takes 0. Rows that repeat an id follow each other by size; the result
    doesn't depend on how the input is partitioned. Other columns are ignored. Empty in, empty out. Of a very long
    text only its number of words and a digest are kept.
    """
    sized = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), row_key(F.col(id_col), F.col(text_col)).alias("at")),
        "mix-sized",
    )
    buckets = math.isqrt(sized.count()) + 1  # as many buckets as rows in one: neither level outgrows a task
    nulls = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("key")]
    rows = sized.select("id", "size", "at", "source", *nulls, F.floor(F.conv(F.substring("at", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).alias("bucket"))
    sums = rows.groupBy("no_source", "key", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("no_source", "key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sized, weights).select(*nulls, "source_size", "target", "total")
    offsets = sums.withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n").join(targets, ["no_source", "key"])
    inside = Window.partitionBy("no_source", "key", "bucket").orderBy("at", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("cum", F.sum("size").over(inside)).join(offsets, ["no_source", "key", "bucket"]).withColumn("cum", F.col("cum") + F.col("offset"))
    queued = materialize(queued.select("id", "size", "at", "no_source", "key", "cum", "source_size", "target", "total"), "mix-queued")

    finishes = [F.floor(F.least((F.col("source_size") * e + F.col("cum")) / F.col("target"), F.lit(2.0)) * buckets).alias(f"slot{e}") for e in range(max_epochs)]
    positive = queued.filter("size > 0").select("size", "total", *finishes)
    slots = positive.select("size", "total", F.explode(F.array(*[f"slot{e}" for e in range(max_epochs)])).alias("slot")).groupBy("slot").agg(F.sum("size").alias("n"), F.max("total").alias("total"))
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("left", F.floor(F.col("total") * 3 / 2) - F.coalesce(F.sum("n").over(upto), F.lit(0)))
    # one row: the slot in which the budget ends, and what is left for it; null if the budget takes everything
    cut, left = slots.filter("left >= 0 and left < n").agg(F.min_by("left", "slot").alias("left"), F.min("slot").alias("slot")).select("slot", "left").first()
    if cut is None:
        return _result(queued.withColumn("taken", F.col("size") * max_epochs), id_col, with_key)
    placed = queued.select("*", *finishes)
    whole = F.lit(0).cast("long")
    for e in range(max_epochs):
        whole = whole + F.when(F.col(f"slot{e}") < cut, F.col("size")).otherwise(0)
    row = ["no_source", "key", "at", "size", "cum"]  # among sizes above 0, cum tells the rows of a source apart
    one_slot = Window.partitionBy("slot").orderBy("finish", "no_source", "key", "at", "id", "epoch").rowsBetween(Window.unboundedPreceding, -1)
    runs = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), F.col(f"slot{e}").alias("slot")) for e in range(max_epochs)]))
    edge = placed.filter("size > 0").select("id", "source_size", "target", *row, runs.alias("r")).select("*", "r.epoch", "r.slot").filter(F.col("slot") == cut)
    edge = edge.withColumn("finish", (F.col("source_size") * F.col("epoch") + F.col("cum")) / F.col("target"))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.lit(left) - F.coalesce(F.sum("size").over(one_slot), F.lit(0)))))
    edge = edge.groupBy(*row).agg(F.sum("part").alias("part"))
    taken = placed.withColumn("whole", whole).join(edge, row, "left").withColumn("taken", F.when(F.col("size") > 0, F.col("whole") + F.coalesce(F.col("part"), F.lit(0))).otherwise(0))
    return _result(taken, id_col, with_key)


def _result(rows: DataFrame, id_col: str, with_key: bool) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.col("taken").cast("long").alias("taken"), *([F.col("at").alias("key")] if with_key else []))
