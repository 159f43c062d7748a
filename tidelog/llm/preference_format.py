"""Preference formatting: one prompt from the turns that chosen and rejected share, and two masked completions.

All of it is array functions on the two turn lists, so a pair stays one row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


def rendered(turn: Column) -> Column:
    """A turn in chat markup; null role and text are empty."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(turn["role"], F.lit("")), F.lit("\n"), F.coalesce(turn["text"], F.lit("")), F.lit("<|im_end|>\n"))


def mask_spans(turns: Column, learned: tuple[str, ...]) -> Column:
    """[start, end) character spans of the rendered turns on which loss is taken: text and end mark of learned roles."""
    empty = F.array().cast("array<struct<start:long,end:long>>")
    head = lambda t: F.length(F.coalesce(t["role"], F.lit(""))) + len("<|im_start|>\n")
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))

    def step(state, t):
        after = state["at"] + F.length(rendered(t))
        span = F.struct((state["at"] + head(t)).cast("long").alias("start"), (after - 1).cast("long").alias("end"))
        is_learned = F.coalesce(t["role"].isin(*learned), F.lit(False))
        return F.struct(after.cast("long").alias("at"), F.when(is_learned, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_preferences(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per pair: id_col, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, usable.

    The prompt is the longest common turn prefix (roles and texts equal, nulls equal to nulls), rendered once;
    the completions are the remaining turns of each side with spans, relative to the completion, of learned
    roles. Null conversations count as empty. Where one side is a prefix of the other, its completion is empty;
    usable says that the completions differ and each has a learned span. Rows are independent: ids may be null
    or repeat, other columns are ignored, empty in, empty out. A pair of very long conversations is one row of one task.
    """
    side = lambda c: F.coalesce(F.col(c).cast(TURNS), F.array().cast(TURNS))
    both = pairs.select(F.col(id_col).alias("id"), side(chosen_col).alias("c"), side(rejected_col).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, F.greatest(least, F.lit(0))), F.slice("r", 1, F.greatest(least, F.lit(0))), lambda a, b: a.eqNullSafe(b))
    first = F.array_position(same, F.lit(False))
    cut = both.withColumn("n", F.when(first > 0, first - 1).otherwise(least).cast("int"))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    parts = cut.select("id", "n", F.slice("c", 1, F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    text = lambda c: F.array_join(F.transform(c, rendered), "")
    out = parts.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_prompt_turns"), text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), mask_spans(F.col("c"), learned).alias("chosen_mask"), mask_spans(F.col("r"), learned).alias("rejected_mask"))
    return out.withColumn("usable", (F.col("chosen") != F.col("rejected")) & (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))


def conversation_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id_col and turns, by turn number (null first), then role and text.

    A conversation is one row by nature, however many turns it has (rows that repeat are turns of their own). Rows
    without an id can't be told to belong together: each is a conversation of its own.
    """
    as_turn = F.struct(F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    turn = F.struct(F.col(turn_col).alias("turn"), as_turn["role"].alias("role"), as_turn["text"].alias("text"))
    grouped = conversations.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    known = grouped.select(id_col, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return known.unionByName(conversations.filter(F.col(id_col).isNull()).select(F.col(id_col), F.array(as_turn).alias("turns")))


def stale_reply_pairs(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs from single conversations: up to the last reply (chosen) against the same with that reply stale.

    Chosen ends with the last assistant turn; rejected has the first assistant turn's text in its place, or
    ends before it if the two are one turn. Conversations without an assistant turn give no pair.
    """
    at = F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i))
    with_at = turns.withColumn("at", F.filter(at, lambda i: i.isNotNull())).filter(F.size("at") > 0).withColumn("last", F.element_at("at", -1)).withColumn("first", F.element_at("at", 1))
    kept = F.slice("turns", 1, F.col("last"))
    stale = F.struct(F.lit("assistant").alias("role"), F.get("turns", F.col("first"))["text"].alias("text"))
    rejected = F.when(F.col("first") == F.col("last"), kept).otherwise(F.concat(kept, F.array(stale)))
    return with_at.select(id_col, F.slice("turns", 1, F.col("last") + 1).alias("chosen"), rejected.alias("rejected"))
