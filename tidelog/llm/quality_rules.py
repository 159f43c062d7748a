"""Quality rules: a ledger of failure bits and measurements, and versioned policies over the bits.

Every rule is evaluated once per document into one bit of `fail_bits`; the measurements stay beside it.
A policy is a mask: it keeps a document if none of the masked bits is set, so a new policy, or an
ablation of an old one, is bitwise arithmetic over the ledger and never reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import WORD, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measures; true means that the document fails."""

    name: str
    fails: str


#: Bit k of fail_bits is rule k. Rules are only ever appended, so that old ledgers keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 16 * n_words)"),
    Rule("repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines"),
    Rule("no_words", "n_words = 0"),
)

#: Versioned policies: name -> names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "word_length", "repeated_lines", "no_words"),
}


def mask(rules: tuple[str, ...], known: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: k for k, r in enumerate(known)}
    return sum(1 << at[name] for name in set(rules))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_row: bool = False) -> DataFrame:
    """The measures of each document, from one pass over its words; whole_row adds all its columns as a struct `row`.

    n_repeat_words: words in 3-word windows that the text has twice or more. The windows' hashes are
    sorted with their positions, so equal windows stand side by side; the positions of those, sorted
    again, cover min(3, gap to the next) words each. Only texts with an equal pair pay for the sort.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct("*").alias("row")] if whole_row else []
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"), *row)
    row = ["row"] if whole_row else []
    base = base.select("id", "t", *row, words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    hashed = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    base = base.select(
        "id",
        *row,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.size("w") > 3, F.slice(hashed, 1, F.size("w") - 2)).otherwise(F.array().cast("array<long>")).alias("h"),
    )
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    sorted_ = base.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs)).drop("h")
    twice = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    at = sorted_.withColumn("p", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return at.select(F.col("id").alias(id_col), *row, *[F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words") if m == "n_repeat_words" else F.col(m) for m in MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, whole_row: bool = False) -> DataFrame:
    """id_col, the measures and fail_bits (long): every rule evaluated once.

    A null or empty text has all measures 0 and fails few_words and no_words. Rows are independent, so
    ties and repeated rows change nothing; ids may be null; other columns are ignored. Empty in, empty out. A very long
    text is one row of one task, which holds its words and, where windows repeat, a sorted array of them.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(rules)]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, id_col, text_col, whole_row).withColumn("fail_bits", total)


def keep_good(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their columns; nothing is shuffled.

    Rows leave by an explode of at most one row: a filter would be pushed below the measures, each spelled out
    wherever the next one names it.
    """
    kept = F.when(verdict(F.col("fail_bits"), policy), F.array("row"))
    return ledger(docs, id_col, text_col, whole_row=True).select(F.explode(kept).alias("row")).select("row.*")


def verdict(bits: Column, policy: str, policies: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    """True where the policy keeps the document."""
    return bits.bitwiseAND(F.lit(mask((policies or POLICIES)[policy], rules)).cast("long")) == 0


def apply_policies(ledgered: DataFrame, policies: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with a column kept_<policy> for each policy."""
    policies = policies or POLICIES
    return ledgered.withColumns({f"kept_{p}": verdict(F.col("fail_bits"), p, policies, rules) for p in policies})


def ablations(ledgered: DataFrame, policy: str, policies: dict[str, tuple[str, ...]] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: failed, rejected by it alone, and kept if the policy went without it.

    The ledger is first folded to its distinct bit patterns (at most 2^rules rows leave a task), and all
    ablations come from those counts.
    """
    names = (policies or POLICIES)[policy]
    full = mask(names, rules)
    counts = ledgered.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask((name,), rules)).cast("long").alias("bit")) for name in names])).alias("r")
    inside = F.col("fail_bits").bitwiseAND(F.lit(full).cast("long"))
    without = inside.bitwiseAND(F.bitwise_not(F.col("bit")))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return counts.select("fail_bits", "n", each).select("fail_bits", "n", "r.rule", "r.bit").groupBy("rule").agg(n(inside.bitwiseAND(F.col("bit")) != 0).alias("failed"), n(inside == F.col("bit")).alias("rejected_alone"), n(without == 0).alias("kept_without"))
