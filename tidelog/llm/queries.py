"""The operators of this subpackage applied to whole tables: one query each, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.bpe import encode_decode_digests
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.jaccard_join import jaccard_components
from tidelog.llm.mixing import mix
from tidelog.llm.preference_format import conversation_turns, format_preferences, stale_reply_pairs
from tidelog.llm.quality_rules import ledger, verdict
from tidelog.llm.repeats import remove_repeats
from tidelog.llm.shared import table, tokenizer_path, word_count
from tidelog.llm.token_counts import TokenRollup
from tidelog.llm.toxicity import fit, score
from tidelog.llm.warc import read_records, write_bundles
from tidelog.session import materialize, work_path


def _spans(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with a reply, against itself with its last reply stale."""
    pairs = stale_reply_pairs(conversation_turns(table(spark, sf_dir, "conversations")))
    rows = format_preferences(pairs, "conv_id")
    return rows.select("conv_id", "n_prompt_turns", "prompt", "chosen", "rejected", _spans("chosen_mask").alias("chosen_mask"), _spans("rejected_mask").alias("rejected_mask"), "usable")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its text's group, by texts in lower-cased A-Z."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then read every record back from the archives."""
    rows = read_records(write_bundles(table(spark, sf_dir, "pages")), with_payload=False)
    return rows.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, with the verdicts of policies base and v1; n_lines and fail_bits follow."""
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~verdict(F.col("fail_bits"), "base")).alias("base_failed"), verdict(F.col("fail_bits"), "v1").alias("kept"), "n_lines", "fail_bits")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a string of 100 bytes covers which starts earlier."""
    rows = remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over all documents, one of them committed twice.

    Words and letter runs are inserted; then documents of fewer than 50 words are withdrawn from both counts,
    and the letter runs of the rest are revised to runs of letters or digits.
    """
    docs = table(spark, sf_dir, "documents")
    runs = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long")
    counts = materialize(docs.select("source", "lang", word_count(F.col("text")).alias("words"), runs(r"\p{L}+").alias("letters"), runs(r"[\p{L}\p{N}]+").alias("alnum")), "token-counts")
    change = lambda df, op, tokenizer, tokens, old: df.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(tokens).alias("tokens"), F.col(old).alias("old_tokens"))
    short, rest = counts.filter("words < 50"), counts.filter("words >= 50")
    rollup = TokenRollup(spark, work_path(spark, "rollup"))
    rollup.commit("words", change(counts, "insert", "words-1", "words", "words"))
    rollup.commit("letters", change(counts, "insert", "runs-1", "letters", "letters"))
    rollup.commit("short", change(short, "delete", "words-1", "words", "words").unionByName(change(short, "delete", "runs-1", "letters", "letters")))
    rollup.commit("digits", change(rest, "revise", "runs-1", "alnum", "letters"))
    rollup.commit("letters", change(counts, "insert", "runs-1", "letters", "letters"))
    return rollup.totals()


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a machine that learns from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix of sources takes of it, for 150% of all words."""
    return mix(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 5-word shingles and its component, at a similarity of 0.75."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests of its ids and of the text that comes back."""
    return encode_decode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference_format": op1_preference_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc": op3_warc,
    "op4_quality_rules": op4_quality_rules,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_bpe": op10_bpe,
}
