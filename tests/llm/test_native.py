"""Exact dedup, quality rules and mixing: odd rows, and brute force on whole tables."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import exact_dedup as dedup
from tidelog.llm import mixing
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.mixing import mix
from tidelog.llm.quality_rules import POLICIES, RULES, ablations, apply_policies, keep_good, ledger, mask
from tidelog.llm.shared import table, word_count

LONG = "Straße ÄB " * 20_000
TEXTS = [(1, "Hello"), (2, "hELLO"), (3, "HÉLLO"), (4, "hÉllo"), (5, "héllo"), (6, None), (7, ""), (8, " "), (9, LONG), (10, LONG), (None, "hello"), (None, "x"), (11, "x"), (12, "y"), (12, "y")]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def check_dedup(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "d") for i, t in texts], "doc_id long, text string, keep_id int, digest string").repartition(3)
    groups = {}
    for i, t in texts:
        groups.setdefault(lower(t), []).append(i)
    want = Counter()
    for i, t in texts:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[i, keep, len(g), i == keep] += 1
    rows = exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == want
    return rows


def test_dedup_odd_rows(spark):
    rows = check_dedup(spark, TEXTS)
    assert {r.text_sha256 for r in rows} == {hashlib.sha256(lower(t).encode()).hexdigest() for _, t in TEXTS}
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_dedup_tells_texts_of_one_digest_apart(spark, monkeypatch):
    monkeypatch.setattr(dedup, "digest", lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 1)))
    check_dedup(spark, TEXTS + [(100 + i, f"text {i % 7}") for i in range(40)])


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_rules_odd_rows(spark):
    texts = [None, "", " \n\t", "one", "a b c", "a b c a b c", "a b c a b c a b", "x " * 30_000, "l1\nl1\n\nl2\r\nl1\n \n", "#*$%&|<> É é", "a\x0bb\x0cc\rd\x1ce", LONG, "w" * 100_000]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in ledger(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == measures(t), i
    assert got[0].fail_bits == mask(("few_words", "no_words"))
    assert ledger(docs.limit(0)).collect() == [] and keep_good(docs.limit(0)).columns == docs.columns


def test_rules_against_brute_force_and_ablations(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = apply_policies(ledger(docs)).cache()
    got = rows.collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == measures(texts[r.doc_id])
        assert r.kept_base == (not (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words))
    at = {r.name: k for k, r in enumerate(RULES)}
    full = mask(POLICIES["v1"])
    for r in ablations(rows, "v1").collect():
        bit = 1 << at[r.rule]
        assert r.failed == sum(bool(x.fail_bits & bit) for x in got)
        assert r.rejected_alone == sum(x.fail_bits & full == bit for x in got)
        assert r.kept_without == sum(not x.fail_bits & full & ~bit for x in got)
    assert {r.doc_id for r in keep_good(docs).collect()} == {r.doc_id for r in got if r.kept_v1}


def fair(sources):
    """Targets by repeated resharing: sources is name -> size, in order of the names."""
    weights = dict(zip(sources, [3, 1, 2] * len(sources)))
    target, open_, left = {}, set(sources), 1.5 * sum(sources.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= 2 * sources[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: 2.0 * sources[s] for s in over}
        left -= sum(2 * sources[s] for s in over)
        open_ -= over
    return target


def check_mix(rows, texts):
    sizes = Counter()
    for _, t, s in texts:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = fair({s: sizes[s] for s in names})
    of = {i: s for i, _, s in texts}
    assert len(rows) == len(texts)
    taken, largest = Counter(), Counter()
    for r in rows:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert sum(taken.values()) == 3 * sum(sizes.values()) // 2
    for s in names:
        assert abs(taken[s] - want[s]) <= max(largest.values()) + 1


def test_mix_odd_rows(spark):
    texts = [(i, "w " * (i % 13), ["a", "ä", "Z", None, ""][i % 5]) for i in range(200)] + [(500, None, "a"), (501, "x " * 900, "big"), (502, "", "empty")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in texts], "doc_id long, text string, source string, size int")
    one = mix(docs).orderBy("doc_id").collect()
    check_mix(one, texts)
    assert one == mix(docs.repartition(7)).orderBy("doc_id").collect()
    assert mix(docs.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (1, "a", "s"), (None, "a b c", "s")], "doc_id long, text string, source string")
    rows = mix(same).collect()
    assert len(rows) == 4 and sum(r.taken for r in rows) == 12 and all(r.taken <= 2 * r.size for r in rows)
    nothing = mix(spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in nothing) == [(1, 0, 0), (2, 0, 0)]


@pytest.mark.parametrize("times", [1 << 16, 1 << 20])
def test_mix_of_a_billion_words(spark, monkeypatch, times):
    """All sizes times a power of two: targets and what is taken are so many times as large, below and above 2^31 words."""
    texts = [(i, "w " * (i % 301), ["a", "ä", "Z", None, ""][i % 5]) for i in range(200)] + [(501, "x " * 900, "big")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    plain = sorted(tuple(r) for r in mix(docs).collect())
    monkeypatch.setattr(mixing, "word_count", lambda text: word_count(text) * times)
    rows = sorted(tuple(r) for r in mix(docs).collect())
    assert 1 << 30 < sum(size for _, size, *_ in rows) < 1 << 36
    assert rows == [(i, *(x * times for x in rest)) for i, *rest in plain]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_mix_whole_table(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    check_mix(mix(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])
