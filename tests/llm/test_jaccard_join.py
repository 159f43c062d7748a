import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidelog.llm import jaccard_join
from tidelog.llm.components import components
from tidelog.llm.jaccard_join import jaccard_components, signatures
from tidelog.llm.shared import table


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts):
    """texts: id -> text. Returns id -> (set size, component)."""
    return dict(zip(texts, brute_rows(list(texts.items())), strict=True))


def brute_rows(rows, percent=75):
    """rows: (id, text), where ids may repeat. Returns (set size, component) of each row, by all pairs with a common shingle."""
    sets = [shingle_set(t) if k is not None else set() for k, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    by_token = {}
    for k, s in enumerate(sets):
        for t in s:
            by_token.setdefault(t, []).append(k)
    for a, b in {p for ks in by_token.values() for p in combinations(ks, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = i if i is None else min(i, least.get(find(k), i))
    return [(len(shingle_set(t)), least[find(k)]) for k, (_, t) in enumerate(rows)]


def check(spark, texts, partitions=4):
    return dict(zip(texts, check_rows(spark, list(texts.items()), 75, partitions), strict=True))


def check_rows(spark, rows, percent, partitions=4):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, digest string, node int").repartition(partitions)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, threshold=percent / 100).collect())
    want = brute_rows(rows, percent)
    assert got == Counter((k, *w) for (k, _), w in zip(rows, want, strict=True))
    return want


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: " \n", 4: "One", 5: "one", 6: "one two", 7: "a b c d e f g", 8: "A b\tc d\x0be f g", 9: "É b c d e", 10: "é b c d e", 11: "x " * 30_000, 12: "x " * 20}
    got = check(spark, texts)
    assert got[5][1] == 4 and got[8][1] == 7 and got[10][1] == 10 and got[12][1] == 11 and got[2] == (0, 2)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (3, "p q r s t")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_components(odd).collect()), key=repr)
    assert got == sorted([(None, None), (1, 1), (2, 1), (2, 2), (3, 2)], key=repr)


def test_rows_that_share_an_id_keep_their_links(spark):
    a = [f"w{i}" for i in range(40)]
    b, c = ["x", "y", "z", *a[3:]], [*a[:37], "p", "q", "r"]  # both link with a, but not with each other
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, " ".join(c))]
    assert check_rows(spark, rows, 75) == [(36, 3)] * 3
    check_rows(spark, [(7, t) for _, t in rows] * 20 + [(None, " ".join(a)), (7, None)], 75)
    with pytest.raises(ValueError):
        jaccard_components(spark.createDataFrame([(1, "a")], "doc_id long, text string"), threshold=0)


@pytest.mark.parametrize("percent", [30, 50, 75, 90])
@pytest.mark.parametrize("rare", [2, 8])
def test_thresholds_and_repeated_ids(spark, monkeypatch, percent, rare):
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    rng = random.Random(percent + rare)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for n in (8, 64, 200):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(n)]
            rows += [edited(base[: rng.randrange(n // 4, n + 1)], rng, rng.randrange(0, 1 + n // 25)) for _ in range(12)]
            rows += [" ".join(base[rng.randrange(n // 2) :] + [rng.choice(vocabulary) for _ in range(rng.randrange(n))]) for _ in range(4)]
    check_rows(spark, [(rng.randrange(60), t) for t in rows + rows[:30]], percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_passages_and_chains(spark, seed):
    """Near copies in small and large groups, chains of edits, shared passages, documents made of passages only."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [text(60) for _ in range(6)]
    texts = [" ".join(text(rng.randrange(1, 300))) for _ in range(60)]
    for size in (2, 3, 30):
        for n in (12, 70, 400):
            base = text(n)
            texts += [edited(base, rng, rng.randrange(0, 1 + n // 60)) for _ in range(size)]
    chain = text(200)
    for _ in range(25):
        chain = edited(chain, rng, 4).split()
        texts.append(" ".join(chain))
    for _ in range(40):
        texts.append(" ".join(text(150) + rng.choice(passages) + text(100)))
        texts.append(" ".join(w for p in rng.sample(passages, 3) for w in p))
        texts.append(" ".join(w for p in rng.sample(passages, 5) for w in p + text(2)))
    texts += texts[:20] + [texts[0]] * 30
    rng.shuffle(texts)
    got = check(spark, dict(enumerate(texts)))
    assert len({c for _, c in got.values()}) < len(texts)


def test_all_frequent_tokens_go_by_combinations(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RARE", 2)
    rng = random.Random(5)
    bases = [[f"b{k}w{rng.randrange(60)}" for _ in range(90)] for k in range(4)]
    check(spark, dict(enumerate(edited(rng.choice(bases), rng, rng.randrange(4)) for _ in range(80))))


def test_prefixes_of_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for _ in range(600):
        n = int(rng.integers(3, 400))
        a = np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64))
        n = len(a)
        out = int(rng.integers(0, max(1, n // 7 + 1)))
        b = np.concatenate([rng.permutation(a)[out:], rng.integers(0, 1 << 48, int(rng.integers(0, max(1, n // 7))), dtype=np.uint64)])
        b = np.unique(b)
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < 75 * (n + len(b) - common):
            continue
        share = rng.random()
        frequent = lambda t: (t * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / (1 << 53) < share  # noqa: B023, E731
        assert np.intersect1d(signatures(a, frequent(a), 0.75), signatures(b, frequent(b), 0.75)).size


def test_linked_sets_of_any_sizes_share_a_signature_at_low_thresholds():
    rng = np.random.default_rng(4)
    for _ in range(200):
        small, large = int(rng.integers(3, 120)), int(rng.integers(100, 400))
        b = np.unique(rng.integers(0, 1 << 48, large, dtype=np.uint64))
        a = np.sort(rng.permutation(b)[:small])
        for t in (0.1, 0.3, 0.5):
            if len(a) >= t * len(b):
                all_ = lambda x: np.ones(len(x), bool)
                assert np.intersect1d(signatures(a, all_(a), t), signatures(b, all_(b), t)).size


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)] + [(None, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {k: k for e in edges for k in e if None not in e}
    for _ in label:
        for a, b in edges[:-1]:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_whole_table_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(spark, {r.doc_id: r.text for r in docs.collect()})
