import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tidelog.llm import toxicity
from tidelog.llm.queries import op7_toxicity
from tidelog.llm.shared import table
from tidelog.llm.toxicity import DECAY, REACH, WIDTH, fit, kernel_rows, landmark_table, prepared, score, sentence_around, worst_windows

NORM2 = sum(DECAY ** (2 * (c[-1] + 1)) for n, span in ((3, 6), (4, 7)) for c in combinations(range(span), n) if c[0] == 0)


def naive(text, begin, places):
    """Subsequences that begin at some places of a text, with the weights of their occurrences."""
    out = {}
    for p in range(begin, min(begin + places, len(text))):
        for n, span in ((3, 6), (4, 7)):
            for at in combinations(range(1, span), n - 1):
                if p + at[-1] < len(text):
                    out.setdefault("".join(text[p + i] for i in (0, *at)), []).append(DECAY ** (at[-1] + 1))
    return out


def kernel(window, landmark):
    """Explicit: a window of a text (its norm is that of a full one) with a whole landmark."""
    a, b = naive(*window, WIDTH), naive(landmark, 0, len(landmark))
    norm = np.sqrt(sum(v * v for vs in b.values() for v in vs))
    return sum(sum(a[k]) * sum(b[k]) for k in a if k in b) / (np.sqrt(WIDTH * NORM2) * norm)


def test_kernel_is_the_sum_over_common_subsequences():
    windows, marks = [" idiot ", " id.i-ot now", "banana", "ab", "überall"], [" you idiot ", "anana"]
    got = kernel_rows(windows, landmark_table(marks))
    want = np.array([[kernel((w[: WIDTH + REACH], 0), m) for m in marks] for w in windows])
    assert np.abs(got - want).max() < 0.02  # hashed subsequences may meet


def bucket(key):
    """Where a subsequence is counted, character by character."""
    x = [(ord(ch) * 0x9E3779B1 ^ ord(ch) << 7) % 2**32 for ch in key]
    h = (x[0] * 0x85EBCA77 + x[1]) * 0xC2B2AE3D % 2**32
    h = (h + x[2]) * 0x27D4EB2F % 2**32
    h ^= h >> 15
    if len(x) == 4:
        h = (h + x[3]) * 0x165667B1 % 2**32
    return h >> 32 - toxicity.BITS


def brute_scores(model, texts):
    """Of every window of every text the explicit kernel sums with all landmarks, over counted subsequences; the worst
    one, through the logistic map."""
    weights, out = {}, []
    for mark, beta in zip(model.landmarks, model.beta):
        own = naive(mark, 0, len(mark))
        norm = np.sqrt(sum(v * v for vs in own.values() for v in vs)) * np.sqrt(WIDTH * NORM2)
        for key, vs in own.items():
            weights[bucket(key)] = weights.get(bucket(key), 0) + beta * sum(vs) / norm
    for t in map(prepared, texts):
        worst = max((sum(sum(vs) * weights.get(bucket(key), 0) for key, vs in naive(t, p, WIDTH).items()) for p in range(len(t))), default=-1e3)
        out.append(1 / (1 + np.exp(-np.clip(model.slope * max(worst, -1e3) + model.offset, -40, 40))))
    return np.array(out)


def small_corpus(rng, n=160):
    bad = ["worthless", "pathetic", "disgusting"]
    plain = lambda: ["".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(12)]
    rows = []
    for i in range(n):
        w = plain()
        if i % 2:
            w.insert(int(rng.integers(len(w))), bad[i // 2 % 3])
        rows.append((i, " ".join(w) + ".", i % 2))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = small_corpus(np.random.default_rng(0), 300)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    return docs, fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), n_landmarks=200)


def test_whole_texts_against_explicit_kernel_sums(spark, trained):
    docs, model = trained
    texts = {r.doc_id: r.text for r in docs.limit(12).collect()} | {1000: None, 1001: "", 1002: " \n ", 1003: "ab", 1004: "so w-orth-less"}
    rows = spark.createDataFrame([(i, t, 0.5) for i, t in texts.items()], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in score(rows, model).collect()}
    want = dict(zip(texts, brute_scores(model, list(texts.values()))))
    assert max(abs(got[i] - want[i]) for i in texts) < 1e-3 and min(got.values()) == got[1000] == got[1001] == got[1002]


def test_gapped_and_inserted_characters_in_sentences(trained):
    """Insults that the training texts don't have in this form, within sentences that they don't have."""
    _, model = trained
    rng = np.random.default_rng(5)
    plain = lambda n=8: " ".join("".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(n))
    forms = ["path.etic", "w-orth-less", "d i s g u s t i n g", "disgustinng", "xx_disgusting_yy", "disg_usting", "worth less", "pa-thetic", "w o r t h l e s s", "PATHETIC!!"]
    toxic = [f"{plain()} {form} {plain()}" for form in forms for _ in range(4)] + ["x" * 500 + " worthless"]
    assert np.mean(model.scores(toxic) >= 0.5) > 0.9
    clean = [None, "", " ", "tonal sonnet"] + [plain(20) for _ in range(40)]
    assert np.mean(model.scores(clean) < 0.5) > 0.95
    assert "disgusting" in prepared("D i s g u s t i n g !")


def test_long_texts_are_scored_whole(trained, monkeypatch):
    """In whatever pieces: the worst window is found at a piece's edge as elsewhere."""
    _, model = trained
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("aeioulnrst"), 6)) for _ in range(30_000))
    texts = [text[:at] + " worthless " + text[at:] for at in (0, 65_530, 65_536, 131_000, len(text))] + [text]
    whole, where = worst_windows(texts, model.table, 1 << 30)
    for size in (1_000, 1 << 16):
        pieces, where2 = worst_windows(texts, model.table, size)
        assert np.allclose(whole, pieces, atol=1e-4) and (np.abs(where - where2) <= 16).all()
    assert (whole[:5] > whole[5] - 1e-4).all()


def test_sentences_around_windows():
    text = " one two. three four! five six "
    assert sentence_around(text, 12) == "three four! " and sentence_around(text, 1) == " one two. "
    long = "x" * 500
    assert len(sentence_around(long, 300)) == toxicity.SENTENCE


def test_repeated_ids_and_odd_rows(spark, trained):
    _, model = trained
    rows = [(1, "so worthless here"), (1, "so worthless here"), (1, None), (None, "ab"), (None, "ab"), (2, "x" * 300_000)]
    got = Counter((r.doc_id, round(r.score, 9), r.predicted) for r in score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect())
    assert sum(got.values()) == len(rows) and sorted(got.values()) == [1, 1, 2, 2]
    labels = [(1, 1), (1, 0), (1, None), (3, 0), (4, 0), (None, 1)]
    docs = [(1, "so worthless"), (1, "another text"), (1, None), (3, "tonal tonal"), (4, None), (9, "z")]
    model = fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), n_landmarks=4)
    assert np.isfinite(model.scores(["a", None])).all()


@pytest.mark.parametrize("rows", [[], [(None, None)], [(3, "a"), (3, None), (3, "a")]])
def test_query_on_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1), (None, 0), (8, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = op7_toxicity(spark, str(tmp_path)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows) and all(0 <= r.score <= 1 for r in got)


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (None, "b", "z")], "doc_id long, text string, score string")
    for rows in ([], [(1, 1)], [(None, 1), (7, None)]):
        model = fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        got = score(docs, model).collect()
        assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2] and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op7_toxicity(spark, d).collect()}
    assert len(got) == table(spark, d, "documents").count()
    held = [(r.toxic, got[r.doc_id].predicted) for r in table(spark, d, "labels").collect() if r.toxic is not None and got[r.doc_id].held_out]
    assert sum(y == p for y, p in held) / len(held) > 0.9
    assert sum(p for y, p in held if y) / sum(y for y, _ in held) > 0.7
