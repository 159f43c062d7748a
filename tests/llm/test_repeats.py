import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import repeats
from tidelog.llm.queries import op5_suffix_array_dedup
from tidelog.llm.repeats import bands, merged_ranges, remove_repeats, shard_row
from tidelog.llm.shared import table


def brute(texts, width=100):
    """texts in order of their ids -> (n_bytes, n_removed, n_spans, kept)."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(raw) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[:-1]]) if raw else b""
        out.append((len(raw), int(gone.sum()), spans, kept))
    return out


def check(spark, texts, partitions=4):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, k long").repartition(partitions)
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, (n, removed, spans, kept) in enumerate(want):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (n, removed, spans, kept), i
        assert sum(b - a for a, b in r.spans) == removed and r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def corpus(rng):
    words = [f"{rng.choice('abcdefghij')}{rng.randrange(400)}" for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(60) for _ in range(5)]
    base = text(300)
    texts = [None, "", "x", "short " * 5, "in " * 400, "in " * 700, "é" * 60, "é" * 2_000, "ab" * 49 + "x", "ab" * 51, base, base, base[37:900], base[:500] + "!" + base[501:]]
    for _ in range(60):
        texts.append(text(rng.randrange(1, 80)) + rng.choice(passages) + text(rng.randrange(1, 80)) + rng.choice(["", rng.choice(passages)[rng.randrange(200) :]]))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, corpus(random.Random(seed)))


@pytest.mark.parametrize(("crowded", "very", "band"), [(3, 1000, 16), (3, 10, 8), (2, 2, 16), (1, 1000, 5)])
def test_crowded_hashes_and_small_collections(spark, monkeypatch, crowded, very, band):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    monkeypatch.setattr(repeats, "VERY_CROWDED", very)
    monkeypatch.setattr(repeats, "BAND", band)
    monkeypatch.setattr(repeats, "COLLECTION", 2_000)
    monkeypatch.setattr(repeats, "SHARD", 700)
    check(spark, corpus(random.Random(3)))


def test_windows_exactly_as_long_as_the_bound(spark):
    w = "".join(chr(97 + i % 26) + chr(97 + i // 26) for i in range(60))
    check(spark, ["1" + w[:100] + "2", "3" + w[:100] + "4", "5" + w[:99] + "6", w[1:101]])


def test_merged_intervals_keep_the_earliest():
    rng = random.Random(4)
    strings = list({"".join(rng.choice("ab") for _ in range(rng.randrange(12, 40))).encode() for _ in range(40)})
    k, s = np.array([rng.randrange(5) for _ in strings]), np.arange(len(strings)) * 1000
    gone = {i: set() for i in range(len(strings))}
    number = np.arange(len(strings))
    others = (number % 9 == 0).astype(np.int64)
    shards = [shard_row([strings[i] for i in part], k[part], s[part], others[part], np.full(others[part].sum(), 9), 90_000 + part[others[part] > 0] * 100) for part in np.array_split(number, 4)]
    for key, a, b in merged_ranges(shards, 12).tolist():
        if key == 9:  # later places of strings with several
            assert a % 900 == 0 and b - a == len(strings[(a - 90_000) // 100])
            continue
        i = a // 1000
        assert k[i] == key
        gone[i].update(range(a - s[i], b - s[i]))
    seen = set()
    for i in sorted(range(len(strings)), key=lambda i: (k[i], s[i])):
        want = set()
        for p in range(len(strings[i]) - 11):
            w = strings[i][p : p + 12]
            if w in seen:
                want.update(range(p, p + 12))
            seen.add(w)
        assert gone[i] == want


def test_equal_windows_are_in_bands_of_one_key():
    rng = random.Random(8)
    for band in (1, 5, 16):
        for _ in range(60):
            alphabet = rng.choice(["ab", "abcdefgh", "a"])
            text = "".join(rng.choice(alphabet) for _ in range(400)).encode()
            keys = {}
            for s in range(0, 250, rng.randrange(1, 40)):
                run = text[s : s + 130 + rng.randrange(20)]
                if not (repeats.sliding(np.minimum, repeats.gram_hashes(np.frombuffer(run, np.uint8)), 69) == repeats.gram_hashes(np.frombuffer(run, np.uint8)).min()).all():
                    continue  # not a run
                covered = []
                for a, b, key in bands(run, 100, band):
                    assert b - a <= 99 + band
                    for w in range(a, b - 99):
                        covered.append(w)
                        keys.setdefault(run[w : w + 100], set()).add(key)
                assert covered == list(range(len(run) - 99))
            assert all(len(v) == 1 for v in keys.values())


def test_a_line_in_very_many_contexts_stays_in_bounds(spark, monkeypatch):
    """96 bytes between different words: no collection grows with the number of texts, and no byte is lost or kept wrongly."""
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(96))
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [word(rng.randrange(1, 30)) + line + word(rng.randrange(1, 30)) for _ in range(2_000)]
    monkeypatch.setattr(repeats, "CROWDED", 100)
    monkeypatch.setattr(repeats, "VERY_CROWDED", 400)
    keyed = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    scanned = repeats._scanned(keyed, 100, 8, 1 << 16).cache()
    shards = repeats._shards(repeats._strings(scanned, 100, 8), 100).filter("collection >= 0").collect()
    sizes = {}
    for r in shards:
        sizes[r.collection] = sizes.get(r.collection, 0) + len(repeats.unpack(bytes(r.payload))[0])
    assert max(sizes.values(), default=0) <= repeats.COLLECTION + 400 * (100 + repeats.BAND)
    check(spark, texts)


@pytest.mark.parametrize("chunk", [1 << 14, 8 << 20])
def test_what_goes_does_so_by_intervals(spark, chunk):
    """Of the documents next to nothing goes within chunks: all the rest by repeated intervals of merged transforms."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    keyed = docs.select(docs.doc_id.alias("k"), "text").repartition(2)
    scanned = repeats._scanned(keyed, 100, 8, chunk).cache()
    strings = repeats._strings(scanned, 100, 8).cache()

    def covered(rows):
        gone = {}
        for k, a, b in rows:
            gone.setdefault(k, set()).update(range(a, b))
        return sum(len(v) for v in gone.values())

    local = covered(x for r in strings.filter("part = -1").collect() for x in np.stack(repeats.unpack(bytes(r.payload)), 1).tolist())
    every = covered((r.k, r.a, r.b) for r in repeats._merged(repeats._shards(strings, 100), 100).collect())
    assert every == sum(x[1] for x in brute([r.text for r in docs.orderBy("doc_id").collect()])) and local < 0.02 * every


def test_strings_with_very_many_places(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PLACES", 3)
    rng = random.Random(12)
    texts = corpus(rng)
    check(spark, texts + texts[10:30] * 5, 2)


def test_a_very_long_text_among_others(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4_000)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    check(spark, ["x" * 5_000, long[1_000:1_400], long, long[200_000:260_000] + "!", long[:150]])


def test_null_and_repeated_ids(spark):
    t = " ".join(str(i) for i in range(80))
    docs = spark.createDataFrame([(2, t), (1, "z" + t), (1, "a" + t), (None, t), (2, t)], "doc_id long, text string")
    got = sorted(((r.doc_id is None, r.doc_id or 0, -r.n_removed) for r in remove_repeats(docs).collect()))
    n = len(t)
    assert got == [(False, 1, -n), (False, 1, 0), (False, 2, -n), (False, 2, -n), (True, 0, -n)]
    assert remove_repeats(docs.limit(0)).collect() == []
    many = docs.unionByName(spark.range(2_500).selectExpr("cast(null as long) doc_id", "'short' text"))
    rows = remove_repeats(many).collect()
    assert len(rows) == 2_505 and all((r.n_removed, r.n_spans, bytes(r.kept)) == (0, 0, b"short") for r in rows if r.n_bytes == 5)
    again = spark.createDataFrame([(None, t)] * 1_200, "doc_id long, text string")
    assert sorted((r.n_removed, r.n_spans, r.spans, bytes(r.kept)) for r in remove_repeats(again).collect())[1:] == [(n, 1, [[0, n]], b"")] * 1_199


@pytest.mark.parametrize("rows", [[], [(None, None, "x")], [(1, "", "x"), (1, None, "y"), (2, "é" * 200, "x"), (2, "é" * 200, "x")]])
def test_query_on_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, k string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op5_suffix_array_dedup(spark, str(tmp_path)).collect()
    assert sorted(r.n_removed for r in got) == sorted([0] * len(rows) if len(rows) < 4 else [0, 0, 398, 400])


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, d, "documents").collect()}
    ids = sorted(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_suffix_array_dedup(spark, d).collect()}
    for i, (n, removed, spans, kept) in zip(ids, brute([texts[i] for i in ids]), strict=True):
        assert got[i] == (n, removed, spans, hashlib.sha256(kept).hexdigest())
