import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm.bpe import decode, encode, encode_decode_digests, read_tokenizer
from tidelog.llm.queries import op10_bpe
from tidelog.llm.shared import table, tokenizer_path

TEXTS = [None, "", " \n ", "Hello  WORLD, it's <|endoftext|>über<|startoftext|> naïve\x1cx 🙂 é\u00a0y", "e\u0301 don't we'll", "x" * 30_000, "a b a b " * 5_000, "Hello  WORLD, it's"]


def brute(text):
    t = Tokenizer.from_file(tokenizer_path())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_whole_texts_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y")], "doc_id long, text string, chunk string").repartition(3)
    encoded = encode(docs, tokenizer_path(), chunk_bytes=1_000, n_parts=5)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: r.text for r in decode(encoded, tokenizer_path()).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        assert (got[i], back[i]) == brute(t)


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        read_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    spec = json.loads(read_tokenizer(tokenizer_path()))
    for change in ({"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}, {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}, {"pre_tokenizer": None}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            read_tokenizer(str(tmp_path / "t.json"))


def digests(text):
    ids, back = brute(text)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query_on_odd_tables(spark, tmp_path):
    """Nulls, repeated ids and rows, a very long text, extra columns; each row on its own, in whatever order they come."""
    rows = [(i % 4, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (None, None, None), (1, "again", "x"), (1, "again", "x"), (7, "Wörter über Wörter " * 60_000, "z")]
    for k, part in enumerate((rows, rows[:0], [(None, None, None)])):
        d = tmp_path / str(k)
        spark.createDataFrame(part, "doc_id long, text string, ids string").write.parquet(str(d / "documents.parquet"))
        want = Counter((i, *digests(t)) for i, t, _ in part)
        assert Counter(tuple(r) for r in op10_bpe(spark, str(d)).collect()) == want
        shuffled = spark.read.parquet(str(d / "documents.parquet")).orderBy(F.rand())  # another order at each read
        assert Counter(tuple(r) for r in encode_decode_digests(shuffled, tokenizer_path(), chunk_bytes=2_000).collect()) == want


def test_odd_ids(spark):
    rows = spark.createDataFrame([(1, [320, None, 10**6, -1, 320]), (1, []), (2, None)], "doc_id long, ids array<int>")
    piece = brute_piece(320)
    assert Counter(tuple(r) for r in decode(rows, tokenizer_path()).collect()) == Counter([(1, f"{piece} {piece}"), (1, ""), (2, None)])


def brute_piece(i):
    return Tokenizer.from_file(tokenizer_path()).decode([i], skip_special_tokens=False)


def test_digests_match_the_library(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = encode_decode_digests(docs, tokenizer_path(), chunk_bytes=50_000).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids, text = brute(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.n_tokens) for r in encode_decode_digests(docs, tokenizer_path()).collect()] == [(d, 0) for d, _ in rows]
