import hashlib
import re
from collections import Counter

import corpus_pipeline
import duckdb
from tokenizers import Tokenizer

from tests.llm.test_jaccard_join import brute as near
from tidelog.llm.oracle import OP4, OP8
from tidelog.llm.shared import table, tokenizer_path


def plain(rows):
    """The pipeline without its operators: SQL for rules and mix, brute force for copies, the library for ids."""
    con = duckdb.connect()

    def put(rows):
        con.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)

    put(rows)
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP4}) WHERE kept").fetchall()}
    rows = [r for r in rows if r[0] in good]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    last = {}
    for r in sorted(rows):
        last[lower(r[1])] = r
    rows = sorted(last.values())
    groups = near({r[0]: r[1] for r in rows})
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    put(rows)
    times = {d: -(-taken // size) for d, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({OP8}) WHERE taken > 0").fetchall()}
    t = Tokenizer.from_file(tokenizer_path())
    out = Counter()
    for r in rows:
        ids = t.encode(r[1], add_special_tokens=False).ids
        if times.get(r[0]):
            out[r[0], hashlib.sha256(str(ids).encode()).hexdigest()] = times[r[0]]
    return out


def test_pipeline_against_plain_versions(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, d, "documents").collect()]
    got = Counter((r.doc_id, hashlib.sha256(str(r.ids).encode()).hexdigest()) for r in corpus_pipeline.run(spark, d).collect())
    assert got == plain(rows) and sum(got.values()) > 20


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, times long"
    long = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, long, "en", "a", 9, "r", 1), (2, long, "en", "a", 9, "r", 1), (3, long + " x", None, None, None, None, None), (None, "other " + long[::-1], "en", "b", 1, "r", 1), (4, None, "en", "a", 0, "r", 1), (5, "", "en", "a", 0, "r", 1)], schema)
    for rows, left in ((docs, {2, None}), (docs.limit(0), set())):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, "")
            assert rows.columns == docs.columns
        assert {r.doc_id for r in rows.collect()} == left
        assert {r.doc_id for r in corpus_pipeline.bpe(spark, rows, "").collect()} == left


def test_rows_that_share_an_id_have_their_own_fate(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, text_key long"
    long = lambda w, n=80: " ".join(f"{w}{i}" for i in range(n))
    texts = [(3, long("a")), (5, long("a") + " x"), (5, long("b")), (5, long("c")), (7, long("c") + " y"), (5, long("c") + " z"), (None, long("a")), (5, long("b"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "k", 1, 2) for i, t in texts], schema)
    left = corpus_pipeline.near_copies(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in left.collect())
    groups_c = [x for x in got if x[1].startswith("c")]
    assert len(groups_c) == 1 and groups_c[0][0] == "5"
    assert [x for x in got if not x[1].startswith("c")] == sorted([("3", long("a")), ("5", long("b")), ("5", long("b")), ("None", long("a"))])
    mixed = corpus_pipeline.mixing(spark, docs, "")
    assert mixed.columns == docs.columns and {(r.doc_id, r.text) for r in mixed.collect()} <= {(r.doc_id, r.text) for r in docs.collect()}
