from collections import Counter

import pytest

from tidelog.llm.queries import op6_token_counts
from tidelog.llm.token_counts import TokenRollup

CHANGES = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long, documents long"


def rows(rollup):
    return sorted(((r.source, r.lang, r.tokenizer, r.documents, r.tokens) for r in rollup.totals().collect()), key=repr)


def names(rollup):
    return sorted(r.batch for r in rollup.batches().collect())


def test_batches_are_idempotent_and_signed(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame([(*x, None) for x in r], CHANGES)
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    assert rows(rollup) == [] and names(rollup) == []
    first = frame(("insert", "a", "en", "t1", 5, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, None, "t1", None, None), ("insert", "b", "de", "t2", 7, None))
    assert rollup.commit("b1", first)
    assert not rollup.commit("b1", first)
    want = [("a", "en", "t1", 2, 10), ("b", "de", "t2", 1, 7), (None, None, "t1", 1, 0)]
    assert rows(rollup) == sorted(want, key=repr)
    assert rollup.commit("b2", frame(("delete", "b", "de", "t2", 7, None), ("revise", "a", "en", "t1", 9, 5)))
    want = sorted([("a", "en", "t1", 2, 14), (None, None, "t1", 1, 0)], key=repr)
    assert rows(rollup) == want
    rollup.compact()
    assert rows(rollup) == want and names(rollup) == ["b1", "b2"]
    assert not rollup.commit("b1", first) and names(TokenRollup(spark, f"file://{tmp_path}/r")) == ["b1", "b2"]
    with pytest.raises(ValueError, match="other content"):
        rollup.commit("b2", first)
    assert rollup.commit("b3", spark.createDataFrame([], CHANGES)) and rows(rollup) == want


def test_other_content_under_a_used_id_is_an_error(spark, tmp_path):
    frame = lambda *r: spark.createDataFrame([(*x, None) for x in r], CHANGES)
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    one, two = ("insert", "a", "en", "t", 5, None), ("insert", "b", "en", "t", 6, None)
    assert rollup.commit("7", frame(one, two)) and not rollup.commit("7", frame(two, one))
    assert rollup.commit("none", frame()) and not rollup.commit("none", frame())
    for _ in range(2):
        for wrong in (frame(one), frame(two, two), frame()):
            with pytest.raises(ValueError):
                rollup.commit("7", wrong)
        with pytest.raises(ValueError):
            rollup.commit("none", frame(one))
        rollup.compact()
    assert rows(rollup) == [("a", "en", "t", 1, 5), ("b", "en", "t", 1, 6)] and names(rollup) == ["7", "none"]


def test_a_compaction_that_dies_counts_once(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    rollup.commit("x", spark.createDataFrame([("insert", "a", "en", "t", 5, None, 1)], CHANGES))
    rollup._fs, kept = _NoDelete(rollup._fs), rollup._fs
    rollup.compact()
    rollup._fs = kept
    assert rollup._names("batches") == ["batch=x"] and rows(rollup) == [("a", "en", "t", 1, 5)] and names(rollup) == ["x"]
    rollup.compact()
    assert rows(rollup) == [("a", "en", "t", 1, 5)] and names(rollup) == ["x"]


class _NoDelete:
    def __init__(self, fs):
        self._fs = fs

    def delete(self, *_): ...

    def __getattr__(self, name):
        return getattr(self._fs, name)


@pytest.mark.parametrize("texts", [[], [(None, None, None, None)], [(1, "a " * 60, "s", "en"), (1, "a " * 60, "s", "en"), (None, "É1 b", None, "en"), (2, None, "s", None), (3, "", "s", "en"), (4, "w1 " * 50_000, "s", "en")]])
def test_query_on_odd_tables(spark, tmp_path, texts):
    spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, source string, lang string, tokens long").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for _, t, source, lang in texts:
        n = len((t or "").split())
        if n >= 50:
            want.update({(source, lang, "words-1", "documents"): 1, (source, lang, "words-1", "tokens"): n, (source, lang, "runs-1", "documents"): 1, (source, lang, "runs-1", "tokens"): n})
    got = {(r.source, r.lang, r.tokenizer, c): r[c] for r in op6_token_counts(spark, str(tmp_path)).collect() for c in ("documents", "tokens")}
    assert got == dict(want)


def test_a_crashed_commit_does_not_count(spark, tmp_path):
    rollup = TokenRollup(spark, f"file://{tmp_path}/r")
    change = spark.createDataFrame([("insert", "a", "en", "t", 5, None, 1)], CHANGES)
    rollup.commit("x", change)
    (tmp_path / "r/batches/batch=x/_SUCCESS").unlink()  # as if the writer had died
    assert rows(rollup) == []
    assert rollup.commit("x", change) and rows(rollup) == [("a", "en", "t", 1, 5)]
