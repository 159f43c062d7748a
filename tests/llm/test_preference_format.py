from collections import Counter

import duckdb
import pytest

from tidelog.llm.oracle import OP1
from tidelog.llm.preference_format import conversation_turns, format_preferences, stale_reply_pairs
from tidelog.llm.queries import op1_preference_format

T = "array<struct<role:string,text:string>>"


def test_prefix_prompt_and_masks(spark):
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", "no 🙂")
    cases = {
        1: ([u, a], [u, b]),
        2: ([u, a, u, b], [u, a, u, a]),
        3: ([u, a], [u]),
        4: ([u], [u]),
        5: (None, [a]),
        6: ([], None),
        7: ([(None, None), a], [(None, None), b]),
        8: ([a] * 400 + [b], [a] * 401),
    }
    pairs = spark.createDataFrame([(k, c, r, "x") for k, (c, r) in cases.items()], f"pair_id long, chosen {T}, rejected {T}, prompt string")
    got = {r.pair_id: r for r in format_preferences(pairs).collect()}
    show = lambda ts: "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in ts)
    for k, (c, r) in cases.items():
        c, r = c or [], r or []
        n = next((i for i, (x, y) in enumerate(zip(c, r)) if x != y), min(len(c), len(r)))
        g = got[k]
        assert (g.n_prompt_turns, g.prompt, g.chosen, g.rejected) == (n, show(c[:n]), show(c[n:]), show(r[n:]))
        for turns, text, mask in ((c[n:], g.chosen, g.chosen_mask), (r[n:], g.rejected, g.rejected_mask)):
            assert [text[m.start : m.end] for m in mask] == [f"{t}<|im_end|>" for role, t in turns if role == "assistant"]
        assert g.usable == (show(c[n:]) != show(r[n:]) and any(x[0] == "assistant" for x in c[n:]) and any(x[0] == "assistant" for x in r[n:]))
    assert format_preferences(pairs.limit(0)).collect() == []


def test_turns_and_pairs(spark):
    rows = [(1, 1, "assistant", "A"), (1, 0, "user", "Q"), (1, 2, "user", "R"), (1, 3, "assistant", "B"), (1, 4, "user", "S"), (2, 0, "user", "Q"), (3, 0, "assistant", None), (None, 0, "assistant", "n")]
    turns = conversation_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: ([t.text for t in r.chosen], [t.text for t in r.rejected]) for r in stale_reply_pairs(turns).collect()}
    assert got == {1: (["Q", "A", "R", "B"], ["Q", "A", "R", "A"]), 3: ([None], []), None: (["n"], [])}


A = "assistant"
ODD = [(1, 0, "user", "q", "x"), (1, 1, A, None, "x"), (1, 1, A, "b", "x"), (1, None, "user", "first", "x"), (None, 0, A, "n", None), (None, 0, A, "n", None), (None, None, None, None, None), (2, 0, None, None, "x"), (3, 0, A, "a" * 300_000, "x"), (3, 0, A, "a" * 300_000, "x"), (4, 0, "user", "", "x"), (4, 1, A, "", "x"), (4, 2, A, "", "x")]


@pytest.mark.parametrize("rows", [[], ODD, [(None, None, None, None, None)], [(9, i, A if i % 2 else "user", f"t{i}", "x") for i in range(3_000)]])
def test_query_on_odd_tables(spark, tmp_path, rows):
    """Nulls, ties, repeated rows, very long turns and conversations, extra columns, empty tables; against the SQL."""
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(OP1)
    names = [c[0] for c in want.description]
    assert Counter(tuple(r[c] for c in names) for r in op1_preference_format(spark, str(tmp_path)).collect()) == Counter(want.fetchall())
