import random
from collections import Counter

import numpy as np

from tidelog.llm.bwt import Shard, Transform, merge, repeated_intervals


def rotation(shard, start, length):
    """The bytes of a row, round and round its string."""
    f = shard.first[start]
    t = bytes(shard.text[f : f + np.flatnonzero(shard.text[f:] == 255)[0] + 1])
    o = start - f
    return ((t[o:] + t[:o]) * (length // len(t) + 1))[:length]


def test_merged_rows_are_in_order_with_their_common_prefixes():
    rng = random.Random(1)
    for _ in range(150):
        depth, step, k = rng.choice([4, 8, 12]), rng.choice([1, 2, 4]), rng.randrange(1, 5)
        strings = list({bytes(rng.choice(b"ab" if rng.random() < 0.7 else b"abc") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 40))})
        shards = [Shard(p) for p in (strings[i::k] for i in range(k)) if p]
        for s in shards:
            rows = [rotation(s, p, 90) for p in s.order]
            assert rows == sorted(rows) and sorted(s.order) == list(range(len(s.text)))
        turned = []
        for s in shards:
            last, names = s.transform()
            t = Transform(last)
            assert (s.first[s.order] == s.begins[names][t.string]).all() and (s.order - s.first[s.order] == t.offset).all()
            assert (t.lengths == (s.size - 1)[s.begins[names]]).all()
            turned.append(t)
        of, row, prefix = merge(turned, depth, step)
        start = [int(shards[i].order[r]) for i, r in zip(of, row)]
        rows = [rotation(shards[s], p, depth) for s, p in zip(of, start)]
        assert rows == sorted(rows) and len(rows) == sum(len(s.text) for s in shards)
        assert len(set(zip(of.tolist(), start))) == len(rows)
        for i in range(1, len(rows)):
            common = next((j for j in range(depth) if rows[i][j] != rows[i - 1][j]), depth)
            assert prefix[i] == (depth if common == depth else common // step * step)
        tied = (prefix == depth) | np.append(prefix[1:] == depth, False)
        interval, of2, row2 = repeated_intervals(turned, depth, step)
        start2 = [int(shards[i].order[r]) for i, r in zip(of2, row2)]
        assert sorted(zip(of2.tolist(), row2.tolist())) == sorted(zip(of[tied].tolist(), row[tied].tolist()))
        inside, where = [], np.concatenate([t.offset + depth <= t.lengths[t.string] for t in turned])
        cuts = np.cumsum([0] + [len(t.last) for t in turned])
        for k2, i, r in zip(interval, of2, row2):
            if where[cuts[i] + r]:
                inside.append((k2, i, r))
        alone = {k2 for k2, n in Counter(k2 for k2, _, _ in inside).items() if n > 1}
        only = list(zip(*(x.tolist() for x in repeated_intervals(turned, depth, step, within=True))))
        assert [(i, r) for _, i, r in only] == [(i, r) for k2, i, r in inside if k2 in alone]
        assert all((only[j][0] == only[j - 1][0]) == (rotation(shards[only[j][1]], shards[only[j][1]].order[only[j][2]], depth) == rotation(shards[only[j - 1][1]], shards[only[j - 1][1]].order[only[j - 1][2]], depth)) for j in range(1, len(only)))
        for i in range(1, len(of2)):
            a, b = (rotation(shards[of2[j]], start2[j], depth) for j in (i - 1, i))
            assert (interval[i] == interval[i - 1]) == (a == b) and a <= b


def test_nothing_to_merge():
    assert [len(x) for x in merge([], 8)] == [0, 0, 0]
    assert [len(x) for x in merge([Transform(Shard([]).transform()[0])], 8)] == [0, 0, 0]
    assert [len(x) for x in repeated_intervals([Transform(Shard([]).transform()[0])], 8)] == [0, 0, 0]
