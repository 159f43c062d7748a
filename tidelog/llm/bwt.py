"""Burrows-Wheeler transforms of shards of strings, and their merge by iterative interleave refinement.

A shard is a set of distinct strings, each closed by a byte that no text has, and its rows are the rotations of
those strings in order. Its transform, the byte before each row, is all that a merge needs of it. Shards are
merged without sorting their rows again: the interleave (the shard of each
merged row) starts in any order and is refined. A stable sort of the rows by the bytes that stand before
them turns an interleave that is right for the first k bytes into one that is right for `step` bytes more,
because within a shard that move keeps the order of the rows. Rows that no step has told apart share a block;
the step at which a boundary appears gives the common prefix of the rows at either side.
"""

from __future__ import annotations

import numpy as np

CLOSE = 0xFF


class Shard:
    """The rows of some strings. text: the strings, each closed; order: start of each row in it, in row order."""

    def __init__(self, strings: list[bytes]):
        self.text = np.frombuffer(b"".join([s + b"\xff" for s in strings]), np.uint8)
        n = len(self.text)
        lengths = np.array([len(s) + 1 for s in strings], np.int64)
        ends = np.cumsum(lengths)
        self.first = np.repeat(ends - lengths, lengths)  # where the string of each byte begins
        self.size, self.begins = np.repeat(lengths, lengths), ends - lengths
        near = np.arange(8)
        tail, head = ends[:, None] - 1 - near, (ends - lengths)[:, None] + near
        self.edges = np.where(near < lengths[:, None], tail, -1), np.where(near < lengths[:, None], head, -1)
        self.order = self._sorted()

    def _bytes_at(self, offset: int) -> np.ndarray:
        """Of each row's start, the byte `offset` further on, round the string; offset from -8 to 8."""
        n, k = len(self.text), abs(offset)
        out = np.empty(n, np.uint8)
        if offset >= 0:
            out[: max(0, n - k)] = self.text[k:]
            wrong = self.edges[0][:, :k]
        else:
            out[min(n, k) :] = self.text[: max(0, n - k)]
            wrong = self.edges[1][:, :k]
        at = wrong[wrong >= 0]  # starts so near a string's edge that the byte is round the corner
        first, size = self.first[at], self.size[at]
        out[at] = self.text[first + (at - first + offset) % size]
        return out

    def _sorted(self) -> np.ndarray:
        """Rotations in order, by prefix doubling over the rows that still tie."""
        n = len(self.text)
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << np.uint64(8)) | self._bytes_at(i)
        order = np.argsort(key)
        at = np.arange(n, dtype=np.int64)
        jump = at + 8
        round_ = np.flatnonzero(jump >= self.first + self.size)
        jump[round_] = self.first[round_] + (jump[round_] - self.first[round_]) % self.size[round_]
        slots, rank, sorted_key, placed = at, np.empty(n, np.int64), key[order], order
        while True:
            new = np.ones(len(placed), bool)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            rank[placed] = np.maximum.accumulate(np.where(new, slots, 0))
            tie = ~new
            tie[:-1] |= tie[1:]
            slots = slots[tie]
            if not len(slots):
                return order
            p = order[slots]
            key = rank[p] * n + rank[jump[p]]
            o = np.argsort(key)
            placed, sorted_key = p[o], key[o]
            order[slots] = placed
            jump = jump[jump]

    def transform(self) -> tuple[np.ndarray, np.ndarray]:
        """The byte before each row in row order (the Burrows-Wheeler transform), and the strings' numbers in the order
        of the rows at which they begin."""
        last = self._bytes_at(-1)[self.order]
        begin = self.order[last == CLOSE]
        return last, np.searchsorted(self.begins, begin)


class Transform:
    """What a shard's transform alone tells of its rows: the row that begins a byte before each, its string and offset.

    Strings are numbered in the order of the rows at which they begin. The rows of a string are a cycle of the map from
    a row to the one before it, so all strings are walked side by side, from their beginnings backwards.
    """

    def __init__(self, last: np.ndarray):
        n = len(last)
        self.last = last
        self.row_before = np.empty(n, np.int32)
        self.row_before[np.argsort(last, kind="stable")] = np.arange(n, dtype=np.int32)
        begin = np.flatnonzero(last == CLOSE)
        self.string, back = np.empty(n, np.int32), np.zeros(n, np.int32)
        at, who, steps = begin, np.arange(len(begin), dtype=np.int32), 0
        while len(at):
            self.string[at], back[at] = who, steps
            at, steps = self.row_before[at], steps + 1
            go_on = at != begin[who]
            at, who = at[go_on], who[go_on]
        size = np.bincount(self.string, minlength=len(begin)).astype(np.int32)
        self.lengths = size - 1
        self.offset = np.where(back == 0, 0, size[self.string] - back) if n else back

    def before(self, step: int) -> np.ndarray:
        """The `step` bytes before each row, as one number."""
        gram, row = self.last.astype(np.uint32), self.row_before
        for k in range(1, step):
            gram |= self.last[row].astype(np.uint32) << np.uint32(8 * k)
            row = self.row_before[row]
        return gram

    def moves(self, step: int) -> np.ndarray:
        """Of each row, the row that begins `step` bytes before it."""
        row = self.row_before
        for _ in range(step - 1):
            row = self.row_before[row]
        return row


def merge(shards: list[Transform], depth: int, step: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged rows of at most 256 shards: shard and row in it, and its common prefix with the row before.

    Rows are in order by their first `depth` bytes. The prefix is given in whole steps (exact for step 1), capped
    at depth; it is 0 for the first row.
    """
    if not sum(len(s.last) for s in shards):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int32)
    before = [s.before(step) for s in shards]
    alphabet, codes = np.unique(np.concatenate(before), return_inverse=True)
    halves = [codes.astype(np.uint16)] if len(alphabet) <= 1 << 16 else [(codes & 0xFFFF).astype(np.uint16), (codes >> 16).astype(np.uint16)]
    cuts = np.cumsum([0] + [len(b) for b in before])
    n = int(cuts[-1])
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), np.diff(cuts))
    block, prefix = np.zeros(n, np.int32), np.full(n, depth, np.int32)
    prefix[0] = 0
    known = np.zeros(n, bool)
    known[0] = True
    for done in range(0, depth, step):
        of = [interleave == s for s in range(len(shards))]
        rows = []
        for half in halves:
            c = np.empty(n, np.uint16)
            for s, mine in enumerate(of):
                c[mine] = half[cuts[s] : cuts[s + 1]]
            rows.append(c)
        order = np.argsort(rows[0], kind="stable")
        if len(rows) == 2:
            order = order[np.argsort(rows[1][order], kind="stable")]
        interleave, block = interleave[order], block[order]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = block[1:] != block[:-1]
        for c in rows:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        prefix[new & ~known] = done
        known = new
        block = np.cumsum(new, dtype=np.int32)
    row = np.empty(n, np.int64)
    for s, shard in enumerate(shards):
        row[interleave == s] = np.arange(len(shard.last))
    return interleave, row, prefix


def repeated_intervals(shards: list[Transform], depth: int, step: int = 4, within: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged rows with a common prefix of at least `depth` with a neighbour: interval, shard and row in it.

    The refinement of merge(), kept to rows that still share a block: a row that the first k bytes tell from all
    others is told apart by `step` more bytes wherever it moves, so it and its moves are never looked at again.
    depth is a multiple of step. within: only rows whose first `depth` bytes are within their string; those are where
    the moves from rows at least `depth` bytes into a string end, so no other row is looked at.
    """
    if not sum(len(s.last) for s in shards):
        return np.empty(0, np.int32), np.empty(0, np.uint8), np.empty(0, np.int64)
    codes = np.concatenate([s.before(step) for s in shards])
    cuts = np.cumsum([0] + [len(s.last) for s in shards])
    moves = np.concatenate([s.moves(step) + np.int32(a) for s, a in zip(shards, cuts, strict=False)])
    rows = np.arange(cuts[-1], dtype=np.int32)
    if within:
        rows = rows[np.concatenate([s.offset for s in shards]) >= depth]
    block = np.zeros(len(rows), np.int32)
    for _ in range(0, depth, step):
        c = codes[rows]
        order = np.argsort(c.astype(np.uint16), kind="stable")
        if step > 2:
            order = order[np.argsort((c >> np.uint32(16)).astype(np.uint16)[order], kind="stable")]
        c, block, rows = c[order], block[order], moves[rows[order]]
        new = np.ones(len(rows) + 1, bool)
        new[1:-1] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        tied = ~(new[1:] & new[:-1])
        block, rows = np.cumsum(new[:-1], dtype=np.int32)[tied], rows[tied]
        if not len(rows):
            break
    of = (np.searchsorted(cuts, rows, side="right") - 1).astype(np.uint8)
    return block, of, rows - cuts[of]
