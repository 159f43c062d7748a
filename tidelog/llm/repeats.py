"""Removal of repeated substrings across all documents, by merged Burrows-Wheeler transforms.

A byte goes if a string of `width` bytes that covers it also starts earlier (at a smaller document, or in the same
one before). The strings of `width` bytes are called windows here.

1. *Where to look.* A window belongs to the smallest hash among its short grams, so equal windows belong together
   whatever surrounds them, and neighbours mostly share it: a text falls into some runs of windows. Texts are read
   once, in chunks of bounded size; a chunk leaves as one row, and its distinct hashes with their counts as one row for
   each part of the hashes. Parts add up the counts and answer each chunk how often its hashes occur over all.
2. *Strings.* A chunk cuts out the runs whose hash occurs again. Equal ones are one string with its places (the earliest
   one, where they are very many; the later ones then go at once). A hash with many places (the edge of a passage that many texts quote, a line
   that stands in many contexts) would bring as many strings together, so its runs are cut into bands of BAND windows,
   which meet by a hash of the bytes that all windows of a band have; with very many places, into single windows.
3. *Shards.* Parts of the strings fall into collections of bounded size, which end between hashes, and these into
   shards; each shard gets its transform and leaves as a row: the transform, and the places of its strings.
4. *Merge.* The transforms of a collection are merged by interleave refinement, which tells their rows apart `step`
   bytes at a time and sorts no suffix again. Rows that still share their first `width` bytes are one repeated
   interval: its earliest window stays, the others go; and so do all later places of a string that has several.
5. *Cut.* Ranges come together by document, and the bytes outside them stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import pack, unpack
from tidelog.llm.bwt import Shard, Transform, repeated_intervals
from tidelog.llm.jaccard_join import BLOBS, _rows, runs_of
from tidelog.llm.shared import parts_of, release, small_batches
from tidelog.session import discard, materialize

#: Windows of a string at most; bytes of a collection and of a shard, about.
RUN, COLLECTION, SHARD = 256, 1 << 20, 1 << 17
#: Places from which a hash's runs are cut into bands, and into single windows; windows of a band.
CROWDED, VERY_CROWDED, BAND = 4_000, 16_000, 16
GRAM = 32
MIX = [int.from_bytes(hashlib.blake2b(b"gram %d" % i, digest_size=8).digest(), "little") | 1 for i in range(4)]
BYTE_VALUES = np.array([int.from_bytes(hashlib.blake2b(b"byte %d" % i, digest_size=8).digest(), "little") | 1 for i in range(256)], np.uint64)


def sliding(f: np.ufunc, x: np.ndarray, span: int) -> np.ndarray:
    """f (minimum or maximum) over each `span` neighbours."""
    n, size = len(x) - span + 1, 1
    while size * 2 <= span:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[:n], x[span - size : span - size + n])


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each gram; gram is a power of two."""
    h, size, c = BYTE_VALUES[raw], 1, MIX[0]
    while size < gram:
        h = h[:-size] * np.uint64(c) + h[size:]
        c, size = c * c & 0xFFFFFFFFFFFFFFFF, size * 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX[2])
    return h ^ (h >> np.uint64(29))


def runs_to_place(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of each run of windows, and whether the run may repeat a window within itself.

    Equal windows of one run have their smallest gram at two places. Places where a gram is the smallest of
    some window are those where it equals the largest of the minima around; two of them in a row with one hash
    mark the windows over them.
    """
    grams, span = gram_hashes(raw), width - GRAM + 1
    h = sliding(np.minimum, grams, span)
    starts, lengths = cut_runs(h)
    around = np.concatenate([np.zeros(span - 1, np.uint64), h, np.zeros(span - 1, np.uint64)])
    chosen = np.flatnonzero(grams == sliding(np.maximum, around, span))
    twice = np.flatnonzero(grams[chosen[1:]] == grams[chosen[:-1]])
    inside = np.zeros(len(starts), bool)
    if len(twice):
        step = np.zeros(len(h) + 1, np.int64)
        np.add.at(step, np.maximum(chosen[twice] - span + 1, 0), 1)
        np.add.at(step, np.minimum(chosen[twice + 1] + 1, len(h)), -1)
        inside = np.add.reduceat((np.cumsum(step[:-1]) > 0).astype(np.int64), starts) > 0
    return h[starts], lengths, inside


def cut_runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal hashes, none longer than RUN."""
    starts, lengths = runs_of(h)
    if len(lengths) and lengths.max() > RUN:
        pieces = -(-lengths // RUN)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + within * RUN
        lengths = np.minimum(np.repeat(lengths, pieces) - within * RUN, RUN)
    return starts, lengths


def bands(run: bytes, width: int, band: int) -> Iterator[tuple[int, int, int]]:
    """Start, end and key of the pieces of a run of windows that share their smallest gram.

    A window's place in its band follows from where its first smallest gram lies within it, so equal windows are in
    bands of one kind; the key is a hash of the bytes that every window of such a band has, whole or cut off here.
    """
    grams = gram_hashes(np.frombuffer(run, np.uint8))
    n = len(run) - width + 1
    at = np.flatnonzero(grams == grams.min())
    gram = at[np.searchsorted(at, np.arange(n))]
    kind = (gram - np.arange(n)) // band
    new = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (kind[1:] != kind[:-1])]))
    for a, b, g, j in zip(new.tolist(), np.append(new[1:], n).tolist(), gram[new].tolist(), kind[new].tolist(), strict=True):
        last = g - j * band  # where the last window of such a band starts
        yield a, b + width - 1, xxhash.xxh3_64_intdigest(run[last : last - band + 1 + width], seed=j) | 1 << 63


CHUNKS = "chunk long, part int, payload binary"
ARROW_CHUNKS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("payload", pa.binary())])
RANGES = pa.schema([("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _scanned(keyed: DataFrame, width: int, parts: int, chunk_bytes: int) -> DataFrame:
    """Chunks of documents of at least `width` bytes, named by their first k: part -1 has their texts and runs, with the
    number of each run's hash in the chunk; the other parts have the distinct hashes, in order, and their counts."""

    def flush(keys: list, texts: list, runs: list) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        h, lengths, inside = (np.concatenate(x) for x in zip(*runs, strict=True))
        h >>= np.uint64(8)
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((h, part))
        starts, sizes = runs_of(h[order])
        count = sizes + np.add.reduceat(inside[order].astype(np.int64), starts)
        entry = np.empty(len(h), np.uint32)
        entry[order] = np.repeat(np.arange(len(starts), dtype=np.uint32), sizes)
        heads = np.array([len(t) for t in texts], np.uint32), np.array([len(r[0]) for r in runs], np.uint32)
        yield _rows(ARROW_CHUNKS, [[keys[0]], [-1], [pack(np.array(keys, np.int64), *heads, lengths.astype(np.uint16), entry, b"".join(texts))]])
        values, of = h[order][starts], part[order][starts]
        ends = np.searchsorted(of, np.arange(parts + 1))
        for p in range(parts):
            if ends[p] < ends[p + 1]:
                own = slice(ends[p], ends[p + 1])
                yield _rows(ARROW_CHUNKS, [[keys[0]], [p], [pack(np.diff(values[own], prepend=np.uint64(0)), count[own].astype(np.uint32))]])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if len(raw) >= width:
                    for to, x in zip(held, (k, raw, runs_to_place(np.frombuffer(raw, np.uint8), width)), strict=True):
                        to.append(x)
                    size += len(raw)
                if size >= chunk_bytes:
                    yield from flush(*held)
                    held, size = ([], [], []), 0
        yield from flush(*held)
        release()

    return keyed.mapInArrow(emit, CHUNKS)


def _answered(scanned: DataFrame) -> DataFrame:
    """For each chunk and part, of its hashes in order: the level (0: it occurs once over all, 1: again, 2: crowded,
    3: very crowded) and, above 0, its number in the part."""

    def meet(table: pa.Table) -> pa.Table:
        blobs = [unpack(p) for p in table["payload"].to_pylist()]
        h = [np.cumsum(b[0], dtype=np.uint64) for b in blobs]
        flat = np.concatenate(h)
        order = np.argsort(flat, kind="stable")
        starts, _ = runs_of(flat[order])
        total = np.add.reduceat(np.concatenate([b[1] for b in blobs]).astype(np.int64)[order], starts)
        level = (total > 1).astype(np.uint8) + (total > CROWDED) + (total > VERY_CROWDED)
        values, answers = flat[order][starts], []
        for own in h:
            i = np.searchsorted(values, own)
            answers.append(pack(level[i], np.diff(i[level[i] > 0], prepend=0).astype(np.uint32)))
        return pa.table([table["chunk"], table["part"], pa.array(answers, pa.binary())], schema=ARROW_CHUNKS)

    return scanned.filter("part >= 0").groupBy("part").applyInArrow(meet, CHUNKS)


#: Places of a string that a chunk sends on; of strings with more the earliest one, as of those of crowded hashes.
PLACES = 64


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for counts[i] numbers, one i after another."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Folded:
    """Distinct strings with a key and their places, the earliest one first, and the ranges that places leave which
    aren't sent on: those go, as an earlier one of the string is."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.key, self.k, self.s, self.n, self.size = [], [], [], [], 0
        self.more: tuple[list[int], list[int], list[int]] = ([], [], [])  # string, k, s
        self.ranges: list[tuple[int, int, int]] = []

    def add(self, string: bytes, key: int, k: int, s: int, send: bool = False) -> int:
        """The number of the string."""
        i = self.at.setdefault(string, len(self.key))
        if i == len(self.key):
            for to, x in ((self.key, key), (self.k, k), (self.s, s), (self.n, 1)):
                to.append(x)
            self.size += len(string)
            return i
        if (k, s) < (self.k[i], self.s[i]):
            k, s, self.k[i], self.s[i] = self.k[i], self.s[i], k, s
        if (k, s) == (self.k[i], self.s[i]):
            return i
        if send and self.n[i] < PLACES:
            self.n[i] += 1
            for to, x in zip(self.more, (i, k, s), strict=True):
                to.append(x)
            return i
        last = self.ranges[-1] if self.ranges else (None, 0, 0)
        if last[0] == k and last[1] <= s <= last[2]:
            self.ranges[-1] = (k, last[1], max(last[2], s + len(string)))
        else:
            self.ranges.append((k, s, s + len(string)))
        return i

    def blobs(self, parts: int, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """The strings (the wanted ones) by part of their keys; part -1 has ranges."""
        if self.ranges:
            yield _rows(BLOBS, [[-1], [pack(*np.array(self.ranges, np.int64).T.copy())]])
        key, strings = np.array(self.key, np.uint64), list(self.at)
        k, s, others = np.array(self.k, np.int64), np.array(self.s, np.uint32), np.array(self.n, np.int64) - 1
        more, more_k, more_s = (np.array(x, np.int64) for x in self.more)
        by_string = np.argsort(more, kind="stable")
        more_k, more_s, begin = more_k[by_string], more_s[by_string].astype(np.uint32), np.cumsum(others) - others
        part = ((key * np.uint64(MIX[3]) >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((key, part))
        if wanted is not None:
            order = order[wanted[order]]
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            i = order[ends[p] : ends[p + 1]]
            if len(i):
                own, places = [strings[x] for x in i.tolist()], spread(begin[i], others[i])
                yield _rows(BLOBS, [[p], [pack(key[i], k[i], s[i], np.array([len(x) for x in own], np.uint16), b"".join(own), others[i].astype(np.uint8), more_k[places], more_s[places])]])


def _strings(scanned: DataFrame, width: int, parts: int) -> DataFrame:
    """The chunks' strings whose windows may occur again, with their places, by part; part -1 has the ranges of places
    that chunks don't send on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, blob = {}, None
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part < 0:
                    blob = payload
                else:
                    answers[part] = payload
        ks, sizes, n_runs, lengths, entry, body = unpack(blob)
        levels, keys = [], []
        for part in sorted(answers):
            level, number = unpack(answers[part])
            key = np.zeros(len(level), np.uint64)
            key[level > 0] = np.cumsum(number, dtype=np.uint64) | np.uint64(part << 32)
            levels.append(level)
            keys.append(key)
        level, key = np.concatenate(levels), np.concatenate(keys)
        if len(level) != int(entry.max()) + 1:
            raise RuntimeError("a chunk lacks answers")
        level, key, runs = level[entry], key[entry], Folded()
        how: dict[int, int] = {}  # by number of the string, where its runs are crowded
        text_end, run_end = np.cumsum(sizes, dtype=np.int64).tolist(), np.cumsum(n_runs, dtype=np.int64).tolist()
        for k, size, end, count, last in zip(ks.tolist(), sizes.tolist(), text_end, n_runs.tolist(), run_end, strict=True):
            own = slice(last - count, last)
            n = lengths[own].astype(np.int64)
            start, found = np.cumsum(n) - n, np.flatnonzero(level[own])
            for s, m, v, crowd in zip(start[found].tolist(), n[found].tolist(), key[own][found].tolist(), level[own][found].tolist(), strict=True):
                i = runs.add(body[end - size + s : end - size + s + m + width - 1], v, k, s, crowd == 1)
                if crowd > 1:
                    how[i] = crowd
        del body, level, key
        whole, pieces = np.ones(len(runs.key), bool), Folded()
        if how:
            whole[list(how)] = False
            strings = list(runs.at)
            for i, crowd in how.items():
                for a, b, v in bands(strings[i], width, BAND if crowd == 2 else 1):
                    pieces.add(strings[i][a:b], v, runs.k[i], runs.s[i] + a)
                if pieces.size >= 8 << 20:
                    yield from pieces.blobs(parts)
                    pieces = Folded()
            del strings
        yield from pieces.blobs(parts)
        yield from runs.blobs(parts, whole)
        del runs, pieces
        release()

    both = scanned.filter("part = -1").unionByName(_answered(scanned))
    return both.groupBy("chunk").applyInArrow(_named("part", "payload")(cut), "part int, payload binary")


def _named(*columns: str):
    """A function of a group's batches that gets these columns only, in this order."""

    def wrap(f):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return f(b.select(columns) for b in batches)

        return run

    return wrap


SHARDS = "collection long, payload binary"
ARROW_SHARDS = pa.schema([("collection", pa.int64()), ("payload", pa.binary())])


def shard_row(strings: list[bytes], k: np.ndarray, s: np.ndarray, others: np.ndarray, more_k: np.ndarray, more_s: np.ndarray) -> bytes:
    """A shard: its transform, and of each string, in the transform's order, the earliest place and the other ones.
    others: how many of those each string has in more_k and more_s, one string after another."""
    last, names = Shard(strings).transform()
    places = spread((np.cumsum(others) - others)[names], others[names])
    return pack(last, k[names], s[names].astype(np.uint32), others[names].astype(np.uint32), more_k[places], more_s[places].astype(np.uint32))


def _shards(strings: DataFrame, width: int) -> DataFrame:
    """Shards of the collections of each part; collection -1 has ranges."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sid, keys, ks, ss, part = {}, [], [], [], [], -1
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part < 0:
                    yield _rows(ARROW_SHARDS, [[-1], [payload]])
                    continue
                key, k, s, lengths, body, others, more_k, more_s = unpack(payload)
                ends = np.cumsum(lengths, dtype=np.int64).tolist()
                own = np.array([at.setdefault(body[b - n : b], len(at)) for b, n in zip(ends, lengths.tolist(), strict=True)], np.int64)
                sid += [own, np.repeat(own, others)]
                keys += [key, np.repeat(key, others)]
                ks += [k, more_k]
                ss += [s.astype(np.int64), more_s.astype(np.int64)]
        if not at:
            return
        sid, key, k, s = (np.concatenate(x) for x in (sid, keys, ks, ss))
        order = np.lexsort((s, k, sid))
        sid, key, k, s = sid[order], key[order], k[order], s[order]
        first, counts = runs_of(sid)
        names, others = list(at), counts - 1
        key = key[first]
        size = np.array([len(x) for x in names], np.int64)
        order = np.argsort(key, kind="stable")
        groups, members = runs_of(key[order])
        # a window that is a string by itself, alone under its key, is an interval of its own: of its places, if it has others
        lone = np.repeat(members == 1, members) & (size[order] == width)
        again = spread(first[order[lone]] + 1, others[order[lone]])
        if len(again):
            yield _rows(ARROW_SHARDS, [[-1], [pack(k[again], s[again], s[again] + width)]])
        order = order[~lone]
        if not len(order):
            return
        ends = np.cumsum(size[order])
        new = np.flatnonzero(np.concatenate([key[order][1:] != key[order][:-1], [True]]))  # last strings of their keys
        begin = number = 0
        while begin < len(order):
            target = (ends[begin - 1] if begin else 0) + COLLECTION
            end = int(new[min(np.searchsorted(new, np.searchsorted(ends, target)), len(new) - 1)]) + 1
            shard = (ends[begin:end] - ends[begin]) // max(SHARD, -(-int(ends[end - 1] - ends[begin] + 1) // 255))
            for cut in np.split(order[begin:end], np.flatnonzero(np.diff(shard)) + 1):
                places = spread(first[cut] + 1, others[cut])
                yield _rows(ARROW_SHARDS, [[part << 32 | number], [shard_row([names[i] for i in cut.tolist()], k[first[cut]], s[first[cut]], others[cut], k[places], s[places])]])
            begin, number = end, number + 1
        del at, names
        release()

    return strings.groupBy("part", F.when(F.col("part") < 0, F.xxhash64("payload")).alias("own")).applyInArrow(_named("part", "payload")(build), SHARDS)


def merged_ranges(shards: list[bytes], width: int) -> np.ndarray:
    """k, a, b: ranges to remove, from the rows of a collection's shards."""
    turned, k, s, out = [], [], [], []
    for blob in shards:
        last, own_k, own_s, others, more_k, more_s = unpack(blob)
        turned.append(Transform(last))
        k.append(own_k)
        s.append(own_s.astype(np.int64))
        # a string with several places: all its windows are intervals, of which the later places go
        size = np.repeat(turned[-1].lengths, others).astype(np.int64)
        out.append(np.stack([more_k, more_s.astype(np.int64), more_s + size], 1))
    interval, of, row = repeated_intervals(turned, width, next(x for x in (4, 2, 1) if width % x == 0), within=True)
    base = np.cumsum([0] + [len(x) for x in k])
    string, offset = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    for i, t in enumerate(turned):
        mine = of == i
        string[mine], offset[mine] = t.string[row[mine]] + base[i], t.offset[row[mine]]
    k, s = np.concatenate(k), np.concatenate(s)
    order = np.lexsort((s[string] + offset, k[string], interval))
    interval, string, offset = interval[order], string[order], offset[order]
    later = np.zeros(len(order), bool)
    later[1:] = interval[1:] == interval[:-1]
    string, offset = string[later], offset[later]
    if len(string):
        order = np.lexsort((offset, string))
        string, offset = string[order], offset[order]
        new = np.ones(len(string), bool)
        new[1:] = (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + width)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(string)) - 1
        own = string[first]
        out.append(np.stack([k[own], s[own] + offset[first], s[own] + offset[last] + width], 1))
    return np.concatenate(out)


def _merged(shards: DataFrame, width: int) -> DataFrame:
    """k, a, b: ranges to remove, of each collection."""

    def merge(table: pa.Table) -> pa.Table:
        payloads = table["payload"].to_pylist()
        if table["collection"][0].as_py() < 0:
            found = np.concatenate([np.stack(unpack(p), 1) for p in payloads])
        else:
            found = merged_ranges(payloads, width)
        release()
        return pa.table([pa.array(found[:, i].copy()) for i in range(3)], schema=RANGES)

    return shards.groupBy("collection", F.when(F.col("collection") < 0, F.xxhash64("payload")).alias("own")).applyInArrow(merge, "k long, a long, b long")


def _zipped(keyed: DataFrame) -> DataFrame:
    schema = pa.schema([("k", pa.int64()), ("z", pa.binary())])

    def squeeze(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield _rows(schema, [b.column(0), [c.compress((t.as_py() or "").encode()) for t in b.column(1)]])

    return keyed.mapInArrow(squeeze, "k long, z binary")


def removed_ranges(keyed: DataFrame, parts: int, width: int = 100, chunk_bytes: int = 8 << 20) -> DataFrame:
    """k, a, b: ranges (they may overlap) whose union is what goes. keyed: k (unique, in document order) and text."""
    with small_batches(keyed.sparkSession):
        scanned = materialize(_scanned(keyed, width, parts, chunk_bytes), "repeat-scan")
    ranges = materialize(_merged(_shards(_strings(scanned, width, parts), width), width), "repeat-ranges")
    discard(scanned)
    return ranges


def with_keys(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """k and text, with k = id where ids are unique and not null; else k numbers the distinct pairs of id (null last)
    and text (by its digest), and the second frame has k, id and times. Only ids and digests are sorted."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = source.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("id is null or n > 1").isEmpty():
        return source.select(F.col("id").alias("k"), "text"), None
    digested = source.withColumn("digest", F.unhex(F.sha2("text", 256)))
    pairs = digested.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times")).orderBy(F.col("id").asc_nulls_last(), "digest")
    pairs = materialize(pairs.select("id", "digest", "times", F.monotonically_increasing_id().alias("k")), "numbered")
    named = pairs.select(F.col("id").alias("of"), F.col("digest").alias("own"), "k")
    texts = digested.join(named, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("own"))).groupBy("k").agg(F.min("text").alias("text"))
    return texts, pairs.select("k", "id", "times")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, with_kept: bool = True) -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans, and kept (bytes) if asked.

    Texts are UTF-8 bytes, null is empty, and no window crosses documents. spans are the maximal removed runs as
    [start, end). What stays may begin or end within a character, as removal is by byte. Documents come in the
    order of their ids; rows that repeat an id come in the order of their texts' digests, null ids last; of equal
    rows one is the first, and the others repeat it as a whole. Other columns are ignored. Empty in, empty out.
    A very long text is a chunk of its own: one task holds it, with about 20 bytes for each of its bytes.
    """
    keyed, ids = with_keys(docs, id_col, text_col)
    ranges = removed_ranges(keyed, parts_of(docs, text_col), width)
    own = ranges.groupBy("k").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))  # a document's ranges at most
    schema = pa.schema([("k", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for k, z, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text, spans = unzip.decompress(z), []
                for x, y in sorted(zip(a or [], b or [], strict=True)):
                    if spans and x <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], y)
                    else:
                        spans.append([x, y])
                at, kept = 0, []
                for x, y in spans:
                    kept.append(text[at:x])
                    at = y
                kept = b"".join([*kept, text[at:]])
                rows.append((k, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept if with_kept else None))
            if rows:
                yield _rows(schema, zip(*rows, strict=True))

    done = _zipped(keyed).join(own, "k", "left").select("k", "z", "a", "b").mapInArrow(cut, "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, kept binary")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if with_kept else [])]
    if ids is None:
        return done.select(F.col("k").alias(id_col), *columns)
    each = done.join(ids, "k")
    thousands = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 1_000)))
    each = each.withColumn("m", thousands).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(999), F.col("times") - 1 - F.col("m") * 1_000))))
    again = (F.col("m") * 1_000 + F.col("copy") > 0) & (F.col("n_bytes") >= width)
    gone = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(F.lit(""), 256), "spans": F.array(F.array(F.lit(0).cast("long"), F.col("n_bytes"))), "kept": F.lit(b"")}
    return each.select(F.col("id").alias(id_col), *[F.when(again, gone[c]).otherwise(F.col(c)).alias(c) if c in gone else F.col(c) for c in columns])
