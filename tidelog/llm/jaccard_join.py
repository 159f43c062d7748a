"""N-gram Jaccard join by token-combination prefixes.

Tokens are 64-bit hashes of shingles, in hash order; a document of n tokens that links with another one
lacks at most e = n - ceil(t n) of its tokens there.

*Rare tokens, singly.* Every document indexes its tokens below a hash bound that falls with n, somewhat more
than e of them. A token in more than RARE documents is frequent and is not indexed by itself. A document with
more than e rare tokens below its bound shares one of them with each partner, so all its pairs come out here.
Tokens travel in packed blobs by hash part; what is frequent within a task leaves as a mark, not as rows.

*Frequent tokens, in combinations.* Documents that fall short (mostly of passages that many share, or in large
groups of near copies) extend their prefix over all their tokens: rare ones first, singly, then frequent
ones by pairs. A pair stays within one of m hash groups, so a prefix with f tokens in a group survives f - 1
losses there; prefixes grow until the losses that all groups bear exceed e. (Sets so small that a link may have
one common token only go by single ones throughout.) m follows from the size class of
the smaller document, so a document indexes its pairs for each class that a smaller partner may be of.

*Nodes.* Documents with equal sets are one node from the start, known by a digest of the set, so neither copies
nor rows that share an id matter here: a node indexes its tokens once a task, and ids come back at the end.

*Verify.* Candidates are compared by their full sets.
Of a combination's documents all are first compared with one leader; only documents that this leaves in
different components are compared with each other. Thus a group of near copies costs a link each, not a
pair each, and no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import pack, unpack
from tidelog.llm.components import components
from tidelog.llm.shared import parts_of, release, small_batches
from tidelog.session import discard, materialize

#: A token in more documents than this is frequent.
RARE = 6
#: Signatures from here on are pairs of frequent tokens.
PAIRS = 1 << 62
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Odd multipliers of the words of a shingle.
MULTIPLIERS = np.array([int.from_bytes(hashlib.blake2b(b"shingle %d" % i, digest_size=8).digest(), "little") | 1 for i in range(64)], np.uint64)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of fewer words, one of the whole sequence; empty without words."""
    found = text.translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h += w[i : i + n] * MULTIPLIERS[i]
    h ^= h >> np.uint64(29)
    h *= MULTIPLIERS[63]
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def most_missing(n, threshold: float):
    """Tokens that a document of n may lack in a partner: n - ceil(threshold * n)."""
    return n - np.ceil(np.round(threshold * n, 6)).astype(np.int64)


def bound(n: float, threshold: float) -> np.uint64:
    """Tokens (their high 48 bits) below this are indexed singly; falls with n and leaves more than e of them, as a rule."""
    share = 1.0 if n <= 48 else min(1.0, (1 - threshold) + 0.02 + 2.5 / n**0.5)
    return np.uint64(int(share * (1 << 48)))


def close(na, nb, percent: int):
    """The sizes allow a link."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def may_link(sig, n1, rare1, n2, rare2, percent: int):
    """The sizes allow a link; and where only frequent tokens can be common, there are enough of those.

    Documents that meet by a pair and by no rare token have none in common: a prefix with pairs has all rare tokens.
    """
    common = F.least(n1 - rare1, n2 - rare2)
    return close(n1, n2, percent) & ((sig < PAIRS) | (common * (100 + percent) >= (n1 + n2) * percent))


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def signatures(tokens: np.ndarray, is_frequent: np.ndarray, threshold: float) -> np.ndarray:
    """The extended prefix of a document: single rare tokens (below PAIRS) and pairs of frequent ones (above)."""
    n = len(tokens)
    lacks = int(most_missing(n, threshold))
    rare = tokens[~is_frequent][: lacks + 1]
    if len(rare) > lacks:
        return rare.astype(np.int64)
    need, frequent, out = lacks + 1 - len(rare), tokens[is_frequent], [rare.astype(np.int64)]
    for level in range(int(np.log2(max(1, threshold * n))), int(np.log2(n)) + 1):  # of every smaller partner
        common = int(np.ceil(np.round(threshold * (1 << level), 6)))  # tokens that a link has at least
        if common < 2:  # too few for pairs
            out.append(_hashed(frequent[:need], np.uint64(0), level))
            continue
        m = max(1, min((1 << level) // 8, common - 1))
        group = frequent % np.uint64(m)
        order = np.argsort(group, kind="stable")
        first = np.zeros(len(frequent), bool)
        first[order[runs_of(group[order])[0]]] = True  # the first of a group bears no loss
        borne = np.cumsum(~first)
        cut = int(np.searchsorted(borne, need)) + 1
        chosen, group = frequent[:cut], group[:cut]
        order = np.argsort(group, kind="stable")
        for start, length in zip(*runs_of(group[order]), strict=True):
            at = chosen[order[start : start + length]]
            i, j = np.triu_indices(length, 1)
            out.append(_hashed(at[i], at[j], level))
    return np.concatenate(out)


def _hashed(a: np.ndarray, b: np.ndarray | np.uint64, level: int) -> np.ndarray:
    h = (a * MULTIPLIERS[1] + b * MULTIPLIERS[2] + np.uint64(level)) * MULTIPLIERS[3]
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(2)) | np.uint64(PAIRS)).astype(np.int64)


def _rows(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


SIZES = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("q", pa.int64()), ("digest", pa.binary()), ("node", pa.int64())])
BLOBS = pa.schema([("part", pa.int32()), ("payload", pa.binary())])
FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _scan(source: DataFrame, threshold: float, shingle: int, parts: int, chunk_tokens: int = 1 << 19) -> DataFrame:
    """One pass over the texts. Rows of part -1 hold ids (null ones too), hashes of texts, set sizes, tokens below the
    bound, digests of sets and numbers of nodes; the others hold the tokens of a part with their nodes.

    A node's number is 63 bits of its digest: should two nodes share one, both become candidates of what either meets.
    """

    def flush(sizes: list, nodes: list, tokens: list, flags: list) -> Iterator[pa.RecordBatch]:
        if sizes:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, SIZES) as w:
                w.write_batch(_rows(SIZES, zip(*sizes, strict=True)))
            yield _rows(BLOBS, [[-1], [pack(sink.getvalue().to_pybytes())]])
        if not tokens:
            return
        owner = np.repeat(np.array(nodes, np.int64), [len(t) for t in tokens])
        t, f = np.concatenate(tokens), np.concatenate(flags)
        order = np.argsort(t, kind="stable")
        t, f, owner = t[order], f[order], owner[order]
        starts, lengths = runs_of(t)
        hot = np.repeat(lengths > RARE, lengths)
        hot_ids, hot_counts = np.unique(owner[hot & f], return_counts=True)
        marks = t[starts[lengths > RARE]]  # a mark each instead of the rows
        t, f, owner = np.concatenate([t[~hot], marks]), np.concatenate([f[~hot], np.zeros(len(marks), bool)]), np.concatenate([owner[~hot], np.full(len(marks), -1, np.int64)])
        mark = np.concatenate([np.zeros(len(t) - len(marks), np.uint8), np.ones(len(marks), np.uint8)])
        part = (t % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((t, part))
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            at = order[ends[p] : ends[p + 1]]
            if len(at):
                delta = np.diff(t[at], prepend=np.uint64(0))
                yield _rows(BLOBS, [[p], [pack(delta, owner[at], f[at].view(np.uint8) + 2 * mark[at])]])
        if len(hot_ids):
            yield _rows(BLOBS, [[int(hot_ids[0] % parts)], [pack(np.empty(0, np.uint64), hot_ids, hot_counts.astype(np.int64))]])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = ([], [], [], []), 0, set()
        for batch in batches:
            for doc_id, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                u = shingles((text.as_py() or "").encode(), shingle)
                t = u >> np.uint64(16)
                digest = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                node = int.from_bytes(digest[:8], "little") >> 1
                held[0].append((doc_id, h, len(u), int(np.searchsorted(t, bound(len(u), threshold))), digest, node))
                if len(u) and doc_id is not None and node not in seen:
                    seen.add(node)
                    t = t[: np.searchsorted(t, bound(threshold * len(u), threshold))]
                    for to, x in zip(held[1:], (node, t, t < bound(len(u), threshold)), strict=True):
                        to.append(x)
                    size += len(t)
                if size >= chunk_tokens or len(held[0]) >= 1 << 16:
                    yield from flush(*held)
                    held, size = ([], [], [], []), 0
        yield from flush(*held)
        release()

    return source.mapInArrow(emit, "part int, payload binary")


def _sizes(scanned: DataFrame) -> DataFrame:
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                with pa.ipc.open_stream(unpack(payload.as_py())[0]) as reader:
                    yield from reader

    return scanned.filter("part = -1").select("payload").mapInArrow(unpacked, "id long, h long, n long, q long, digest binary, node long")


def _single_index(scanned: DataFrame) -> DataFrame:
    """kind 0: nodes that share a rare token; kind 1: a node and how many of its tokens below its bound are frequent.

    Tokens that are frequent within several tasks may count a node's copies more than once; too high a count costs a
    place in the combination index and nothing else.
    """

    def meet(table: pa.Table) -> pa.Table:
        tokens, owners, flags, out = [], [], [], [np.empty((0, 3), np.int64)]
        for payload in table["payload"].to_pylist():
            delta, owner, flag = unpack(payload)
            if len(delta):
                tokens.append(np.cumsum(delta, dtype=np.uint64))
                owners.append(owner)
                flags.append(flag)
            else:
                out.append(np.stack([np.ones(len(owner), np.int64), owner, flag], 1))
        if tokens:
            t, owner, flag = np.concatenate(tokens), np.concatenate(owners), np.concatenate(flags)
            order = np.lexsort((owner, t))
            t, owner, flag = t[order], owner[order], flag[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])  # copies of a node in several tasks are one
            t, owner, flag = t[new], owner[new], flag[new]
            starts, lengths = runs_of(t)
            marked = np.add.reduceat((flag >= 2).astype(np.int64), starts) > 0
            hot = marked | (lengths > RARE)
            counted = np.repeat(hot, lengths) & (flag == 1)
            ids, counts = np.unique(owner[counted], return_counts=True)
            out.append(np.stack([np.ones(len(ids), np.int64), ids, counts], 1))
            pairs = []
            for length in range(2, RARE + 1):
                rows = owner[starts[(lengths == length) & ~hot][:, None] + np.arange(length)]
                pairs += [np.stack([np.minimum(rows[:, i], rows[:, j]), np.maximum(rows[:, i], rows[:, j])], 1) for i, j in combinations(range(length), 2)]
            pairs = np.concatenate(pairs)
            pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
            new = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)]) if len(pairs) else np.empty(0, bool)
            pairs = pairs[new]
            out.append(np.concatenate([np.zeros((len(pairs), 1), np.int64), pairs], 1))
        found = np.concatenate(out)
        return pa.table([pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1]), pa.array(found[:, 2])], schema=FOUND)

    return scanned.filter("part >= 0").groupBy("part").applyInArrow(meet, "kind int, a long, b long")


def _pool(source: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """digest, n, hard and packed text of the chosen nodes (id, h, digest, n, hard).

    A row is found by its id and its text's hash, so only rows that repeat both come more than once; they fold.
    """
    zipped = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("z", pa.binary())])
    pooled = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("hard", pa.bool_()), ("z", pa.binary())])

    def squeeze(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield _rows(zipped, [b.column(0), b.column(1), [c.compress((t.as_py() or "").encode()) for t in b.column(2)]])

    def right_ones(batches):
        for b in batches:
            rows = []
            for digest, n, hard, z in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                u = shingles(zstandard.ZstdDecompressor().decompress(z), shingle)
                if hashlib.blake2b(u.tobytes(), digest_size=16).digest() == digest:  # else a text of one id that shares a hash
                    rows.append((digest, n, hard, z))
            if rows:
                yield _rows(pooled, zip(*rows, strict=True))

    joined = source.mapInArrow(squeeze, "id long, h long, z binary").join(reps, ["id", "h"]).select("digest", "n", "hard", "z")
    return joined.mapInArrow(right_ones, "digest binary, n long, hard boolean, z binary").dropDuplicates(["digest"])


def _combination_index(hard: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """sig, digest, n, rare (number of rare tokens): the extended prefixes of the documents that rare tokens don't settle."""
    token_rows = pa.schema([("digest", pa.binary()), ("token", pa.int64())])
    sig_rows = pa.schema([("sig", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("rare", pa.int64())])

    def explode(batches):
        for b in batches:
            for digest, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = (shingles(zstandard.ZstdDecompressor().decompress(z), shingle) >> np.uint64(16)).astype(np.int64)
                yield _rows(token_rows, [[digest] * len(t), t])

    def sign(batches):
        for b in batches:
            for digest, n, z, common in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                t = shingles(zstandard.ZstdDecompressor().decompress(z), shingle) >> np.uint64(16)
                is_frequent = np.isin(t, np.array(common or [], np.uint64))
                s = signatures(t, is_frequent, threshold)
                yield _rows(sig_rows, [s, [digest] * len(s), [n] * len(s), [int((~is_frequent).sum())] * len(s)])

    tokens = hard.select("digest", "z").mapInArrow(explode, "digest binary, token long")
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > RARE).select("token")
    common = tokens.join(frequent, "token").groupBy("digest").agg(F.collect_list("token").alias("common"))  # a document's tokens at most
    return hard.join(common, "digest", "left").select("digest", "n", "z", "common").mapInArrow(sign, "sig long, digest binary, n long, rare long")


def _compared(pairs: DataFrame, pool: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs of digests a, b with their common tokens and whether they link."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("common", pa.int64()), ("linked", pa.bool_())])

    def compare(batches):
        sets = {}

        def of(digest, z):
            if digest not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[digest] = shingles(zstandard.ZstdDecompressor().decompress(z), shingle)
            return sets[digest]

        for batch in batches:
            rows = []
            for a, b, za, zb in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = of(a, za), of(b, zb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                rows.append((common, common > 0 and 100 * common >= percent * (len(x) + len(y) - common)))
            if rows:
                yield _rows(schema, [batch.column(0), batch.column(1), *zip(*rows, strict=True)])
        sets.clear()
        release()

    left, right = pool.select(F.col("digest").alias("a"), F.col("z").alias("za")), pool.select(F.col("digest").alias("b"), F.col("z").alias("zb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(compare, "a binary, b binary, common long, linked boolean")


def _across(signed: DataFrame, compared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b that share a signature, may link, and are in different components so far.

    A rare token has at most RARE documents, so those meet as they are. Documents that meet by frequent tokens meet
    once for each leader they share, whatever number of signatures brought them to it, and only those outside the
    leader's component look for partners. With a leader L, x and y have at most
    min(|x & L|, |y & L|) + min(other frequent tokens of x, of y) + rare tokens of L in common.
    """
    label = labels.withColumnRenamed("node", "digest")
    placed = lambda df: df.join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    sides = lambda df, cols: [df.select(*[c for c in df.columns if c not in cols], *[F.col(c).alias(f"{c}{k}") for c in cols]) for k in (1, 2)]
    ordered = lambda df: df.select(F.least("digest1", "digest2").alias("a"), F.greatest("digest1", "digest2").alias("b"))

    singles = placed(signed.filter(F.col("sig") < PAIRS).select("sig", "digest", "n"))
    one, two = sides(singles, ["digest", "n", "label"])
    rare = one.join(two, "sig").filter((F.col("label1") < F.col("label2")) & close(F.col("n1"), F.col("n2"), percent))

    members = signed.filter(F.col("sig") >= PAIRS).select(F.col("leader.digest").alias("leader"), F.col("leader.rare").alias("extra"), "digest", "n", "rare").distinct()
    with_leader = compared.select(F.col("a").alias("digest"), F.col("b").alias("leader"), "common").unionByName(compared.select(F.col("b").alias("digest"), F.col("a").alias("leader"), "common"))
    members = members.join(with_leader, ["leader", "digest"], "left").withColumn("common", F.when(F.col("leader") == F.col("digest"), F.col("n")).otherwise(F.col("common")))
    other = F.col("n") - F.col("common") - F.col("rare")
    members = placed(members.withColumns({"common": F.coalesce("common", "n"), "other": F.coalesce(other, F.col("n"))}))
    members = materialize(members, "join-members")
    files = -(-members.count() // 200_000) or 1
    # tables of their own, so that AQE can split the joins of a leader with many documents
    most = materialize(members.groupBy("leader").agg(F.max("other").alias("most"), F.max(F.when(F.col("leader") == F.col("digest"), F.col("label"))).alias("home"), F.min("label").alias("lo"), F.max("label").alias("hi")).coalesce(files), "join-leaders")
    enough = lambda common, n1, n2: common * (100 + percent) >= (n1 + n2) * percent
    apart = members.join(most.filter("lo <> hi"), "leader").filter(~F.col("label").eqNullSafe(F.col("home")))
    apart = apart.filter(enough(F.col("common") + F.least("other", "most") + F.col("extra"), F.col("n"), F.col("n") * (percent / 100)))
    apart = materialize(apart, "join-apart")
    # sizes that may link are of one class or of neighbouring ones, so a leader's documents meet by class
    width = max(0.01, 1.0001 * float(np.log(100 / percent)))
    of_size = F.floor(F.log(F.col("n")) / F.lit(width))
    apart = apart.withColumn("class", F.explode(F.array(of_size - 1, of_size, of_size + 1)))
    one = apart.select("leader", "class", "extra", "home", *[F.col(c).alias(f"{c}1") for c in ("digest", "n", "rare", "label", "common", "other")])
    two = members.withColumn("class", of_size).select("leader", "class", *[F.col(c).alias(f"{c}2") for c in ("digest", "n", "rare", "label", "common", "other")])
    bound_ = F.least("common1", "common2") + F.least("other1", "other2") + F.col("extra")
    met = one.join(two, ["leader", "class"]).filter((F.col("label1") != F.col("label2")) & may_link(F.lit(PAIRS), F.col("n1"), F.col("rare1"), F.col("n2"), F.col("rare2"), percent) & enough(bound_, F.col("n1"), F.col("n2")))
    return ordered(rare).unionByName(ordered(met)).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, shingle: int = 5) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (the smallest id that its links reach). See jaccard_groups()."""
    return jaccard_groups(docs, id_col, text_col, threshold, shingle).select(id_col, "n_shingles", "component_id")


def text_key(text: Column) -> Column:
    """What tells rows of one id apart in jaccard_groups()."""
    return F.xxhash64(text.cast("string"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, shingle: int = 5) -> DataFrame:
    """One row per document: id_col, text_key, n_shingles, component_id (the smallest id that its links reach), kept
    (the first row of its component by id and text_key; rows equal to it are kept too).

    Two documents link if the Jaccard similarity of their sets of `shingle`-word shingles is at least the
    threshold (a whole percentage above 0); A-Z count as a-z; fewer words are one shingle. Documents without words
    (null and empty texts too) have an empty set and link with nothing, each being its own component. Equal
    sets are linked whatever their number. Ids are whole numbers; rows with a null id link with nothing and have
    a null component_id, and are all kept; rows that repeat an id are documents of their own that share it, each with
    its own links.
    Other columns are ignored. Empty in, empty out. A very long text is one row of one task, held with its set
    (8 bytes a shingle) by one Python worker, and with its partner's in each comparison.
    """
    with small_batches(docs.sparkSession):
        return _groups(docs, id_col, text_col, threshold, shingle)


def _groups(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int) -> DataFrame:
    spark, percent = docs.sparkSession, round(threshold * 100)
    if not 1 <= percent <= 100:
        raise ValueError("threshold is from 0.01 to 1")
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("h"), text.alias("text"))
    scanned = materialize(_scan(source, threshold, shingle, parts_of(docs, text_col)), "join-scan")
    sizes = _sizes(scanned)
    found = materialize(_single_index(scanned), "join-singles")

    frequent = found.filter("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("f"))
    lacks = F.col("n") - F.ceil(F.round(F.col("n") * F.lit(threshold), 6))
    nodes = sizes.filter("id is not null and n > 0").groupBy("digest").agg(F.min_by("h", "id").alias("h"), *[F.min(c).alias(c) for c in ("id", "n", "q", "node")])
    nodes = nodes.join(frequent, "node", "left").withColumn("hard", F.col("q") - F.coalesce("f", F.lit(0)) <= lacks)
    nodes = materialize(nodes.select("node", "digest", "n", "hard", "id", "h"), "join-nodes")
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("digest").alias(f"d{c}"), F.col("n").alias(f"n{c}"))
    near = found.filter("kind = 0").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").filter(close(F.col("na"), F.col("nb"), percent) & (F.col("da") != F.col("db")))
    pairs = materialize(near.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b")).distinct(), "join-pairs")
    wanted = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).unionByName(nodes.filter("hard").select("digest")).distinct()
    pool = materialize(_pool(source, nodes.drop("node").join(wanted, "digest"), shingle), "join-pool")

    signed = materialize(_combination_index(pool.filter("hard"), threshold, shingle), "join-combinations")
    # the leader has the fewest rare tokens: of near copies, the one that least was changed in
    least = signed.groupBy("sig").agg(F.min(F.struct("rare", "n", "digest")).alias("leader"), F.min("n").alias("n0"), F.count(F.lit(1)).alias("df")).filter("df > 1").drop("df")
    # of a pair's documents only those that enough frequent tokens let link with a partner as small as can be
    partner = F.greatest(F.col("n0") * 100, F.col("n") * percent)
    able = (F.col("sig") < PAIRS) | ((F.col("n") - F.col("rare")) * (100 + percent) * 100 >= (F.col("n") * 100 + partner) * percent)
    signed = materialize(signed.join(least, "sig").filter(able).select("sig", "digest", "n", "rare", "leader"), "join-able")
    shared = signed.filter((F.col("digest") != F.col("leader.digest")) & may_link(F.col("sig"), F.col("n"), F.col("rare"), F.col("leader.n"), F.col("leader.rare"), percent))
    star = shared.select(F.least("digest", "leader.digest").alias("a"), F.greatest("digest", "leader.digest").alias("b"))
    compared = materialize(_compared(pairs.unionByName(star).distinct(), pool, percent, shingle), "join-compared")
    links = compared.filter("linked").select("a", "b")
    labels = components(links)
    across = _across(signed, compared, labels, percent).join(compared.select("a", "b"), ["a", "b"], "left_anti")
    more = materialize(_compared(across, pool, percent, shingle).filter("linked").select("a", "b"), "join-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    discard(found, nodes, pairs, pool, signed, compared, more)

    placed = sizes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("key", F.coalesce("label", "digest")).select("id", "h", "n", "key")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    # a table of its own, so that AQE can split the join of a component with many documents
    first = materialize(placed.filter(~alone).groupBy("key").agg(F.min(F.struct("id", "h")).alias("first")), "join-smallest")
    linked = placed.filter(~alone).join(first, "key").select("id", "h", "n", F.col("first.id").alias("component_id"), (F.struct("id", "h") == F.col("first")).alias("kept"))
    rest = placed.filter(alone).select("id", "h", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(rest).select(F.col("id").alias(id_col), F.col("h").alias("text_key"), F.col("n").alias("n_shingles"), "component_id", "kept")
