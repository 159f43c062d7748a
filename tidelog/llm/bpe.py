"""BPE encoding and decoding over a table of distinct words.

Tokenizers of the kind that is taken here never join text across ASCII white space, so a text's ids are its words' ids
in order, and a word needs to be encoded once however often it occurs.

1. Each task splits its texts (by an Arrow kernel, on whole columns) and numbers their distinct words, a chunk of
   bounded size at a time. A chunk leaves as one row with its documents as sequences of word numbers, and one row for each hash part
   with the words of that part. Frequent words cost a chunk one entry, so no word is hot. Documents and words are
   written once, in one pass, in buckets by home: a few chunks of a task, which make one file.
2. Each part of the distinct-word table meets the chunks' words of that part, encodes each once, and answers every
   chunk with ids in the order of its words.
3. A home's answers come to its documents, which stay in their bucket, and ids go to their places by word number.

Decoding joins ids with the id-to-piece table: the vocabulary, a column of fixed size, which every task gets.
A chunk whose answers are missing fails instead of passing.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import parts_of, release, small_batches
from tidelog.session import work_path

#: home: what is written and comes together as one, a few chunks of one task.
ROW = "home string, chunk int, part int, payload binary"
ARROW_ROW = pa.schema([("home", pa.string()), ("chunk", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays and byte strings in one compressed blob; integers are laid out by byte planes."""
    heads, bodies = [], []
    for a in arrays:
        if isinstance(a, np.ndarray):
            heads.append([a.dtype.str, len(a)])
            bodies.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
        else:
            heads.append(["", len(a)])
            bodies.append(a)
    head = json.dumps(heads).encode()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([len(head).to_bytes(4, "little"), head, *bodies]))


def unpack(blob: bytes) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for kind, length in json.loads(raw[4:at]):
        size = length * (np.dtype(kind).itemsize if kind else 1)
        body = raw[at : at + size]
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(np.dtype(kind).itemsize, length).T).view(kind).reshape(length) if kind else body)
        at += size
    return out


class Chunk:
    """Documents of bounded size as words, numbered by falling frequency."""

    def __init__(self, id_type: pa.DataType):
        self.id_type, self.ids, self.flat, self.lengths, self.bytes = id_type, [], [], [], 0

    def add(self, ids: pa.Array, words: pa.ListArray) -> None:
        flat = words.flatten()
        self.ids.append(ids)
        self.flat.append(flat)
        self.lengths.append(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.uint32))
        self.bytes += flat.nbytes

    def rows(self, n_parts: int) -> Iterator[tuple[int, bytes]]:
        """The row of its documents (part -1), then one for each part of its distinct words."""
        coded = pa.chunked_array(self.flat, pa.string()).combine_chunks().dictionary_encode()
        number, names = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
        order = np.argsort(-np.bincount(number, minlength=len(names)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = [names[i] for i in order.tolist()]
        parts = np.fromiter((zlib.crc32(w) % n_parts for w in words), np.int32, len(words))
        sink = pa.BufferOutputStream()
        ids = pa.chunked_array(self.ids, self.id_type).combine_chunks()
        with pa.ipc.new_stream(sink, pa.schema([("id", self.id_type)])) as w:
            w.write_batch(pa.record_batch([ids], names=["id"]))
        yield -1, pack(sink.getvalue().to_pybytes(), np.concatenate(self.lengths), parts, rank[number])
        by_part = np.argsort(parts, kind="stable")
        ends = np.searchsorted(parts[by_part], np.arange(n_parts + 1))
        for p in range(n_parts):
            if ends[p] < ends[p + 1]:
                yield p, zstandard.ZstdCompressor(level=3).compress(b"\n".join([words[i] for i in by_part[ends[p] : ends[p + 1]].tolist()]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_ROW.types, strict=True)], schema=ARROW_ROW)


def _tokenizer(content: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(content)
    t.no_truncation()
    t.no_padding()
    return t


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file; ValueError if it isn't of the kind that goes word by word.

    That kind has a BPE model without a decoder, normalises character by character, never takes white space into a
    token and lets no added token reach across it; probes of two words over white space check what the parts say.
    """
    with open(path, encoding="utf-8") as f:
        content = f.read()
    spec = json.loads(content)
    several = lambda part, key: [] if part is None else [y for x in part[key] for y in several(x, key)] if part["type"] == "Sequence" else [part]
    wrong = [x["type"] for x in several(spec.get("normalizer"), "normalizers") if x["type"] not in ("NFC", "NFD", "Lowercase") and not (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ")]
    wrong += [t["content"] for t in spec.get("added_tokens", []) if t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])]
    wrong += [spec["decoder"]["type"]] if spec.get("decoder") else []
    wrong += [spec["model"].get("type")] if spec["model"].get("type") != "BPE" or spec["model"].get("dropout") else []
    if not wrong:
        t, probes = _tokenizer(content), ["don't", "Ab1", "x,", "é", "'", "9", "</w>", "\u0301a", "a\u00a0b"]
        of = {w: t.encode(w, add_special_tokens=False).ids for w in probes}
        texts = {f"{a}{gap}{b}": of[a] + of[b] for a in probes for b in probes for gap in (" ", "\n", "\t\r", "\x0b \x0c")}
        wrong = [x for x, ids in texts.items() if t.encode(f" {x}\n", add_special_tokens=False).ids != ids][:3]
    if wrong:
        raise ValueError(f"{path} doesn't go word by word: {wrong}")
    return content


def pieces_by_id(content: str) -> list[str | None]:
    """The id-to-piece table of a tokenizer file; null for ids without a piece."""
    spec = json.loads(content)
    names = {i: p for p, i in spec["model"]["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
    return [names.get(i) or None for i in range(max(names, default=-1) + 1)]


def _written(source: DataFrame, parts: int, chunk_bytes: int, chunks_of_home: int, id_type: pa.DataType) -> DataFrame:
    """The chunks of (id, text) as a table in buckets by home."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, home, number = Chunk(id_type), uuid.uuid4().hex, 0  # written once, so a name has to be new and nothing else
        for batch in batches:
            text, begin = batch.column(1), 0
            sizes = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
            while begin < batch.num_rows:  # a batch may be many times a chunk
                done = int(sizes[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sizes, done + chunk_bytes - chunk.bytes)))
                words = pc.ascii_split_whitespace(text.slice(begin, end - begin))  # an empty first or last word has no ids
                chunk.add(batch.column(0).slice(begin, end - begin), words)
                begin = end
                if chunk.bytes >= chunk_bytes:
                    yield from (_batch([(home, number, *r)]) for r in chunk.rows(parts))
                    chunk, number = Chunk(id_type), number + 1
                    if number == chunks_of_home:
                        home, number = uuid.uuid4().hex, 0
        if chunk.ids:
            yield from (_batch([(home, number, *r)]) for r in chunk.rows(parts))
        del chunk
        release()

    spark, path, name = source.sparkSession, work_path(source.sparkSession, "bpe-chunks"), f"tidelog_{uuid.uuid4().hex}"
    with small_batches(spark):
        source.mapInArrow(emit, ROW).write.format("parquet").option("path", path).option("parquet.block.size", 4 * chunk_bytes).bucketBy(parts, "home").saveAsTable(name)
    found = spark.table(name).select("home", "chunk", "part", "payload")
    found.schema  # resolved, so the name can go; the files are in the work folder
    spark.sql(f"DROP TABLE {name}")
    return found


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, n_parts: int | None = None, chunks_of_home: int = 4) -> DataFrame:
    """One row per document: id_col, n_tokens and ids, as the tokenizer encodes the whole text without special tokens.

    Null and empty texts have no ids. Ids may be null or repeat; each row is encoded. Other columns are
    ignored. An empty table gives an empty result. The table is read once. A very long text is a chunk of its own,
    which one task holds with its words' numbers and ids. A tokenizer file of another kind is a ValueError.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    content = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # as large as the vocabulary
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    parts = n_parts or parts_of(docs, text_col)
    chunks = _written(source, parts, chunk_bytes, chunks_of_home, to_arrow_type(kind))
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = _tokenizer(content.value), {b"": b""}  # the words of one part
        for batch in batches:
            for home, chunk, part, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = zstandard.ZstdDecompressor().decompress(payload).split(b"\n")
                new = [w for w in words if w not in known]
                for w, e in zip(new, tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False), strict=True):
                    known[w] = np.array(e.ids, np.uint32).tobytes()
                answers = [known[w] for w in words]
                yield _batch([(home, chunk, part, pack(np.array([len(a) // 4 for a in answers], np.uint32), np.frombuffer(b"".join(answers), np.uint32)))])
        del known
        release()

    def placed(documents: pa.Table, answers: pa.Table) -> pa.Table:
        found = dict(zip(zip(answers["chunk"].to_pylist(), answers["part"].to_pylist(), strict=True), answers["payload"].to_pylist(), strict=True))
        out = []
        for chunk, blob in zip(documents["chunk"].to_pylist(), documents["payload"].to_pylist(), strict=True):
            ids, lengths, of, flat = unpack(blob)
            count, start, pieces, base = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), [], 0
            order = np.argsort(of, kind="stable")
            parts_here, cuts = np.unique(of[order], return_index=True)
            for p, mine in zip(parts_here.tolist(), np.split(order, cuts[1:]), strict=True):
                counts, got = unpack(found[chunk, p])
                if len(counts) != len(mine):
                    raise RuntimeError("a chunk's words and answers differ")
                count[mine] = counts
                start[mine] = base + np.cumsum(counts, dtype=np.int64) - counts
                pieces.append(got)
                base += len(got)
            values = np.concatenate([*pieces, np.empty(0, np.uint32)]).astype(np.int32)
            n = count[flat]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            at = np.repeat((start[flat] - ends + n).astype(np.int32), n)
            at += np.arange(total, dtype=np.int32)
            tokens = values[at]
            del at, n
            stops = np.concatenate([[0], ends])[np.cumsum(lengths, dtype=np.int64)]
            offsets = np.concatenate([[0], stops]).astype(np.int32)
            with pa.ipc.open_stream(ids) as reader:
                doc_ids = reader.read_all()["id"].combine_chunks()
            out.append(pa.table([doc_ids, pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(offsets, tokens)], schema=schema))
            del ends, tokens, flat
        release()
        return pa.concat_tables(out) if out else schema.empty_table()

    # one part at a time, so that what a task knows of words is bounded by a part's share
    answers = chunks.filter("part >= 0").groupBy("part").applyInArrow(_all_columns(encoded), ROW)
    both = chunks.filter("part < 0").groupBy("home").cogroup(answers.groupBy("home"))
    return both.applyInArrow(placed, f"`{id_col}` {kind.simpleString()}, n_tokens long, ids array<int>")


def _all_columns(f):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(b.select(ARROW_ROW.names) for b in batches)

    return run


def joined_pieces(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """Of each list of ids the text: ids find their pieces by position, and pieces are joined by a space."""
    flat = ids.flatten()
    known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(pieces))), flat, None)
    found = pieces.take(known)
    stops = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    if found.null_count:
        stops = np.concatenate([[0], np.cumsum(found.is_valid().to_numpy(zero_copy_only=False), dtype=np.int64)])[stops]
        found = found.drop_null()
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), found), " ")
    return pc.if_else(ids.is_valid(), text, None)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """id_col and the text of each row's ids: pieces joined by a space, as for tokenizers without a decoder.

    Null ids give a null text, no ids an empty one. Ids outside the vocabulary (null ones too) have no piece and are
    left out. Rows are independent; other columns are ignored. Empty in, empty out.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(pieces_by_id(read_tokenizer(tokenizer_path)))  # as large as the vocabulary
    sql = encoded.schema[id_col].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(pieces.value, pa.string())
        for batch in batches:
            for b in _slices(batch):
                yield pa.record_batch([b.column(0), joined_pieces(b.column(1), table)], names=[id_col, text_col])

    return encoded.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(texts, f"`{id_col}` {sql}, `{text_col}` string")


def encode_decode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, n_parts: int | None = None) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of what encode() gives and of what decode() makes of it.

    For edge cases see encode(): a null or empty text has the digests of the empty string.
    """
    rows = encode(docs, tokenizer_path, id_col, text_col, chunk_bytes, n_parts)
    pieces = docs.sparkSession.sparkContext.broadcast(pieces_by_id(read_tokenizer(tokenizer_path)))
    sql = docs.schema[id_col].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sha = pa.array(pieces.value, pa.string()), lambda texts: [hashlib.sha256(t.as_buffer()).hexdigest() for t in texts.cast(pa.binary())]
        for batch in batches:
            for b in _slices(batch):
                ids = b.column(2)
                lengths = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
                decimals = pc.binary_join(pa.ListArray.from_arrays(pa.array(lengths), ids.flatten().cast(pa.string())), " ")
                yield pa.record_batch([b.column(0), b.column(1), pa.array(sha(decimals), pa.string()), pa.array(sha(joined_pieces(ids, table)), pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        release()

    return rows.mapInArrow(digests, f"`{id_col}` {sql}, n_tokens long, ids_sha256 string, decoded_sha256 string")
