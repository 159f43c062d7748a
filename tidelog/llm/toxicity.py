"""Toxicity: a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel counts common character subsequences of length 3 and 4, of a span up to 6 and 7, each occurrence
weighted by decay ** span, so that characters inserted into an insult ("id.i-ot") or missing ones cost some
weight and no more. It compares windows: the subsequences that begin at WIDTH neighbouring characters of a text,
whatever words those belong to; letters spelled out one by one are joined and read once more. A text is as toxic as
its worst window. Of labelled texts the machine learns from the window that decides each (multiple-instance
training): from the worst one of a toxic text, and from the worst and some other ones of a clean text.

Nyström: windows are seen through their kernel values with landmarks, which are sentences of the labelled texts (or
the part of one around the deciding window). The decision is linear in those values, and those are linear in the
subsequence weights of a window, so the trained machine folds into one table of weights by hashed subsequence: each
character's share is looked up, and running sums give all windows of a text, whatever the number of landmarks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.shared import release
from tidelog.session import discard, materialize

#: Places of a window, bits of a subsequence's hash, weight of each character that a subsequence spans.
WIDTH, BITS, DECAY = 6, 17, 0.7
#: Characters after its start that a subsequence reaches at most; characters of a landmark at most.
REACH, SENTENCE = 6, 32
#: Characters that are scored at a time.
BLOCK = 1 << 16
SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][\s.\-_*]+){3,}[^\W\d_](?!\S)")
SENTENCE_ENDS = re.compile(r"[.!?]+\s")


def prepared(text: str | None) -> str:
    """Lower case, runs of white space as one space, spelled-out words joined and added; empty without words."""
    text = (text or "").lower().replace("\0", " ")
    joined = [re.sub(r"[\s.\-_*]+", "", m) for m in SPELLED.findall(text)]
    found = " ".join([*text.split(), *joined])
    return f" {found} " if found else ""


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each subsequence shape, its span and the hashes of the subsequences that begin at each place.

    codes end with REACH zeros at least; a subsequence that takes in a zero isn't one, see valid(). Shapes share
    their beginnings: three characters are hashed on the way to four.
    """
    n = len(codes) - REACH
    with np.errstate(over="ignore"):
        x = codes * np.uint32(0x9E3779B1) ^ codes << np.uint32(7)
        one = x[:n] * np.uint32(0x85EBCA77)
        shift = np.uint32(32 - BITS)
        for a in range(1, 5):
            two = (one + x[a : a + n]) * np.uint32(0xC2B2AE3D)
            for b in range(a + 1, 6):
                three = (two + x[b : b + n]) * np.uint32(0x27D4EB2F)
                three ^= three >> np.uint32(15)
                yield b + 1, three >> shift
                for c in range(b + 1, REACH + 1):
                    yield c + 1, (three + x[c : c + n]) * np.uint32(0x165667B1) >> shift


SPANS = [span for span, _ in hashed(np.zeros(REACH + 1, np.uint32))]


def valid(codes: np.ndarray, span: int) -> np.ndarray:
    """Whether the subsequences of a span that begin at each place stay within their text."""
    n = len(codes) - REACH
    return (codes[:n] != 0) & (codes[span - 1 : span - 1 + n] != 0)


def place_scores(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each place, the weights in table of the subsequences that begin there."""
    sums = {span: np.zeros(len(codes) - REACH, np.float32) for span in set(SPANS)}
    for span, at in hashed(codes):
        sums[span] += table[at]
    out = np.zeros(len(codes) - REACH, np.float64)
    for span, total in sums.items():
        out += np.where(valid(codes, span), total * np.float32(DECAY**span), 0)
    return out


#: What a full window's own subsequences weigh; windows that a text's end cuts off are measured by the same.
NORM = float(np.sqrt(WIDTH * sum(DECAY ** (2 * span) for span in SPANS)))


def window_scores(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of the window that begins at each place, its decision value. Texts are WIDTH + REACH zeros apart at least."""
    total = np.concatenate([[0.0], np.cumsum(place_scores(codes, table))])
    n = len(codes) - REACH - WIDTH
    return (total[WIDTH : WIDTH + n] - total[:n]) / NORM


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Codes of some texts with zeros between; of each piece its text's number, its place there, where it begins in its
    text, and how many windows begin in it.

    A text longer than a block comes in pieces that overlap by what a window reaches, so every window is whole in one.
    """
    gap = np.zeros(WIDTH + REACH, np.uint32)
    held, pieces, used = [], [], 0
    for i, t in enumerate(texts):
        codes = codes_of(t)
        for at in range(0, len(codes), size):
            piece = codes[at : at + size + WIDTH + REACH]
            if used and used + len(piece) > size:
                yield np.concatenate(held), pieces
                held, pieces, used = [], [], 0
            held += [piece, gap]
            pieces.append((i, used, at, min(size, len(codes) - at)))
            used += len(piece) + len(gap)
    if held:
        yield np.concatenate(held), pieces


def worst_windows(texts: list[str], table: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Decision value of each text's worst window and where that begins; -inf for texts without words."""
    best, where = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
    for codes, pieces in blocks(texts, size):
        scores = window_scores(codes, table)
        for i, place, at, n in pieces:
            own = scores[place : place + n]
            if own.max() > best[i]:
                best[i], where[i] = own.max(), int(own.argmax()) + at
    return best, where


def rows_of(strings: list[str], width: int) -> np.ndarray:
    """Codes of strings, a row each: `width` places and what they reach, zeros after the end."""
    padded = "".join(s[: width + REACH].ljust(width + REACH, "\0") for s in strings)
    return codes_of(padded).reshape(len(strings), width + REACH)


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the subsequences of each row, [rows, places x shapes]."""
    n = codes.shape[1] - REACH
    flat = np.concatenate([codes.ravel(), np.zeros(REACH, np.uint32)])
    at, weight = [], []
    for span, h in hashed(flat):
        inside = (codes[:, :n] != 0) & (codes[:, span - 1 : span - 1 + n] != 0)
        at.append(h.reshape(codes.shape)[:, :n])
        weight.append(np.where(inside, np.float32(DECAY**span), np.float32(0)))
    return np.concatenate(at, 1).astype(np.int64), np.concatenate(weight, 1)


def landmark_table(landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence weights of the landmarks, [2 ** BITS, landmarks]."""
    table = np.zeros((1 << BITS, len(landmarks)), np.float32)
    for j, s in enumerate(landmarks):
        at, weight = features(rows_of([s], max(1, len(s))))
        np.add.at(table[:, j], at[0], weight[0] / max(1e-9, float(np.sqrt((weight * weight).sum()))))
    return table


def kernel_rows(windows: list[str], table: np.ndarray, block: int = 128) -> np.ndarray:
    """Kernel values of windows with the landmarks of a table."""
    out = [np.empty((0, table.shape[1]), np.float32)]
    for a in range(0, len(windows), block):
        at, weight = features(rows_of(windows[a : a + block], WIDTH))
        out.append(np.einsum("rpm,rp->rm", table[at], weight, optimize=True) / np.float32(NORM))
    return np.concatenate(out)


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, block: int = 4_096) -> tuple[np.ndarray, float]:
    """Primal L2-loss support vector machine by Newton steps; y is +1 or -1. Sums go block by block, in double precision."""
    m = x.shape[1] + 1
    w, ridge = np.zeros(m), np.eye(m)
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        h, g = ridge.copy(), np.zeros(m)
        for a in range(0, len(x), block):
            xb = np.hstack([x[a : a + block], np.ones((len(x[a : a + block]), 1), x.dtype)]).astype(np.float64)
            active = y[a : a + block] * (xb @ w) < 1
            xb, wb = xb[active], c * weight[a : a + block][active]
            h += (xb * wb[:, None]).T @ xb
            g += (wb * y[a : a + block][active]) @ xb
        new = np.linalg.solve(h, g)
        done, w = np.abs(new - w).max() < 1e-6, new
        if done:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, clean_weight: float = 1.0) -> tuple[float, float]:
    """One-variable logistic fit, by Newton steps with a small ridge; the clean class as a whole weighs clean_weight toxic ones."""
    mean, sd = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mean) / sd, np.ones(len(x))], 1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 * clean_weight / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (weight * (p - y)) + 1e-2 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / sd), float(w[1] - w[0] * mean / sd)


class Model:
    """Weights by hashed subsequence, and the logistic map from a text's worst window to a score.

    The table is the sum of the landmarks' normalised subsequence weights, each times its `beta`.
    """

    def __init__(self, table: np.ndarray, slope: float, offset: float, landmarks: list[str] | None = None, beta: np.ndarray | None = None):
        self.table, self.slope, self.offset, self.landmarks, self.beta = table, slope, offset, landmarks or [], beta

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """One score a text. A text without words has the lowest."""
        worst, _ = worst_windows([prepared(t) for t in texts], self.table)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum(worst, -1e3) + self.offset, -40, 40)))


def constant(share: float) -> Model:
    """Where there is one class, or none: one score for all."""
    return Model(np.zeros(1 << BITS, np.float32), 0.0, -4.0 if share < 0.5 else 4.0)


def sentence_around(text: str, at: int) -> str:
    """The sentence in which a window begins, or the part of it around the window."""
    ends = [m.end() for m in SENTENCE_ENDS.finditer(text)]
    a = max([e for e in ends if e <= at], default=0)
    b = min([e for e in ends if e > at], default=len(text))
    a = max(a, at + WIDTH // 2 - SENTENCE // 2)
    return text[a : min(b, a + SENTENCE)]


def presence(texts: list[str]) -> np.ndarray:
    """In how many of the texts each hashed subsequence is."""
    found = np.zeros(1 << BITS, np.uint32)
    for t in texts:
        here = np.zeros(1 << BITS, bool)
        for codes, _ in blocks([t]):
            for span, at in hashed(codes):
                here[at[valid(codes, span)]] = True
        found += here
    return found


def prior_table(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Log odds of a text being toxic by each subsequence alone, drawn to 0 where few texts have it."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    behind = np.where(odds > 0, toxic, clean)
    return (odds * behind / (behind + 3)).astype(np.float32)


def candidates(rid: str, text: str, toxic: bool, table: np.ndarray, others: int) -> list[tuple[str, str, float]]:
    """Window, sentence and decision value of a text's worst window; of a clean text also of its next worst and some others."""
    if not text:
        return []
    value, where = worst_windows([text], table)
    picked = [int(where[0])]
    if not toxic:
        codes, _ = next(blocks([text], 1 << 30))
        scores = window_scores(codes, table)[: len(text)].copy()
        for _ in range(others):
            scores[max(0, picked[-1] - WIDTH) : picked[-1] + WIDTH] = -np.inf
            if not np.isfinite(scores).any():
                break
            picked.append(int(scores.argmax()))
        seed = zlib.crc32(rid.encode())
        picked += [(seed * (i + 1) * 2654435761 >> 7) % len(text) for i in range(others)]
    return [(text[p : p + WIDTH + REACH], sentence_around(text, p), float(value[0]) if i == 0 else -np.inf) for i, p in enumerate(picked)]


def machine(found: list[tuple[str, int, str, str, float]], n_landmarks: int, c: float) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Table, landmarks and their coefficients from candidates (id, label, window, sentence, value)."""
    ranked = {y: sorted({s: -v for _, label, _, s, v in found if label == y}.items(), key=lambda x: (zlib.crc32(x[0].encode()), x[0])) for y in (1, 0)}
    # toxic sentences whose windows stand out, and clean ones as they come
    share = n_landmarks * 3 // 4
    worst = sorted(ranked[1], key=lambda x: (x[1], x[0]))[: 3 * share]
    landmarks = [s for s, _ in worst[:: max(1, len(worst) // share)]][:share] + [s for s, _ in ranked[0][: n_landmarks - share]]
    basis = landmark_table(landmarks)
    k = (basis.T @ basis).astype(np.float64)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    keep = values > 1e-3 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    counts: dict[tuple[str, int], int] = {}
    for _, y, window, _, _ in found:
        counts[window, y] = counts.get((window, y), 0) + 1
    rows = sorted(counts)
    y = np.array([1.0 if label else -1.0 for _, label in rows])
    weight = np.log1p(np.array([counts[r] for r in rows], np.float64))
    weight *= np.where(y > 0, len(y) / 2 / weight[y > 0].sum(), len(y) / 2 / weight[y < 0].sum())
    w, _ = svm(kernel_rows([window for window, _ in rows], basis) @ whiten.astype(np.float32), y, weight, c)
    beta = whiten @ w
    return (basis @ beta.astype(np.float32)), landmarks, beta


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text. 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_texts: int) -> DataFrame:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter((fold(F.col("id")) != 0) & F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    half = lambda y: known.filter(F.col("y") == y).orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_texts // 2)
    chosen = half(1).unionByName(half(0))  # max_texts rows at most
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    return texts.groupBy("id", "y").agg(F.min_by("text", F.coalesce(F.md5("text"), F.lit(""))).alias("text")).select(F.col("id").cast("string").alias("id"), "y", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_texts: int = 6_000, n_landmarks: int = 384, rounds: int = 5, others: int = 4, c: float = 1.0, clean_weight: float = 1.5) -> Model:
    """Train on at most max_texts labelled texts, half of each class, in the order of md5(id), none of them held out.

    Rows with a null label or id teach nothing; an id that repeats counts once, with its largest label and the text of
    the smallest digest. A clean text counts clean_weight toxic ones where the score is drawn from the worst window.
    Without both classes the model gives every text one score. Texts stay on the executors,
    whatever their length: of each round the driver gets 1 + 2 * others windows a text, and of the first one a count of
    subsequences a task.
    """
    sample = materialize(_sample(docs, labels, id_col, text_col, label_col, max_texts), "toxicity-sample")
    spark = sample.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = [0, 0], np.zeros((2, 1 << BITS), np.uint32)
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                n[y] += 1
                found[y] += presence([prepared(t.as_py())])
        if sum(n):
            yield pa.record_batch([pa.array([n[0]], pa.int64()), pa.array([n[1]], pa.int64()), pa.array([zstandard.compress(found.tobytes())], pa.binary())], names=["clean", "toxic", "found"])
        del found
        release()

    seen, n = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for r in sample.mapInArrow(counted, "clean long, toxic long, found binary").toLocalIterator():  # a row a task
        seen += np.frombuffer(zstandard.decompress(bytes(r.found)), np.uint32).reshape(2, -1)
        n = [n[0] + r.clean, n[1] + r.toxic]
    if not all(n):
        discard(sample)
        return constant(n[1])
    table = prior_table(seen[1], seen[0], n[1], n[0])

    def picked(table: np.ndarray) -> list[tuple[str, int, str, str, float]]:
        shared = spark.sparkContext.broadcast(table)  # of fixed size

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(rid, y, *x) for rid, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True) for x in candidates(rid, prepared(t.as_py()), bool(y), shared.value, others)]
                if rows:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["id", "y", "window", "sentence", "value"])
            release()

        rows = sample.mapInArrow(pick, "id string, y int, window string, sentence string, value double").toArrow().to_pylist()
        shared.unpersist()
        return sorted(tuple(r.values()) for r in rows)

    found = picked(table)
    for _ in range(rounds):
        if len({y for _, y, *_ in found}) < 2:  # a class without words
            discard(sample)
            return constant(n[1] / sum(n))
        table, landmarks, beta = machine(found, n_landmarks, c)
        found = picked(table)
    discard(sample)
    worst = [(v, y) for _, y, _, _, v in found if np.isfinite(v)]
    slope, offset = logistic(np.array([v for v, _ in worst]), np.array([y for _, y in worst]), clean_weight)
    return Model(table, slope, offset, landmarks, beta)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1), predicted (score >= 0.5).

    Null and empty texts have the lowest score. Rows are independent, so rows that repeat an id or a text each get their
    score; other columns are ignored; empty in, empty out. A very long text is scored in pieces that overlap, by the
    task that holds it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.slope, model.offset))  # of fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(m.scores(t.as_py() for t in b.column(2)), pa.float64())], names=["id", "held_out", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text")).mapInArrow(scored, f"id {id_type}, held_out boolean, score double")
    return rows.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
