"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

Tokens are runs of letters, digits or symbols; case is kept as a mark, so that lower and upper case share a vector.
Words fall into 2^15 buckets by hash. A word's vector is the sum of the sparse random vectors of its neighbours over all
documents, so its size, and that of the table sent to executors, is fixed whatever the corpus holds. A document is the
mean and the spread of its words' vectors with a few counts. Labels are learnt from a bounded sample of rows (lowest
hash of the key, one row a key), everything else from all documents. Repeated rows count each time there and get equal
scores, rows without a key are scored but not learnt from, an empty table gives an empty result. A null or empty text has a defined score like any other (its
vector is zero); without labels of both classes every score is the share of label 1, or 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlspark.llm.common import column, map_batches, slices, texts, utf8

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 48
NONZERO = 2  # entries of a random vector
REACH = 2  # neighbours on either side
BATCH_BYTES = 4_000_000
SAMPLE_ROWS = 20_000  # labelled rows that the network is fitted on
PARTS = 64  # slices of the vector table that are summed apart
COUNTS = 6

LETTER, DIGIT, SYMBOL = 1, 2, 3
CLASSES = np.full(256, SYMBOL, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = 0
CLASSES[0x30:0x3A] = DIGIT
CLASSES[0x41:0x5B] = CLASSES[0x61:0x7B] = LETTER
CLASSES[0x80:] = LETTER
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)


@dataclass
class Tokens:
    bucket: np.ndarray
    starts: np.ndarray  # of each text's tokens, one more at the end
    kind: np.ndarray
    capital: np.ndarray  # all letters upper case, two at least


def tokens(strings: pa.Array) -> Tokens:
    """Buckets and marks of all tokens of texts without nulls."""
    raw, offsets = utf8(strings)
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(none, np.zeros(len(strings) + 1, np.int64), none, none.astype(bool))
    kinds = CLASSES[raw]
    change = np.ones(n, bool)
    change[1:] = kinds[1:] != kinds[:-1]
    inner = offsets[1:-1]
    change[inner[inner < n]] = True
    begin = np.flatnonzero(change)
    size = np.diff(np.append(begin, n))
    weights = np.cumprod(np.full(64, FACTOR, np.uint64))
    within = np.arange(n, dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
    digest = np.add.reduceat((FOLD[raw].astype(np.uint64) + np.uint64(1)) * weights[within & 63], begin)
    kind = kinds[begin]
    full = kind > 0
    capital = (np.add.reduceat(UPPER[raw], begin, dtype=np.int32) == size) & (size > 1)
    bucket = (_mixed(digest) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(full)])
    starts = before[np.searchsorted(begin, offsets)]
    return Tokens(bucket[full], starts, kind[full], capital[full])


def random_index() -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the nonzero entries of each bucket's random vector."""
    draws = _mixed(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(12345))
    place = (draws % np.uint64(DIMENSIONS)).astype(np.int64).reshape(BUCKETS, NONZERO)
    sign = 1.0 - 2.0 * (draws >> np.uint64(63)).astype(np.float64).reshape(BUCKETS, NONZERO)
    return place, sign


def _add_neighbours(found: Tokens, sums: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Adds to each bucket the random vectors of the tokens around it in the same text."""
    owner = np.repeat(np.arange(len(found.starts) - 1), np.diff(found.starts))
    for reach in range(1, REACH + 1):
        same = np.flatnonzero(owner[reach:] == owner[:-reach])
        for word, near in ((same, same + reach), (same + reach, same)):
            w, v = found.bucket[word] * DIMENSIONS, found.bucket[near]
            for j in range(NONZERO):
                sums += np.bincount(w + place[v, j], weights=sign[v, j], minlength=len(sums))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, DIMENSIONS) unit vectors learnt from all texts.

    Each task sums its own texts; slices of those sums are added up in as many streams as there are slices, so no task
    holds more than one table, and the driver gets one table of fixed size.
    """
    width = BUCKETS * DIMENSIONS // PARTS

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = random_index()
        sums = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches:
            strings = texts(batch)
            for a, b in slices(np.diff(utf8(strings)[1]), BATCH_BYTES):
                _add_neighbours(tokens(strings.slice(a, b - a)), sums, place, sign)
        parts = sums.astype(np.int64).reshape(PARTS, width)
        held = [i for i in range(PARTS) if parts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([parts[i].tobytes() for i in held], pa.binary())],
                                         ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(column(batch, "part").to_pylist(), column(batch, "sums")):
                whole[part] = whole.get(part, 0) + np.frombuffer(packed.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(whole), pa.int32()), pa.array([v.tobytes() for v in whole.values()], pa.binary())],
            ["part", "sums"])

    schema = "part int, sums binary"
    sums = map_batches(docs.select(docs[text].alias("text")), gather, schema)
    table = np.zeros((PARTS, width))
    for part, packed in map_batches(sums.repartition(PARTS, "part"), add, schema).collect():
        table[part] = np.frombuffer(packed, np.int64)
    table = table.reshape(BUCKETS, DIMENSIONS)
    length = np.sqrt((table**2).sum(axis=1, keepdims=True))
    return (table / np.maximum(length, 1e-9)).astype(np.float32)


def document_vectors(strings: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean and spread of its words' vectors, and counts."""
    out = np.zeros((len(strings), 2 * DIMENSIONS + COUNTS), np.float32)
    for a, b in slices(np.diff(utf8(strings)[1]), BATCH_BYTES):
        found = tokens(strings.slice(a, b - a))
        size = np.diff(found.starts)
        n = np.maximum(size, 1)[:, None]
        full = np.flatnonzero(size)
        rows = out[a:b]
        at = found.starts[:-1][full]
        again = np.zeros(len(found.bucket), bool)
        again[1:] = found.bucket[1:] == found.bucket[:-1]
        if len(full):
            for d in range(0, DIMENSIONS, 8):
                x = vectors[found.bucket, d:d + 8]
                mean = np.add.reduceat(x, at) / n[full]
                rows[full, d:d + 8] = mean
                spread = np.add.reduceat(x * x, at) / n[full] - mean**2
                rows[full, DIMENSIONS + d:DIMENSIONS + d + 8] = np.sqrt(np.maximum(spread, 0))
            marks = [found.kind == DIGIT, found.kind == SYMBOL, found.capital, again]
            for j, mark in enumerate(marks):
                rows[full, 2 * DIMENSIONS + j] = np.add.reduceat(mark, at, dtype=np.int64) / n[full, 0]
        rows[:, 2 * DIMENSIONS + 4] = np.log1p(size)
        rows[:, 2 * DIMENSIONS + 5] = size == 0
    return out


@dataclass
class Network:
    """Scaled inputs, one hidden layer of rectified units, a logit divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3,
                decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the weighted log loss (both classes count alike in total up to a factor of three); every fifth row calibrates."""
    share = float(y.mean()) if len(y) else 0.5
    width = x.shape[1]
    zero = np.zeros((width, hidden), np.float32)
    if len(y) < 10 or share in (0.0, 1.0):
        return Network(np.zeros(width), np.ones(width), zero, np.zeros(hidden), np.zeros(hidden), 0.0, 1.0, share)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    away = np.arange(len(y)) % 5 == 4
    x_fit, y_fit = x[~away], y[~away].astype(np.float32)
    p = [rng.normal(0, np.sqrt(2 / width), (width, hidden)).astype(np.float32), np.zeros(hidden, np.float32),
         rng.normal(0, np.sqrt(1 / hidden), hidden).astype(np.float32), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    rare = np.clip(0.5 / np.array([1 - share, share]), 1 / 3, 3)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y_fit))
        for a in range(0, len(order), 256):
            rows = order[a:a + 256]
            xb, yb = x_fit[rows], y_fit[rows]
            h = np.maximum(xb @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - yb) * rare[yb.astype(int)] / len(rows)
            gh = np.outer(g, p[2]) * (h > 0)
            grads = [xb.T @ gh + decay * p[0], gh.sum(axis=0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                p[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, *p[:3], float(p[3][0]), 1.0)
    z, t = np.maximum(x[away] @ p[0] + p[1], 0) @ p[2] + p[3][0], y[away]
    grid = np.geomspace(0.25, 8, 41)
    losses = [(np.logaddexp(0, z / k) - t * z / k).mean() for k in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, away: Column, key: str, text: str,
                    rows: int) -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled keys outside the held-out fold, chosen by the hash of the key.

    Of several rows of a key the one whose text has the least hash is taken, of several labels the largest.
    """
    chosen = labels.where(labels[label].isNotNull() & labels[key].isNotNull() & ~away)
    chosen = chosen.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows)
    pairs = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    found = pairs.join(F.broadcast(chosen), "id")  # at most ``rows`` pairs of numbers
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    return found.groupBy("id", "label").agg(least).select("id", F.col("least.text").alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, label: str, away: Column, key: str = "doc_id", text: str = "text",
        rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [r.tobytes() for r in document_vectors(texts(batch), sent.value)]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(x, pa.binary()), column(batch, "label")],
                                             ["id", "x", "label"])

    sample = labelled_sample(docs, labels, label, away, key, text, rows)
    kind = dict(docs.dtypes)[key]
    got = sorted(map(tuple, map_batches(sample.select("id", "text", "label"), vectorise,
                                        f"id {kind}, x binary, label int").collect()))  # one a key
    x = np.array([np.frombuffer(r[1], np.float32) for r in got]).reshape(len(got), 2 * DIMENSIONS + COUNTS)
    return vectors, fit_network(x, np.array([r[2] for r in got], np.float64))


def score_documents(docs: DataFrame, model: tuple[np.ndarray, Network], away: Column, key: str = "doc_id",
                    text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: key, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[key]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = sent.value
        for batch in batches:
            scores = network.score(document_vectors(texts(batch), vectors)).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, "held_out"), pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32))], [key, "held_out", "score", "predicted"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), away.alias("held_out"))
    return map_batches(rows, score, f"`{key}` {kind}, held_out boolean, score double, predicted int")
