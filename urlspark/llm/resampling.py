"""Importance resampling towards a target distribution: hashed n-gram features, CRC-32 buckets from position tables.

Texts are lower-cased (A-Z only) and cut into words of letters, digits and anything beyond ASCII; features are runs of 1
to 3 consecutive words joined by one space, repeats counted. A feature's bucket is the CRC-32 of its bytes modulo the
number of buckets. CRC-32 is linear over bits but for a constant of the length, so a feature's CRC is the exclusive or of
what each byte contributes at its distance from the feature's end (a table), taken over feature spans by
``bitwise_xor.reduceat``, and of the length's constant. Features longer than the table fold block by block.

Null and empty texts, and texts without words, have no features and weight 0. A null key is hashed as ``42:`` and
ranks after all other keys of its score. Repeated rows count each time; rows equal in score and key get consecutive
ranks in no stated order. Empty tables give empty results; without target texts every target count is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlspark.llm.common import column, map_batches, slices, texts, utf8, written

LENGTHS = (1, 2, 3)  # words a feature
BUCKETS = 10_000
SCALE = 1_000  # gains and noise are whole thousandths
SEED = 42
MIN_WORDS = 20  # words that a document needs to be drawn
PERCENT = 5  # of those documents are drawn
DEPTH = 128  # distances from the end that the table holds; longer features fold in blocks of it
SPAN_BYTES = 1 << 16  # bytes of features handled at once, whatever the text's length
TEXT_BYTES = 1 << 18  # of texts normalised at once; one longer text alone

WORD_BYTES = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def _position_table(depth: int) -> np.ndarray:
    """[d, b]: what byte b contributes to the CRC of a string that goes on for d more bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0xEDB88320), first >> 1)
    table = np.empty((depth, 256), np.uint32)
    table[0] = first
    for d in range(1, depth):
        table[d] = (table[d - 1] >> 8) ^ first[table[d - 1] & 0xFF]
    return table


POSITIONS = _position_table(DEPTH)
FLAT = POSITIONS.ravel()


def _shifted(state: np.ndarray) -> np.ndarray:
    """The state after a whole block of zero bytes."""
    return (POSITIONS[DEPTH - 1][state & 0xFF] ^ POSITIONS[DEPTH - 2][state >> 8 & 0xFF]
            ^ POSITIONS[DEPTH - 3][state >> 16 & 0xFF] ^ POSITIONS[DEPTH - 4][state >> 24])


def _length_constants(depth: int) -> np.ndarray:
    """The start state after 0 to ``depth`` zero bytes."""
    out = np.empty(depth + 1, np.uint32)
    out[0] = 0xFFFFFFFF
    for n in range(1, depth + 1):
        out[n] = (out[n - 1] >> 8) ^ POSITIONS[0][out[n - 1] & 0xFF]
    return out


CONSTANTS = _length_constants(DEPTH)


def _spans_xor(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exclusive or of the contributions of each span's bytes; spans have 1 to DEPTH bytes."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    cell = np.arange(ends[-1])
    byte = data[cell + np.repeat(starts - begins, lengths)]
    distance = np.repeat(ends - 1, lengths) - cell
    return np.bitwise_xor.reduceat(FLAT[distance << 8 | byte], begins)


def span_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of the spans of ``data`` (uint8), none of them empty."""
    out = np.empty(len(starts), np.uint32)
    short = lengths <= DEPTH
    if short.any():
        at, size = starts[short], lengths[short]
        out[short] = np.concatenate([
            _spans_xor(data, at[a:b], size[a:b]) for a, b in _even(size, SPAN_BYTES)]) ^ CONSTANTS[size]
    for i in np.flatnonzero(~short).tolist():
        out[i] = _folded(data[starts[i]:starts[i] + lengths[i]])
    return ~out


def _even(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of spans of about ``limit`` bytes together."""
    block = np.cumsum(sizes) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]])
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _folded(span: np.ndarray) -> np.uint32:
    """State after a long span: its first, shorter block, then whole blocks one after the other."""
    head = (len(span) - 1) % DEPTH + 1
    state = CONSTANTS[head:head + 1] ^ _spans_xor(span, np.array([0]), np.array([head]))
    for a in range(head, len(span), SPAN_BYTES // DEPTH * DEPTH):
        part = span[a:a + SPAN_BYTES // DEPTH * DEPTH]
        begins = np.arange(0, len(part), DEPTH)
        for block in _spans_xor(part, begins, np.full(len(begins), DEPTH)):
            state = _shifted(state) ^ block
    return state[0]


def _normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of lower-case words with single spaces, word begins, word ends, row of each word)."""
    inside = WORD_BYTES[raw]
    first, after = inside.copy(), np.zeros(len(raw) + 1, bool)
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] = inside[edges]  # a new text begins a new word
    after[1:] = inside
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(after & ~np.append(inside, False))  # the byte after a run of words without a gap
    joined = np.setdiff1d(starts[1:], np.flatnonzero(~after[:-1]), assume_unique=True)  # begins that touch the word before
    ends = np.sort(np.concatenate([stops, joined]))
    sizes = ends - starts
    begins = np.cumsum(sizes + 1) - sizes - 1
    data = np.full(int(begins[-1] + sizes[-1]) if len(sizes) else 0, 0x20, np.uint8)
    data[np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)] = LOWER[raw[inside]]
    return data, begins, begins + sizes, np.searchsorted(offsets, starts, side="right") - 1


def features(strings: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(words a feature, rows, their buckets) of all features of texts without nulls, a piece at a time, rows ascending."""
    raw, offsets = utf8(strings)
    for a, b in slices(np.diff(offsets), TEXT_BYTES):
        data, begins, ends, row = _normal(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        row = row + a
        for n in LENGTHS:
            m = len(row) - n + 1
            whole = np.flatnonzero(row[:max(m, 0)] == row[n - 1:])
            for c in range(0, len(whole), SPAN_BYTES):
                at = whole[c:c + SPAN_BYTES]
                yield n, row[at], span_crcs(data, begins[at], ends[at + n - 1] - begins[at]) % np.uint32(buckets)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket int, n long) over all features; a task hands on one row for each bucket it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(texts(batch), buckets):
                total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met])], ["bucket", "n"])

    parts = map_batches(docs.select(docs[text].alias("text")), count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
                 buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket the whole thousandths of the log ratio of its smoothed shares in target and documents."""
    held = np.zeros((2, buckets), np.int64)
    for i, counts in enumerate((bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))):
        for r in counts.collect():  # at most one row a bucket
            held[i, r.bucket] = r.n
    every, wanted = (int(n) for n in held.sum(axis=1))
    return np.array([
        math.floor(SCALE * math.log((t + 1) * (every + buckets) / ((s + 1) * (wanted + buckets))))
        for s, t in held.T.tolist()
    ], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) per row of ``docs``: the sum of its features' gains; narrow."""
    kind, sent = dict(docs.dtypes)[key], docs.sparkSession.sparkContext.broadcast(gains)  # 8 bytes a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = np.zeros((3, len(batch)), np.int64)
            for n, rows, found in features(texts(batch), len(sent.value)):
                count = np.bincount(rows, minlength=len(batch))
                n_features += count
                n_words += count * (n == 1)
                order = np.concatenate([[0], np.cumsum(sent.value[found])])
                ends = np.cumsum(count)
                weight += order[ends] - order[ends - count]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), *map(pa.array, (n_words, n_features, weight))],
                [key, "n_words", "n_features", "weight"])

    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return map_batches(pairs, weigh, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(key: Column) -> Column:
    """Whole thousandths of Gumbel noise drawn from the key's digest."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(SCALE) * F.log(-F.log(share)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             min_words: int = MIN_WORDS, percent: int = PERCENT, buckets: int = BUCKETS) -> DataFrame:
    """Per row: key, n_features, weight, score, rank (from 1; null if not drawn).

    The rows are sorted in ranges once and written with their places; a range's first rank is the number of rows in the
    ranges before it, so no task ranks more than its own range, and copies of one key are spread by their row number.
    """
    gains = bucket_gains(docs, target, text, target_text, buckets)
    scored = weights(docs, gains, key, text).select(
        F.col(key).alias("id"), "n_features", "weight", (F.col("weight") + noise(F.col(key))).alias("score"),
        (F.col("n_words") >= min_words).alias("fit"))
    scored = written(scored, "resampling-scores").withColumn("row", F.monotonically_increasing_id())
    ordered = scored.orderBy(F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), "row")
    # numbered in the tasks that sort: the upper bits name the range, the lower 33 the place in it
    ordered = written(ordered.withColumn("place", F.monotonically_increasing_id()).drop("row"), "resampling-order")
    part = F.shiftright("place", 33)
    sizes = ordered.where("fit").groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row a range
    drawn, before, firsts = percent * sum(r.n for r in sizes) // 100, 0, []
    for r in sorted(sizes):
        firsts.append((r.part, before))
        before += r.n
    starts = docs.sparkSession.createDataFrame([f for f in firsts if f[1] < drawn], "part long, before long")
    place = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part", "left")  # a row a range
    return ranked.select(F.col("id").alias(key), "n_features", "weight", "score",
                         F.when(F.col("fit") & (place <= drawn), place).alias("rank"))
