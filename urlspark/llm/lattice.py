"""Language-model scores: word counts as a base, and the likelihood of all segmentations into pieces of a vocabulary.

The lattice of a word has the pieces of a given vocabulary, which stays as it is, and one edge for the whole word if the
training texts have it. The vocabulary's scores are not probabilities there, so each piece's probability is estimated on
the training words: first from the vocabulary's own segmentation, then by expectation over all segmentations. The whole
word weighs its count less a discount; the discounted mass goes to the pieces. Marginal probabilities come from a
forward recursion in log space, once per different word of the corpus, as pieces never cross words.

Texts are lower-cased (A-Z) and cut at ASCII white space; an end follows the last word. A null or empty text is an end
alone. Rows without a key are trained on. Repeated rows count each time. Without training rows all pieces are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlspark.llm.common import codes, column, find_packages, gathered, map_batches, slices, texts, words, written

CHUNK_WORDS = 3_000_000  # words whose different ones are listed once; texts are never cut
SMOOTHING = 0.5  # added to the count of every piece
ROUNDS = 1  # of expectation over all segmentations
DISCOUNT = 0.75  # taken from the count of each whole word
START = "▁"  # marks the beginning of a word in the vocabulary


class Pieces:
    """The strings of a piece vocabulary with a log probability each; characters outside it are spelled in bytes."""

    def __init__(self, model: bytes, scores: np.ndarray | None = None):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.number = {sp.id_to_piece(i): i for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(self.size) if sp.is_byte(i)}
        self.longest = max(map(len, self.number))
        self.scores = scores
        if scores is not None:
            self.score = {piece: float(scores[i]) for piece, i in self.number.items()}

    def edges(self, text: str) -> list[list[tuple[int, float, list[int]]]]:
        """For each end position: (start, log probability, piece numbers) of what ends there."""
        out: list[list[tuple[int, float, list[int]]]] = [[]]
        for end in range(1, len(text) + 1):
            here = []
            for begin in range(max(0, end - self.longest), end):
                number = self.number.get(text[begin:end])
                if number is not None:
                    here.append((begin, self.score[text[begin:end]], [number]))
            if text[end - 1] not in self.number:
                spelled = [self.bytes[b] for b in text[end - 1].encode()]
                here.append((end - 1, float(self.scores[spelled].sum()), spelled))
            out.append(here)
        return out

    def log_probability(self, word: str) -> float:
        """Natural log of the word's probability over all segmentations."""
        text, score, longest, exp = START + word, self.score, self.longest, math.exp
        forward = [0.0]
        for end in range(1, len(text) + 1):
            terms = []
            for begin in range(max(0, end - longest), end):
                s = score.get(text[begin:end])
                if s is not None:
                    terms.append(forward[begin] + s)
            if text[end - 1] not in score:
                terms.append(forward[end - 1] + float(self.scores[[self.bytes[b] for b in text[end - 1].encode()]].sum()))
            top = max(terms)
            forward.append(top if len(terms) == 1 else top + math.log(sum([exp(t - top) for t in terms])))
        return forward[-1]

    def add_expected(self, word: str, counts: np.ndarray) -> None:
        """Adds how often each piece is expected in the word, over all segmentations."""
        edges, exp = self.edges(START + word), math.exp
        n = len(edges)
        forward = [0.0] * n
        for end in range(1, n):
            terms = [forward[b] + s for b, s, _ in edges[end]]
            top = max(terms)
            forward[end] = top + math.log(sum([exp(t - top) for t in terms]))
        backward = [-math.inf] * n
        backward[-1] = 0.0
        whole = forward[-1]
        for end in range(n - 1, 0, -1):
            behind = backward[end]
            for begin, s, numbers in edges[end]:
                part = exp(forward[begin] + s + behind - whole)
                for i in numbers:
                    counts[i] += part
                a, b = backward[begin], s + behind
                top = a if a > b else b
                backward[begin] = top + math.log1p(exp(-abs(a - b))) if a > -math.inf else b


def _chunks(docs: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    """Texts as numbers into lists of different words: one row per some CHUNK_WORDS words."""
    key_type = docs.schema[key].dataType
    schema = T.StructType([
        T.StructField("keys", T.ArrayType(key_type)), T.StructField("held", T.BinaryType()),
        T.StructField("starts", T.BinaryType()), T.StructField("codes", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.StringType())), T.StructField("trained", T.ArrayType(T.LongType())),
        T.StructField("learnt", T.LongType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 8 * CHUNK_WORDS):
            strings, keys = pc.ascii_lower(texts(batch)), column(batch, "key")
            away = column(batch, "held").to_numpy(zero_copy_only=False).astype(bool)
            sizes = pc.binary_length(strings).to_numpy(zero_copy_only=False) // 6 + 1
            for a, b in slices(sizes, CHUNK_WORDS):
                flat, starts = words(strings.slice(a, b - a))
                code, different = codes(flat)
                learnt = np.repeat(~away[a:b], np.diff(starts))
                trained = np.bincount(code[learnt], minlength=len(different)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays([0, b - a], keys.slice(a, b - a)),
                    pa.array([away[a:b].astype(np.int8).tobytes()], pa.binary()),
                    pa.array([starts.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([code.astype(np.int32).tobytes()], pa.binary()),
                    pa.ListArray.from_arrays([0, len(different)], different),
                    pa.ListArray.from_arrays([0, len(trained)], pa.array(trained)),
                    pa.array([int((~away[a:b]).sum())], pa.int64()),
                ], schema.names)

    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"), held.alias("held"))
    chunks = map_batches(pairs, cut, schema).withColumn("chunk", F.monotonically_increasing_id())
    return written(chunks, "chunks")


def _piece_sums(counts: DataFrame, model: bytes, scores: np.ndarray | None) -> np.ndarray:
    """How often each piece occurs in the different words: by the vocabulary's own segmentation, or expected under scores.

    The driver gets one number per piece of the vocabulary.
    """
    sent = counts.sparkSession.sparkContext.broadcast((model, scores))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*sent.value)
        sums = np.zeros(pieces.size)
        for batch in batches:
            listed = column(batch, "word").to_pylist()
            if scores is None:
                for ids in pieces.processor.encode(listed, num_threads=1):
                    for i in ids:
                        sums[i] += 1
            else:
                for word in listed:
                    pieces.add_expected(word, sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["piece", "n"])

    rows = map_batches(counts.where("c > 0").select("word"), add, "piece long, n double")
    out = np.zeros(Pieces(model).size)
    for piece, n in rows.groupBy("piece").agg(F.sum("n")).collect():
        out[piece] = n
    return out


def fit(counts: DataFrame, model: bytes, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log probability of each piece; words are drawn piece by piece until the next would begin a word."""
    scores = None
    for _ in range(rounds + 1):
        sums = _piece_sums(counts, model, scores) + SMOOTHING
        scores = np.log(sums / sums.sum())
    return scores


def score_documents(docs: DataFrame, model: bytes, held: Column, key: str = "doc_id", text: str = "text",
                    rounds: int = ROUNDS) -> DataFrame:
    """Per row: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    chunks = _chunks(docs, key, text, held)
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "trained")).alias("code", "e")).select(
        "chunk", "code", F.col("e.words").alias("word"), F.col("e.trained").alias("n"))
    counts = written(entries.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total, different = counts.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    ends = chunks.agg(F.sum("learnt")).first()[0] or 0
    n, v = (total or 0) + ends, different + (1 if ends else 0)
    scores = fit(counts, model, rounds)
    # what the discounts leave to the pieces
    left, log10 = math.log(DISCOUNT * different + 1), math.log(10)
    end = math.log((ends + 1) / (n + 2))
    sent = docs.sparkSession.sparkContext.broadcast((model, scores))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(*sent.value)
        for batch in batches:
            spelled = np.array([pieces.log_probability(w) for w in column(batch, "word").to_pylist()])
            seen = column(batch, "c").to_numpy(zero_copy_only=False) - DISCOUNT
            whole = np.log(seen, where=seen > 0, out=np.full(len(seen), -np.inf))
            p = (np.logaddexp(whole, left + spelled) - math.log(n + 2)) / log10
            yield pa.RecordBatch.from_arrays([column(batch, "word"), column(batch, "c"), pa.array(p)], ["word", "c", "p"])

    weighed = map_batches(counts, weigh, "word string, c long, p double")
    valued = entries.select("chunk", "code", "word").join(weighed, "word").select("chunk", "code", "c", "p")
    kind = docs.schema[key].dataType.simpleString()
    end_known, end_base = int(ends > 0), math.log10((ends + 1) / (n + v + 1))

    def put_together(rows: pa.Table, values: pa.Table) -> pa.Table:
        at = values["code"].to_numpy()
        c, p = np.zeros(len(at), np.int64), np.zeros(len(at))
        c[at], p[at] = values["c"].to_numpy(), values["p"].to_numpy()
        base = np.log10((c + 1) / (n + v + 1))
        chunk = rows.to_pylist()[0]
        starts, code = np.frombuffer(chunk["starts"], np.int64), np.frombuffer(chunk["codes"], np.int32)
        owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        known, base_sum, p_sum = (
            np.bincount(owner, weights=x[code], minlength=len(starts) - 1) for x in (c > 0, base, p)
        )
        m = len(starts) - 1
        return pa.Table.from_arrays([
            rows["keys"].combine_chunks().flatten(),
            pa.array(np.frombuffer(chunk["held"], np.int8).astype(bool)), pa.array(np.diff(starts) + 1, pa.int64()),
            pa.array(known.astype(np.int64) + end_known), pa.array(np.full(m, n, np.int64)), pa.array(base_sum + end_base),
            pa.array(p_sum + end / log10),
        ], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    find_packages(docs.sparkSession)
    coded = chunks.select(F.col("chunk").alias("at"), "keys", "held", "starts", "codes")
    return coded.groupBy("at").cogroup(valued.groupBy("chunk")).applyInArrow(
        put_together, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
