"""Byte-level BPE: exact merges by backtracking over longest automaton matches, and decoding.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds the
longest token at every byte of a piece. A token sequence is the merge result exactly if every adjacent pair
is, on its own, the merge result of its joined bytes; that relation is memoised. Starting from longest matches
and backing off to the longest shorter token, each position is left at most once per token that ends there, so
the work is linear in the piece. A null or empty text has no ids and decodes to no bytes; rows are independent.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from urlspark.llm.common import column, fresh_name, map_batches, sha256_hex, texts

CACHED_PIECES = 400_000  # per worker, some 70 MB
CACHED_CHUNKS = 150_000  # the same for whole words, some 30 MB
CACHED_PAIRS = 1_000_000
WHOLE_LIST = 1 << 22  # characters; longer texts are cut into pieces a few at a time
PIECES_AT_ONCE = 1 << 16
BESIDE_SPACE = re.compile(r" (?:\s|\Z)"), re.compile(r"(?:\s|\A) ")


class ByteBpe:
    """Encoder and decoder for a vocabulary in rank order; ``ranks`` is the text of a rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        self.rank = {}
        for line in ranks.splitlines():
            token, number = line.split()
            self.rank[base64.b64decode(token).decode("latin-1")] = int(number)
        self.token = {number: token for token, number in self.rank.items()}
        self.bytes = {number: token.encode("latin-1") for token, number in self.rank.items()}
        size = max(self.token, default=0) + 1
        self.width = [len(self.token.get(i, "")) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        reachable = {token for token, number in self.rank.items() if self._merged(token) == [number]}
        for token in reachable:
            self.automaton.add_word(token, (self.rank[token], len(token) - 1))
        self.automaton.make_automaton()
        self.shorter: list[int] = [-1] * size
        for token in reachable:
            self.shorter[self.rank[token]] = self._longest_prefix(token, reachable)
        self.pairs: dict[int, bool] = {}
        self.pieces = _Memo(CACHED_PIECES, self._packed_piece)
        self.chunks = _Memo(CACHED_CHUNKS, self._packed_chunk)

    def _longest_prefix(self, token: str, reachable: set[str]) -> int:
        return next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), -1)

    def _merged(self, text: str) -> list[int]:
        """Merges by definition: the pair of lowest rank first, the leftmost of equals. For short strings only."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return [rank[p] for p in parts]

    def _fit(self, left: int, right: int) -> bool:
        """Whether two adjacent tokens are what their joined bytes merge to."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left << 32 | right] = self._merged(self.token[left] + self.token[right]) == [left, right]
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece, given as Latin-1."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        size, width, shorter, pairs = len(piece), self.width, self.shorter, self.pairs
        longest = [0] * (size + 1)
        for end, (number, before) in self.automaton.iter(piece):
            longest[end - before] = number  # later ends are longer matches
        ids: list[int] = []
        closed = bytearray(size + 1)  # positions from which no continuation fits
        at, trial, last = 0, longest[0], -1
        while at < size:
            end = at + width[trial]
            if not closed[end]:
                fits = last < 0 or pairs.get(last << 32 | trial)
                if fits is None:
                    fits = self._fit(last, trial)
                if fits:
                    ids.append(trial)
                    at, last, trial = end, trial, longest[end]
                    continue
            trial = shorter[trial]
            while trial < 0:  # nothing fits here: give up the token in front
                closed[at] = 1
                ids.pop()
                at -= width[last]
                trial = shorter[last]
                last = ids[-1] if ids else -1
        return ids

    def _packed_piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece if piece.isascii() else piece.encode().decode("latin-1"))
        return pack(f"<{len(ids)}I", *ids)

    def _packed_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit numbers.

        No piece crosses the front of a space between two other characters, so such a text is cut there
        and whole words are looked up; texts with other white space around spaces are cut into pieces only.
        """
        if len(text) <= WHOLE_LIST:
            if not any(p.search(text) for p in BESIDE_SPACE):
                first, *rest = text.split(" ")
                known = self.chunks.__getitem__
                packed = known(first) + b"".join([known(" " + word) for word in rest])
            else:
                packed = self._packed_chunk(text)
        else:
            found = (m.group() for m in self.pattern.finditer(text))
            known = self.pieces.__getitem__
            packed = b"".join(iter(lambda: b"".join(map(known, islice(found, PIECES_AT_ONCE))), b""))
        return np.frombuffer(packed, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


class _Memo(dict):
    """Packed ids of short strings, made on demand and forgotten together when full."""

    def __init__(self, limit: int, make: Callable[[str], bytes]):
        super().__init__()
        self.limit, self.make = limit, make

    def __missing__(self, text: str) -> bytes:
        packed = self.make(text)
        if len(text) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[text] = packed
        return packed


_BUILT: dict[tuple[str, str], ByteBpe] = {}


def encoder(ranks: bytes, pattern: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    key = (hashlib.sha256(ranks).hexdigest(), pattern)
    if key not in _BUILT:
        _BUILT[key] = ByteBpe(ranks, pattern)
    return _BUILT[key]


def vocabulary(path: str) -> bytes:
    """A rank file (some MB at most, as vocabularies are), read on the driver and sent to the executors."""
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) per row; ``ids`` holds little-endian unsigned 32-bit numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(docs.dtypes)[key]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value, pattern)
        for batch in batches:
            ids = pa.array([bpe.encode(t).tobytes() for t in texts(batch).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "key"), ids], [key, "ids"])

    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return map_batches(pairs, encode, f"`{key}` {kind}, ids binary")


def decode_ids(coded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of its ids as column ``out``, which must be new."""
    sent = coded.sparkSession.sparkContext.broadcast(ranks)
    copy = fresh_name(coded, "ids_read")
    schema = coded.withColumn(out, coded[ids]).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value, pattern)
        for batch in batches:
            rows = column(batch, copy).to_pylist()
            decoded = pa.array([bpe.decode(np.frombuffer(r or b"", dtype="<u4")) for r in rows], pa.binary())
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != copy]
            yield pa.RecordBatch.from_arrays([*kept, decoded], schema.names)

    return map_batches(coded.withColumn(copy, coded[ids]), decode, schema)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, key: str = "doc_id", text: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Per row: n_tokens, sha256 of the ids and of the bytes they decode to, on request the ids too."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value, pattern)
        for batch in batches:
            counts, packed, coded, decoded = [], [], [], []
            for t in texts(batch).to_pylist():
                ids = bpe.encode(t)
                counts.append(len(ids))
                packed.append(ids.tobytes())
                coded.append(sha256_hex(packed[-1]))
                decoded.append(sha256_hex(bpe.decode(ids)))
                if not with_ids:
                    packed.pop()
            out = [column(batch, "key"), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                   pa.array(decoded, pa.string())]
            if with_ids:
                out.append(pa.array(packed, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return map_batches(pairs, run, f"`{key}` {kind}, {fields}")
