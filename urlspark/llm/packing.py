"""Token ids in a word-aligned binary form (Simple-8b) with block offsets, written and read as pages of a table.

Every 64-bit word holds a 4-bit selector and as many ids of one width as fit its 60 bits. Ids wider than 60 bits
stand in a list of exceptions, to whose entries an escape word points, so that every word can be decoded alone.
A page is one binary value: header, keys and lengths of its texts, word offset of each block of ids, exceptions, words.
Pages lie in key order: those of part 0 first, within a part by page number. Null or empty texts have only the end id;
null keys come first, equal keys (repeated rows) next to each other, in an order fixed by the text.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from urlspark.llm.common import codes, column, gathered, map_batches, slices, texts, utf8, words

# fixed values of the format: ids per word and bits per id, by selector; the last one points to an exception
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int32)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.uint64)
ESCAPE = 14
LIMITS = np.uint64(1) << WIDTHS[:ESCAPE]
NEED = np.searchsorted(LIMITS, np.arange(1 << 16), side="right").astype(np.int8)  # of the ids that vocabularies have
BLOCK = 1024  # ids whose words begin anew
MAGIC = b"S8BP"
HEADER = struct.Struct("<4sIQQQQ")  # magic, block size, texts, ids, words, exceptions
PAGE_IDS = 1 << 19
ENCODE_BYTES = 16_000_000


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and the end, exceptions) of unsigned 64-bit ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    # narrowest word that starts at each id: all of its ids fit, and it does not leave the block
    place = np.arange(n, dtype=np.int32)
    block_end = np.minimum((place // BLOCK + 1) * BLOCK, n).astype(np.int32)
    need = NEED[ids] if ids.max(initial=0) < len(NEED) else np.searchsorted(LIMITS, ids, side="right").astype(np.int8)
    large = np.flatnonzero(need == ESCAPE)
    choice = np.full(n, ESCAPE, np.int8)
    follow = place + 1
    wider = np.zeros(n + 1, np.int32)
    widest = int(need.max(initial=0))
    able = place  # where one word does not fit, no word of more and narrower ids does
    for s in range(min(widest, ESCAPE - 1), -1, -1):
        able = able[need[able] <= s]
        if not len(able):
            break
        end = np.minimum(able + COUNTS[s], block_end[able])
        if widest > s:
            # a block's last word may hold fewer ids than its selector says
            if len(able) > n >> 4:
                np.cumsum(need > s, dtype=np.int32, out=wider[1:])
                fits = wider[end] == wider[able]
            else:
                bad = np.append(np.flatnonzero(need > s), n)
                fits = bad[np.searchsorted(bad, able)] >= end
            able, end = able[fits], end[fits]
        choice[able], follow[able] = s, end
    # the words of all blocks at once, one more of each block a step
    starts = np.zeros(n, bool)
    at = np.arange(blocks) * BLOCK
    stop = np.minimum(at + BLOCK, n)
    while len(at):
        starts[at] = True
        at = follow[at]
        left = at < stop
        at, stop = at[left], stop[left]
    begin = np.flatnonzero(starts)
    chosen = choice[begin]
    size = follow[begin] - begin
    value = ids
    if len(large):
        value = ids.copy()
        value[large] = np.arange(len(large), dtype=np.uint64)
    inside = place - np.repeat(begin.astype(np.int32), size)
    shifts = (inside * np.repeat(WIDTHS[chosen].astype(np.int32), size)).astype(np.uint64)
    words = np.bitwise_or.reduceat(value << shifts, begin) if n else np.zeros(0, np.uint64)
    words |= chosen.astype(np.uint64) << np.uint64(60)
    offsets = np.searchsorted(begin, np.arange(blocks) * BLOCK)
    return words, np.append(offsets, len(begin)).astype(np.uint32), ids[large]


def unpack(words: np.ndarray, n: int, exceptions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ids of whole blocks from their words; ``n`` ids in all."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    size = COUNTS[chosen].astype(np.int64)
    # the last word of a block holds what is left of the block
    before = np.concatenate([[0], np.cumsum(size)])
    blocks = len(offsets) - 1
    held = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    last = offsets[1:].astype(np.int64) - 1
    size[last] -= before[last + 1] - before[offsets[:-1]] - held
    width = WIDTHS[chosen]
    word = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(word)) - np.concatenate([[0], np.cumsum(size)[:-1]])[word]
    mask = (np.uint64(1) << width) - np.uint64(1)
    out = words[word] >> inside.astype(np.uint64) * width[word] & mask[word]
    escaped = chosen[word] == ESCAPE
    if escaped.any():
        out[escaped] = exceptions[out[escaped].astype(np.int64)]
    return out


def make_page(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    packed, offsets, exceptions = pack(ids)
    head = HEADER.pack(MAGIC, BLOCK, len(keys), len(ids), len(packed), len(exceptions))
    parts = (keys.astype("<i8"), lengths.astype("<u8"), offsets.astype("<u4"), exceptions.astype("<u8"), packed.astype("<u8"))
    return b"".join([head, *(p.tobytes() for p in parts)])


def read_page(page: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, lengths, ids)."""
    magic, block, texts_held, n, n_words, n_exceptions = HEADER.unpack_from(page)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a page of token ids")
    at, parts = HEADER.size, []
    for kind, size in (("<i8", texts_held), ("<u8", texts_held), ("<u4", -(-n // BLOCK) + 1), ("<u8", n_exceptions),
                       ("<u8", n_words)):
        parts.append(np.frombuffer(page, kind, size, at))
        at += parts[-1].nbytes
    keys, lengths, offsets, exceptions, words = parts
    ids = unpack(words, n, exceptions, offsets) if n else np.zeros(0, np.uint64)
    return keys, lengths.astype(np.int64), ids


def read_block(page: bytes, number: int) -> np.ndarray:
    """The ids of one block, found by its offset."""
    _, _, texts_held, n, n_words, n_exceptions = HEADER.unpack_from(page)
    at = HEADER.size + 16 * texts_held
    ends = np.frombuffer(page, "<u4", 2, at + 4 * number).astype(np.int64)
    at += 4 * (-(-n // BLOCK) + 1)
    exceptions = np.frombuffer(page, "<u8", n_exceptions, at)
    words = np.frombuffer(page, "<u8", ends[1] - ends[0], at + 8 * n_exceptions + 8 * ends[0])
    held = min(BLOCK, n - number * BLOCK)
    return unpack(words, held, exceptions, np.array([0, len(words)]))


def tokenizer_text(path: str) -> str:
    """The tokenizer's file (some MB at most), read on the driver and sent to the executors."""
    with open(path, encoding="utf-8") as file:
        return file.read()


# fixed values: the tokenizer settings for which a word of Latin letters and closing marks has two pieces at most
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
LOWER = {c: c + 32 for c in (*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF))}
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
CACHED_PIECES = 500_000  # per worker, some 80 MB; forgotten together when full


def _byte_letters() -> dict[int, str]:
    """The letters that stand for UTF-8 bytes: printable bytes for themselves, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts, each different word of a batch encoded once.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words. Where the
    settings allow, words of Latin letters and closing marks go to the tokenizer's merge model piece by piece, and
    pieces are remembered; all other words go through the whole tokenizer.
    """

    def __init__(self, settings: str):
        self.tokenizer = Tokenizer.from_str(settings)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        said = json.loads(settings)
        split, byte_level = said["pre_tokenizer"]["pretokenizers"]
        if split["pattern"] != {"Regex": SPLIT} or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("words of this tokenizer may depend on their neighbours")
        self.by_piece = (
            [n["type"] for n in said["normalizer"]["normalizers"]] == NORMALIZERS
            and not byte_level["add_prefix_space"] and not byte_level["use_regex"]
        )
        self.letters, self.pieces = _byte_letters(), {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CACHED_PIECES:
                self.pieces.clear()
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = [t.id for t in self.tokenizer.model.tokenize(shown)] if piece else []
        return ids

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; words have no white space around them."""
        out: list[list[int]] = []
        others: list[int] = []
        known = self.pieces
        for i, word in enumerate(words):
            ids = known.get(word)
            if ids is None:
                plain = self.by_piece and PLAIN.fullmatch(word if word.isascii() else word.translate(LOWER))
                if plain:
                    letters, marks = plain.groups()
                    ids = self._piece(letters) + self._piece(marks) if marks else self._piece(letters)
                else:
                    others.append(i)
            out.append(ids)
        encoded = self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False)
        for i, e in zip(others, encoded):
            out[i] = e.ids
        return out

    def encode(self, strings: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of all texts in a row, each with the end id, and how many each has."""
        flat_words, starts = words(pc.ascii_lower(strings) if self.by_piece else strings)
        if self.by_piece:
            flat_words, starts = _without_marks(flat_words, starts)
        code, different = codes(flat_words)
        lists = self.words(different.to_pylist())
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        # an end id, as one more word, behind the words of each text
        code = np.insert(code, starts[1:], len(lists))
        first = np.append(np.cumsum(sizes) - sizes, len(flat))
        sizes = np.append(sizes, 1)
        flat = np.append(flat, np.int32(end))
        taken = sizes[code]
        ends = np.cumsum(taken)
        at = np.repeat((first[code] - (ends - taken)).astype(np.int32), taken)  # a batch has fewer ids than bytes and texts
        at += np.arange(len(at), dtype=np.int32)
        ids = flat[at]
        sums = np.concatenate([[0], ends])
        return ids, np.diff(sums[starts + np.arange(len(starts))])


@lru_cache(maxsize=1)
def word_tokenizer(settings: str) -> WordTokenizer:
    """The last used tokenizer of this worker, which its tasks share with the pieces that it remembers."""
    return WordTokenizer(settings)


def _without_marks(flat_words: pa.Array, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words with their closing marks as words of their own, if a Latin letter stands in front of them."""
    stems = pc.ascii_rtrim(flat_words, MARKS)
    shorter = pc.not_equal(pc.binary_length(stems), pc.binary_length(flat_words)).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(shorter)
    at = at[pc.match_substring_regex(stems.take(pa.array(at)), "[a-z]$").to_numpy(zero_copy_only=False)]
    if not len(at):
        return flat_words, starts
    cut = np.zeros(len(flat_words), bool)
    cut[at] = True
    cut = pa.array(cut)
    marked, stem = flat_words.take(pa.array(at)), stems.take(pa.array(at))
    raw, ends = utf8(marked)
    sizes = np.diff(ends) - pc.binary_length(stem).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    taken = raw[np.arange(bounds[-1]) + np.repeat(ends[1:] - bounds[1:], sizes)]
    marks = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(taken)))
    n = len(flat_words)
    order = np.insert(np.arange(n), at + 1, n + np.arange(len(at)))
    both = pa.concat_arrays([pc.if_else(cut, stems, flat_words), marks]).take(pa.array(order))
    return both, starts + np.searchsorted(at, starts)


NULL_KEY = -(1 << 63)


def write_tokens(docs: DataFrame, settings: str, path: str, end_id: int, key: str = "doc_id", text: str = "text",
                 parts: int | None = None) -> None:
    """Token ids of all rows as pages in key order: a table (part, page, part_start, n_texts, n_ids, payload).

    Keys must be integers (null is kept). Rows are dealt by ranges of key and text hash, so that no run of equal keys is
    one task, and sorted there; one task holds one page at a time.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(settings)
    pairs = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    pairs = pairs.withColumn("mark", F.xxhash64("text"))
    order = ("key", "mark")
    dealt = pairs.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_tokenizer(sent.value), TaskContext.get().partitionId()
        number, before = 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def page() -> pa.RecordBatch:
            nonlocal number, before, held
            keys, lengths, ids = (np.concatenate([h[i] for h in held]) for i in range(3))
            row = [part, number, before, len(keys), len(ids)]
            number, before, held = number + 1, before + len(ids), []
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int32()), *(pa.array([v], pa.int64()) for v in row[1:]),
                 pa.array([make_page(keys, lengths, ids)], pa.binary())],
                ["part", "page", "part_start", "n_texts", "n_ids", "payload"])

        for batch in gathered(batches, ENCODE_BYTES):
            strings = texts(batch)
            keys = pc.fill_null(column(batch, "key"), NULL_KEY).to_numpy(zero_copy_only=False)
            for a, b in slices(np.diff(utf8(strings)[1]), ENCODE_BYTES):
                ids, lengths = encoder.encode(strings.slice(a, b - a), end_id)
                ends = np.cumsum(lengths)
                for c, d in slices(lengths, PAGE_IDS):
                    held.append((keys[a + c:a + d], lengths[c:d], ids[ends[c] - lengths[c]:ends[d - 1]]))
                    if sum(len(h[2]) for h in held) >= PAGE_IDS:
                        yield page()
        if held:
            yield page()

    schema = "part int, page long, part_start long, n_texts long, n_ids long, payload binary"
    map_batches(dealt.select("key", "text"), make, schema).write.parquet(path)


def read_tokens(pages: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per text: key, start (ids of all texts before it), n_tokens, crc32 of its ids, on request the ids (uint32).

    The driver sees one sum per written part, and the executors get those sums.
    """
    spark = pages.sparkSession
    totals = sorted((r["part"], r["n"]) for r in pages.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    begin, total = {}, 0
    for part, n in totals:
        begin[part] = total
        total += n
    sent = spark.sparkContext.broadcast(begin)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(column(batch, c).to_pylist() for c in ("part", "part_start", "payload"))):
                keys, lengths, ids = read_page(payload)
                ends = np.cumsum(lengths)
                packed = ids.astype("<u4").tobytes()
                cuts = [packed[4 * b:4 * e] for b, e in zip((ends - lengths).tolist(), ends.tolist())]
                out = [pa.array(keys, pa.int64(), mask=keys == NULL_KEY),
                       pa.array(ends - lengths + before + sent.value[part], pa.int64()), pa.array(lengths, pa.int64()),
                       pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
                if with_ids:
                    out.append(pa.array(cuts, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = [key, "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    fields = "start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(pages.select("part", "part_start", "payload"), read, f"`{key}` long, {fields}")
