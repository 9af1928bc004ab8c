"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, each text scanned once.

Texts are normalised to lower-case words (A-Z only; letters, digits and anything beyond ASCII) with single spaces,
as Latin-1 characters of their UTF-8 bytes. A window is 10 consecutive words of an item, or all of a shorter one.
Null or empty texts and items have no words: such documents are clean, such items have no windows. Items that share
a window all count; items without an id count like any other for hits, together as one more item, and add nothing to the
digest of ids. Repeated rows are judged alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlspark.llm.common import column, filled, fresh_name, map_batches, place, sha256_hex, texts, with_arrays, written

WINDOW = 10
BLOCK_BYTES = 2_000_000  # of window text in one automaton (at most some 100 MB per worker); more are scanned in blocks
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
NORMAL = bytes(
    ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b >= 0x80 else 0x20 for b in range(256)
)


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


def benchmark_windows(items: DataFrame, key: str, text: str, size: int = WINDOW) -> DataFrame:
    """(item string, window string, n_words int), each pair once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for item, t in zip(column(batch, "item").to_pylist(), texts(batch).to_pylist()):
                words = normal_words(t)
                n = min(size, len(words))
                if n:
                    rows.update((item, b" ".join(words[i:i + n]).decode("utf-8"), n) for i in range(len(words) - n + 1))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32()))],
                                             ["item", "window", "n_words"])

    pairs = items.select(items[key].cast("string").alias("item"), items[text].alias("text"))
    return map_batches(pairs, cut, "item string, window string, n_words int").distinct()


def window_blocks(windows: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str, int]]]:
    """The windows in blocks of about ``block_bytes`` of text, each read to the driver when its turn comes."""
    total = windows.agg(F.sum(F.octet_length("window") + F.octet_length(F.coalesce("item", F.lit(""))))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    if blocks == 1:
        yield [tuple(r) for r in windows.collect()]
        return
    numbered = written(windows.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks))), "windows")
    for b in range(blocks):
        yield [tuple(r) for r in numbered.where(F.col("block") == b).select("item", "window", "n_words").collect()]


class WindowAutomaton:
    def __init__(self, rows: list[tuple[str | None, str, int]]):
        held: dict[str, tuple[int, list[str]]] = {}
        for item, window, n in rows:
            held.setdefault(f" {window} ".encode().decode("latin-1"), (n, []))[1].append(item)
        self.automaton = ahocorasick.Automaton()
        for window, value in held.items():
            self.automaton.add_word(window, value)
        self.empty = not held
        if held:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """(indexes of the words inside windows, items)."""
        items: set[str | None] = set()
        if self.empty or not words:
            return np.zeros(0, np.int32), items
        normal = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(normal.decode("latin-1")))
        if not found:
            return np.zeros(0, np.int32), items
        spaces = np.flatnonzero(np.frombuffer(normal, np.uint8) == 0x20)
        last = np.searchsorted(spaces, [end for end, _ in found])
        cover = np.zeros(len(words) + 1, np.int64)
        sizes = np.array([value[0] for _, value in found])
        np.add.at(cover, last - sizes, 1)
        np.add.at(cover, last, -1)
        for _, value in found:
            items.update(value[1])
        return np.flatnonzero(np.cumsum(cover[:-1])).astype(np.int32), items


def _scanned(docs: DataFrame, rows: list, text: str, names: tuple[str, str, str], first: bool) -> DataFrame:
    """``docs`` with n_words, hit word indexes and items; later passes add to what the columns hold."""
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    n_words, hits, items = names
    schema = docs.schema
    if first:
        schema = T.StructType([*schema.fields, T.StructField(n_words, T.LongType()), T.StructField(hits, T.BinaryType()),
                               T.StructField(items, T.ArrayType(T.StringType()))])
    at = place(docs, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WindowAutomaton(sent.value)
        for batch in batches:
            counts, words_hit, item_lists = [], [], []
            before = ([None] * len(batch),) * 2
            if not first:
                before = column(batch, hits).to_pylist(), column(batch, items).to_pylist()
            for t, old_hits, old_items in zip(filled(batch.column(at)).to_pylist(), *before):
                words = normal_words(t)
                hit, names_hit = automaton.scan(words)
                if old_hits:
                    hit = np.union1d(hit, np.frombuffer(old_hits, np.int32)).astype(np.int32)
                counts.append(len(words))
                words_hit.append(hit.tobytes())
                names_hit = names_hit.union(old_items or ())
                item_lists.append([*sorted(names_hit - {None}), *[None] * (None in names_hit)])
            found = (pa.array(counts, pa.int64()), pa.array(words_hit, pa.binary()), pa.array(item_lists, pa.list_(pa.string())))
            if first:
                yield with_arrays(batch, dict(zip(names, found)))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *found], batch.schema.names)

    return map_batches(docs, scan, schema)


def scan_documents(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with three more columns and their names: word count, indexes of hit words (packed int32), items.

    Narrow and in one pass while the windows fit one block; otherwise one pass per block, each written before the next.
    """
    names = tuple(fresh_name(docs, n) for n in ("n_words", "hit_words", "hit_items"))
    out, first = docs, True
    for rows in window_blocks(benchmark_windows(items, item_key, item_text), block_bytes):
        if not first:
            out = written(out, "scan")
        out, first = _scanned(out, rows, text, names, first), False
    return out, names


def hit_spans(text: str, hits: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code point ranges of the original text."""
    spans: list[tuple[int, int]] = []
    hit, before = set(hits.tolist()), -2
    for i, m in enumerate(WORD.finditer(text)):
        if i in hit:
            if before == i - 1:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append(m.span())
            before = i
    return spans


def contamination_report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                         item_key: str = "item_id", item_text: str = "text",
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: n_words, n_hit, n_items, items_sha256, contaminated and the hit spans as ``start:end,...``."""
    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = dict(docs.dtypes)[key]
    scanned, (n_words, hits, found) = scan_documents(pairs, items, "text", item_key, item_text, block_bytes)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digests, spans = [], [], [], []
            for packed, names, t in zip(column(batch, hits).to_pylist(), column(batch, found).to_pylist(),
                                        column(batch, "shown").to_pylist()):
                at = np.frombuffer(packed, np.int32)
                n_hit.append(len(at))
                n_items.append(len(names))
                digests.append(sha256_hex(",".join(n for n in names if n is not None).encode()))
                spans.append(",".join(f"{b}:{e}" for b, e in hit_spans(t, at)) if len(at) else "")
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, n_words), pa.array(n_hit, long), pa.array(n_items, long),
                 pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), pa.array(spans, pa.string())],
                [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    shown = F.when(F.octet_length(hits) > 0, F.col("text"))  # only hit texts go on to have their spans found
    return map_batches(
        scanned.select("key", n_words, hits, found, shown.alias("shown")), digest,
        f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string")


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no window, with all their columns."""
    scanned, (_, hits, _) = scan_documents(docs, items, text, item_key, item_text, block_bytes)
    return scanned.where(F.octet_length(hits) == 0).select(*[scanned[c] for c in docs.columns])
