"""Source divergence audit: term shares of each source against the other sources and the whole of its language.

Terms are runs of letters and of anything beyond ASCII, A-Z lower-cased. Per shard (some MB of an Arrow batch) pointers to
the beginnings of words in the text buffer are sorted by a multikey quicksort whose digits are slices of eight bytes:
pointers still equal after a slice are sorted on by the next one. A run of equal pointers is a term; the rows behind it
give document frequency and the count of each source. Spark adds the shards up.

Null text, language and source are read as empty strings. Every (language, source) that occurs is reported against the
others, even without terms. Repeated rows are documents of their own. Ties go to the lesser item by UTF-8. An empty
table gives an empty result. All shares are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlspark.llm.common import column, map_batches, slices, texts, utf8, written
from urlspark.session import lookup_join

MIN_DOCS = 30  # documents of a language that a term needs
UNIT = 1_000_000_000  # shares are whole parts of it
PRIOR = 5  # added to each count
TOP = 50  # terms reported a group
SHARD_BYTES = 4_000_000  # of text sorted at once; one longer text is sorted alone
SLICE = 8  # bytes compared at once
CELLS = 1 << 20  # terms x sources of shares held at once
SOURCES_HELD = 1_024  # sources of a language whose pair sums a task keeps; beyond, they are handed on batch by batch

LETTERS = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def word_pointers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, sizes) of the words in the bytes of several texts; words end where their text does."""
    inside = LETTERS[raw]
    change = np.zeros(len(raw) + 1, bool)
    change[0], change[-1] = True, True
    change[1:-1] = inside[1:] != inside[:-1]
    change[offsets] = True
    cuts = np.flatnonzero(change)
    begins, sizes = cuts[:-1], np.diff(cuts)
    held = inside[begins] if len(begins) else np.zeros(0, bool)
    return begins[held], sizes[held]


def _digit(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as one number in byte order, zeros after the word's end."""
    words = np.lib.stride_tricks.as_strided(data, (len(data) - SLICE + 1, SLICE), (1, 1))
    digit = words[at].view(">u8").ravel().astype(np.uint64)
    drop = (8 * np.clip(SLICE - left, 0, SLICE - 1)).astype(np.uint64)
    return np.where(left > 0, digit >> drop << drop, np.uint64(0))


def sort_pointers(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the pointers by word, ties in their given order; whether each place begins a new word).

    ``data`` must go on for eight bytes after the last word. Words hold no zero bytes, so one that has ended is told from
    one that goes on by its next slice.
    """
    n = len(begins)
    order, head = np.arange(n), np.zeros(n, bool)
    head[:1] = True
    slots, group, depth = np.arange(n), np.zeros(n, np.int64), 0
    while len(slots):
        at = order[slots]
        digit = _digit(data, begins[at] + depth, sizes[at] - depth)
        by = np.argsort(digit, kind="stable") if depth == 0 else np.lexsort((digit, group))
        digit, group, at = digit[by], group[by], at[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        head[slots] |= new
        last = np.append(new[1:], True)
        depth += SLICE
        open_ = ~(new & last) & (sizes[at] >= depth)  # equal so far, and some may go on
        group = np.cumsum(new)[open_]
        slots = slots[open_]
    return order, head


def shard_terms(strings: pa.Array, group: np.ndarray, n_groups: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, documents, occurrences) of every term and group of the given texts; ``group`` is that of each text."""
    raw, offsets = utf8(strings)
    begins, sizes = word_pointers(raw, offsets)
    none = np.zeros(0, np.int64)
    if not len(begins):
        return pa.array([], pa.string()), none, none, none
    data = np.concatenate([LOWER[raw], np.zeros(SLICE, np.uint8)])
    row = np.searchsorted(offsets, begins, side="right") - 1
    order, head = sort_pointers(data, begins, sizes)
    run = np.cumsum(head) - 1
    row = row[order]  # ascending within a run
    own = group[row]
    fresh = head.copy()
    fresh[1:] |= row[1:] != row[:-1]
    by = np.argsort(run * n_groups + own, kind="stable")  # sources of a run together
    key = (run * n_groups + own)[by]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    lead = order[head][key[cuts] // n_groups]
    count = np.diff(np.append(cuts, len(key)))
    docs = np.add.reduceat(fresh[by].astype(np.int64), cuts)
    size = sizes[lead]
    ends = np.cumsum(size)
    flat = data[np.arange(ends[-1]) + np.repeat(begins[lead] - (ends - size), size)]
    spelled = pa.Array.from_buffers(pa.large_string(), len(size), [
        None, pa.py_buffer(np.append(0, ends).astype(np.int64)), pa.py_buffer(flat)])
    return spelled.cast(pa.string()), key[cuts] % n_groups, docs, count


def group_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n) of ``docs`` (text, lang, source), one row a shard, group and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "docs", "n"]
        for batch in batches:
            strings = texts(batch)
            pairs = [column(batch, c).dictionary_encode() for c in ("lang", "source")]
            lang, source = (p.indices.to_numpy(zero_copy_only=False).astype(np.int64) for p in pairs)
            width = max(len(pairs[1].dictionary), 1)
            groups, own = np.unique(lang * width + source, return_inverse=True)
            for a, b in slices(np.diff(utf8(strings)[1]), SHARD_BYTES):
                term, group, held, n = shard_terms(strings.slice(a, b - a), own[a:b], len(groups))
                code = groups[group]
                yield pa.RecordBatch.from_arrays([
                    pairs[0].dictionary.take(pa.array(code // width)), pairs[1].dictionary.take(pa.array(code % width)),
                    term, pa.array(held, pa.int64()), pa.array(n, pa.int64())], names)

    return map_batches(docs, count, "lang string, source string, term string, docs long, n long")


def kept_terms(parts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, sources [(source, n)]) of the terms that enough documents of the language hold."""
    summed = parts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return summed.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("sources"),  # one entry a source
    ).where(F.col("docs") >= min_docs).select("lang", "term", "sources")


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (count + PRIOR) / (total + PRIOR terms)); decimals, so that large counts don't overflow."""
    above = f"cast({count} + {PRIOR} AS decimal(20,0)) * cast({UNIT} AS decimal(10,0))"
    return F.expr(f"1 + ({above}) div cast({total} + {PRIOR} * {terms} AS decimal(20,0))")


def source_shares(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, place, base) and shares (lang, term, source, place, p, q) of kept terms that a group has.

    ``place`` numbers the sources of a language from 0, ``base`` is the share of a kept term that the group lacks (null
    without kept terms), p the group's share of the term and q the language's.
    """
    kept = written(kept_terms(group_terms(docs), min_docs), "divergence-kept")
    flat = kept.select("lang", "term", F.expr("aggregate(sources, 0L, (a, s) -> a + s.n)").alias("whole"), F.inline("sources"))
    own = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(
        0, ["total", "terms"])
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumns({
        "all": F.sum("total").over(by_lang), "place": F.row_number().over(by_lang.orderBy("source")) - 1,
        "base": F.when(F.col("terms") > 0, _share("0", "total", "nullif(terms, 0)")),
    })
    groups = written(groups, "divergence-groups")
    shares = lookup_join(flat, groups, ["lang", "source"]).select(
        "lang", "term", "source", "place", _share("n", "total", "terms").alias("p"), _share("whole", "all", "terms").alias("q"))
    return groups.select("lang", "source", "place", "base"), written(shares, "divergence-shares")


def pair_sums(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: places of two sources and the sum of absolute differences over all kept terms.

    A task adds up its terms as a matrix of sources, so no pairs of a term are written.
    """
    rows = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p")).alias("cells"))  # one a source
    bases = groups.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "base"))), lambda g: g["base"])
                                       .alias("bases"))
    rows = lookup_join(rows, bases, ["lang"]).select("lang", "bases", "cells")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out(lang: str, a: int, sums: np.ndarray) -> pa.RecordBatch:
            n, long = len(sums), pa.int64()
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array(np.full(n, a, np.int32)),
                 pa.array(np.arange(a + 1, a + 1 + n, dtype=np.int32)), pa.array(sums, long)], ["lang", "a", "b", "value"])

        for batch in batches:
            langs = column(batch, "lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == code))
                n = len(column(own, "bases")[0])
                for begin in range(0, len(own), max(1, CELLS // n)):
                    part = own.slice(begin, max(1, CELLS // n))
                    share = column(part, "bases").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n)
                    cells = column(part, "cells")
                    at = np.repeat(np.arange(len(part)), cells.value_lengths().to_numpy(zero_copy_only=False))
                    place, p = (cells.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    share = share.copy()
                    share[at, place] = p
                    for a in range(n - 1):
                        sums = np.abs(share[:, a + 1:] - share[:, a:a + 1]).sum(axis=0)
                        if n > SOURCES_HELD:
                            yield out(lang, a, sums)
                        else:
                            held.setdefault(lang, np.zeros((n, n), np.int64))[a, a + 1:] += sums
        for lang, sums in held.items():
            for a in range(len(sums) - 1):
                yield out(lang, a, sums[a, a + 1:])

    parts = map_batches(rows, add_up, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
          top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): distance to each other source, and the terms a source overuses most."""
    docs = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    groups, shares = source_shares(docs, min_docs)
    sums = pair_sums(groups, shares)
    both = sums.select("lang", "a", "b", "value").union(sums.select("lang", F.col("b"), F.col("a"), "value"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    pairs = groups.select("lang", "source", F.col("place").alias("a")).join(others, "lang").where("a != b")  # the result's rows
    pairs = pairs.join(both, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(best))
    return ranked.union(terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
