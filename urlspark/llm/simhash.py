"""Near-duplicates by SimHash: fingerprints, pigeonring candidates, full Hamming check, components.

Texts are lower-cased (A-Z), cut into words at ASCII white space and hashed as word shingles (XXH64, seed 42);
a text with fewer words is one shingle, one without words (null too) has fingerprint zero and links like any other.
Equal fingerprints are one node from the start, so copies are never paired. Rows without a key are linked, but never
name a component; a component without any key has a null id. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlspark.llm.common import fresh_name, map_batches, texts, written
from urlspark.session import cut_lineage

SEED = 42
DISTANCE = 2  # differing bits that still link
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
BUCKET = 64  # different fingerprints that are paired directly; fuller buckets go the way of centres
SHINGLES_AT_ONCE = 1 << 18


def fingerprint(text: str, size: int = 3) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, n, SHINGLES_AT_ONCE):
        cuts = zip(begins[a:min(n, a + SHINGLES_AT_ONCE)].tolist(), last[a:a + SHINGLES_AT_ONCE].tolist())
        hashes = np.array([digest(joined[b:e], SEED) for b, e in cuts], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", size: int = 3, keep_text: bool = True) -> DataFrame:
    """``docs`` with the fingerprint as a signed long in the new last column ``name``; on request without the text."""
    copy = fresh_name(docs, "text_hashed")
    kept = [f for f in docs.schema.fields if keep_text or f.name != text]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t, size) for t in texts(batch, copy).to_pylist()], np.uint64).view(np.int64)
            arrays = dict(zip(batch.schema.names, batch.columns))
            del arrays[copy]
            yield pa.RecordBatch.from_arrays([*arrays.values(), pa.array(marks, pa.int64())], [*arrays, name])

    source = docs.select(*[docs[f.name] for f in kept], docs[text].alias(copy))
    return map_batches(source, add, T.StructType([*kept, T.StructField(name, T.LongType())]))


def _bits(begin: int, end: int) -> int:
    return (1 << end) - (1 << begin)


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def _ring() -> list[int]:
    """Bit masks of the segments: one more than differing bits allowed."""
    n = DISTANCE + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [_bits(a, b) for a, b in zip(cuts, cuts[1:])]


def _halves(segment: int) -> tuple[int, int]:
    begin, end = (segment & -segment).bit_length() - 1, segment.bit_length()
    middle = (begin + end) // 2
    return _bits(begin, middle), _bits(middle, end)


def chain_keys(mark: Column) -> Column:
    """What two fingerprints share if some chain of segments stays within its budgets.

    With t differing bits over t + 1 segments in a ring there is a segment from which every chain of l segments
    differs in at most l * t / (t + 1) bits: the first in none, the first two together in at most one. So the first
    segment and one half of the second are equal; those bits are the key.
    """
    ring = _ring()
    masks = [seg | half for i, seg in enumerate(ring) for half in _halves(ring[(i + 1) % len(ring)])]
    return F.array(*[
        F.struct(F.lit(i).alias("kind"), mark.bitwiseAND(_signed(m)).alias("key")) for i, m in enumerate(masks)
    ])


def within_budgets(a: Column, b: Column, kind: Column) -> Column:
    """Whether each chain that begins at the key's segment keeps its budget."""
    ring, n = _ring(), DISTANCE + 1
    differ, checks = a.bitwiseXOR(b), F.lit(False)
    for i in range(n):
        chain, held = 0, F.floor(kind / 2) == i
        for l in range(1, n):
            chain |= ring[(i + l - 1) % n]
            held &= F.bit_count(differ.bitwiseAND(_signed(chain))) <= l * DISTANCE // n
        checks |= held
    return checks


def links(marks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v) with u > v: enough links between different fingerprints for exact components.

    ``marks`` has the different fingerprints (fp). Buckets of up to ``bucket`` are paired, filtered by the chains and
    then by all bits. Fingerprints of fuller buckets are dealt to their 65 centres within one bit: any two share a
    centre exactly if they differ in at most two bits, and each links to the least of its centre, so that no group's
    pairs are written out.
    """
    keys = marks.select("fp", F.explode(chain_keys(F.col("fp"))).alias("k")).select("fp", "k.kind", "k.key")
    sizes = keys.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(keys.join(sizes, ["kind", "key"]))
    few = shared.where(F.col("n") <= bucket)
    pairs = (
        few.select("kind", "key", F.col("fp").alias("u"))
        .join(few.select("kind", "key", F.col("fp").alias("v")), ["kind", "key"])
        .where(F.col("u") > F.col("v"))
        .where(within_budgets(F.col("u"), F.col("v"), F.col("kind")))
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE)
        .select("u", "v")
    )
    crowd = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[_signed(1 << b) for b in range(64)])
    dealt = crowd.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("centre"))
    least = dealt.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = dealt.join(least, "centre").where("fp > v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node that has a smaller one in its component, with the smallest. ``edges`` has u > v.

    Alternates two steps until nothing changes: each node hands its larger neighbours, then its smaller ones, to the
    least it knows. Rounds grow with the logarithm of the component's size; each is checkpointed.
    """

    def state(df: DataFrame):
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    edges = cut_lineage(edges)
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    return edges


def _labelled(first: DataFrame) -> DataFrame:
    """(fp, low) to (fp, low of the whole component). ``first`` has each fingerprint once and is read twice."""
    roots = components(links(first.select("fp"))).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = rooted.groupBy("root").agg(F.min("low").alias("whole"))
    return rooted.join(low, "root").select("fp", F.col("whole").alias("low"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """Per row: key, fingerprint as 16 hex digits, component_id (smallest key that is reachable)."""
    slim = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    rows = written(with_fingerprint(slim, "fp", "text", size, keep_text=False), "simhash")
    first = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low")))
    named = rows.join(_labelled(first), "fp")
    return named.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("low").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """One row of each component, with all its columns: the one of smallest key, any one of equals."""
    mark, row = fresh_name(docs, "fp"), fresh_name(docs, "row_number")
    numbered = with_fingerprint(docs, mark, text, size).withColumn(row, F.monotonically_increasing_id())
    hashed = written(numbered, "simhash-docs")  # from here on each row keeps its number
    low = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(row).alias("row"))).alias("low")
    first = cut_lineage(hashed.groupBy(F.col(mark).alias("fp")).agg(low))
    chosen = _labelled(first).select(F.col("low.row").alias(row)).distinct()
    return hashed.join(chosen, row, "left_semi").select(*[hashed[c] for c in docs.columns])
