"""Helpers shared by the corpus operators: reading tables, folds, texts as Arrow and numpy arrays."""

from __future__ import annotations

import gc
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlspark.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null keys fall in no fold (null)."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def held_out(key: str, n: int, remainder: int) -> Column:
    """Whether a row is kept away from learning; rows without a key are not."""
    return F.coalesce(fold(key, n) == remainder, F.lit(False))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/urlspark-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PACKAGES = str(Path(__file__).resolve().parents[2])


def find_packages(spark: SparkSession) -> None:
    """Lets Python workers look for this package where the driver has it; clusters without that folder are sent it."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGES not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, PACKAGES])


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # of rows handed to Python at once; one larger row goes alone


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes, which the session keeps from then on; a task gives back what it held."""
    spark = df.sparkSession
    find_packages(spark)
    if spark.conf.get(BATCH) not in (str(BATCH_BYTES), f"{BATCH_BYTES}b"):
        spark.conf.set(BATCH, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches put together to ``least`` bytes or little more, for work that lists what is different in each."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) for c in table.columns], table.schema.names)

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(b.nbytes for b in held) >= least:
            yield whole()
            held = []
    if held:
        yield whole()


def place(df: DataFrame, name: str) -> int:
    """Where a column stands: the one of exactly that name, else the one that differs in case only."""
    exact = [i for i, c in enumerate(df.columns) if c == name] or [
        i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(exact) != 1:
        raise ValueError(f"{len(exact)} columns are called {name}")
    return exact[0]


def filled(strings: pa.Array) -> pa.Array:
    """Null as the empty text."""
    return pc.fill_null(strings, "")


def with_arrays(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with more columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column with null as the empty text."""
    return pc.fill_null(column(batch, name), "")


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; row i is bytes[offsets[i]:offsets[i + 1]]."""
    kind = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[strings.offset:strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def words(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space of all rows in order, and where each row's words begin (one more at the end)."""
    parts = pc.ascii_split_whitespace(strings)
    flat = parts.flatten()
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    seen = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), seen[ends]


def codes(strings: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Strings as numbers into the array of different strings."""
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range; empty ranges give 0."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` units together; a larger row stands alone, rows are never cut."""
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
