"""Rows of vectors as blocks of plain arrays, and sums over all blocks, for operators that pass over the rows many times."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlspark.session import BATCH_BYTES, bound_batches

BLOCK_SCHEMA = "n int, y binary, member binary, ends binary, slots binary, vals binary"
BLOCK_ROWS = 8_192
BLOCK_VALUES = 1 << 17  # a block of longer rows has fewer
ROWS_A_REDUCER = 500_000
BLOCKS_AT_ONCE = 8  # read from Parquet; the default of 4,096 would hold a whole row group of them
DENSE_SLOTS = 128  # vectors of up to so many slots go to Python as plain arrays, much faster than as vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no package of ours


def write_blocks(blocks: DataFrame, path: str) -> None:
    """A table of blocks. Parquet's writer looks at what it holds after 100 rows by default, which is too late for such rows."""
    options = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1,
               "parquet.enable.dictionary": "false"}
    blocks.write.options(**options).parquet(path)


def row_blocks(rows: DataFrame, label: str, vector: str, member: Column, width: int | None = None) -> DataFrame:
    """Blocks of rows: labels, run bits, and the values by row (all slots, or slots and values where vectors are sparse).

    ``width`` is the vectors' size where it is known; up to DENSE_SLOTS all slots are spelled out. Blocks have some MB at
    most, and so have the batches of rows they are made of.
    """
    bound_batches(rows.sparkSession)

    def at_once(batch):
        x = batch.column("x")
        values = len(x.flatten() if plain else x.field("values").flatten()) // max(1, len(batch))
        return min(BLOCK_ROWS, max(1, BLOCK_VALUES // max(1, values)))

    def pack(batches):
        for whole in batches:
            step = at_once(whole)
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                x = batch.column("x")
                y = batch.column("y").to_numpy(zero_copy_only=False) == 1
                bits = batch.column("member").to_numpy(zero_copy_only=False).astype(np.int64)
                if plain:
                    yield block(y, bits, np.arange(1, len(batch) + 1) * width, np.zeros(0, np.int32),
                                x.flatten().to_numpy(zero_copy_only=False))
                    continue
                kinds, values = x.field("type").to_numpy(zero_copy_only=False), x.field("values")
                sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                vals, slots = values.flatten().to_numpy(zero_copy_only=False), np.zeros(0, np.int32)
                if not kinds.all():
                    slots = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                    slots[np.repeat(kinds == 0, sizes)] = x.field("indices").flatten().to_numpy(zero_copy_only=False)
                yield block(y, bits, np.cumsum(sizes), slots, vals)

    def block(y, bits, ends, slots, vals):
        arrays = (y.astype(np.float64), bits, ends, slots, vals.astype(np.float64))
        return pa.RecordBatch.from_arrays(
            [pa.array([len(y)], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names)

    names, plain = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")], bool(width) and width <= DENSE_SLOTS
    x = vector_to_array(F.col(vector)) if plain else F.col(vector)
    return rows.select(F.col(label).cast("int").alias("y"), member.alias("member"), x.alias("x")).mapInArrow(pack, BLOCK_SCHEMA)


def block_session(spark: SparkSession) -> SparkSession:
    """A session for many small jobs over blocks: planned without adaptive steps, blocks read a few at a time."""
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BLOCKS_AT_ONCE))
    bound_batches(own, BATCH_BYTES // 4)  # a few blocks
    return own


def reader(width: int, runs: int):
    """Function from a block to (labels, memberships rows x runs, times, back, pick).

    ``times(w)`` is the rows' products with a matrix of slots x k, ``back(r)`` the slots' products with one of rows x k,
    ``pick(slots, a, b)`` the values of some slots in the rows from a to b.
    """
    def read(batch, i: int):
        y, bits, ends, slots, vals = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (
            ("y", np.float64), ("member", np.int64), ("ends", np.int64), ("slots", np.int32), ("vals", np.float64)))
        member = (bits[:, None] >> np.arange(runs) & 1).astype(np.float64)
        if not len(slots):
            x = vals.reshape(len(y), width)
            return y, member, lambda w: x @ w, lambda r: x.T @ r, lambda slots, a, b: x[a:b, slots]
        row = np.repeat(np.arange(len(y)), np.diff(ends, prepend=0))

        def times(w):
            return np.stack([np.bincount(row, weights=vals * w[slots, k], minlength=len(y)) for k in range(w.shape[1])], axis=1)

        def back(r):
            return np.stack([np.bincount(slots, weights=vals * r[row, k], minlength=width) for k in range(r.shape[1])], axis=1)

        def pick(wanted, a, b):
            place = np.full(width, -1)
            place[wanted] = np.arange(len(wanted))
            begin, end = (ends[a - 1] if a else 0), ends[b - 1]
            column = place[slots[begin:end]]
            held, out = column >= 0, np.zeros((b - a, len(wanted)))
            out[row[begin:end][held] - a, column[held]] = vals[begin:end][held]
            return out

        return y, member, times, back, pick

    return read


def summed(blocks: DataFrame, one_block, size: int) -> DataFrame:
    """(cell, v): sum of ``one_block`` (batch, i) -> ``size`` numbers over all blocks; a task hands on one row a cell."""

    def add_up(batches):
        total = np.zeros(size)
        for batch in batches:
            for i in range(len(batch)):
                total += one_block(batch, i).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["cell", "v"])

    parts = blocks.rdd.getNumPartitions()
    reducers = max(1, min(parts, parts * size // ROWS_A_REDUCER))
    return blocks.mapInArrow(add_up, "cell int, v double").repartition(reducers, "cell").groupBy("cell").agg(F.sum("v").alias("v"))


def total(blocks: DataFrame, one_block, shape: tuple[int, ...]) -> np.ndarray:
    """The same as an array of this shape on the driver."""
    size = int(np.prod(shape))
    found, out = summed(blocks, one_block, size).toArrow(), np.zeros(size)
    out[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(shape)


def total_here(batches: list[pa.RecordBatch], one_block, shape: tuple[int, ...]) -> np.ndarray:
    """``total`` of blocks that are in this process."""
    out = np.zeros(int(np.prod(shape)))
    for batch in batches:
        for i in range(len(batch)):
            out += np.asarray(one_block(batch, i)).ravel()
    return out.reshape(shape)


def moments(blocks, width: int, crossed: bool, total=total) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(means, deviations, covariance or None) of the slots over all rows."""
    read = reader(width, 1)

    def first(batch, i):
        y, _, _, back, _ = read(batch, i)
        return np.append(back(np.ones((len(y), 1))).ravel(), len(y))

    sums = total(blocks, first, (width + 1,))
    n, means = max(sums[-1], 1.0), sums[:-1] / max(sums[-1], 1.0)

    def second(batch, i):
        y, _, times, back, _ = read(batch, i)
        if not crossed:  # (x - mean)^2 from sums around the mean, with sparse values
            slots, vals = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (("slots", np.int32), ("vals", np.float64)))
            at = slots if len(slots) else np.tile(np.arange(width), len(y))
            held = np.bincount(at, minlength=width)
            return np.bincount(at, weights=(vals - means[at]) ** 2, minlength=width) + (len(y) - held) * means ** 2
        x = times(np.eye(width)) - means
        return x.T @ x

    spread = total(blocks, second, (width, width) if crossed else (width,)) / n
    variance = np.diag(spread) if crossed else spread
    deviations = np.sqrt(np.where(variance > 1e-12 * np.maximum(means ** 2, 1e-300), variance, 0.0))
    return means, deviations, spread if crossed else None
