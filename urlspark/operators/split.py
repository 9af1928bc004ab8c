"""Stratified train/validation/test split and exact subsamples by hash order.

Rows are ordered by md5 of (seed, key). Instead of ranking a whole class in one task, the
exact cut hashes are found first: count rows per class and hash prefix, find the prefix in
which a cut falls, rank only that prefix's rows. The split itself is then a comparison with
a handful of cut values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.functions.digest import md5_of
from urlspark.session import bound_batches, scratch_path

MAX_RUNS = 63  # bits of a long
WINDOW = 10.0  # deviations around the hash where a cut is looked for first
PREFIX = 4  # hex digits: 16^4 hash ranges per class; 10^11 rows leave about 10^6 to rank in a range


def order_hash(key: str | Column, seed: int | Column = K.SEED) -> Column:
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    key_col = key if isinstance(key, Column) else F.col(key)
    return F.md5(F.concat_ws("|", seed_col.cast("string"), key_col.cast("string")))


def hash_ranges(hashed: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(stratum, range, n): rows per stratum and hash prefix; at most 16^prefix ranges per stratum."""
    return hashed.groupBy("stratum", F.left("h", F.lit(prefix)).alias("range")).agg(F.count(F.lit(1)).alias("n"))


def hash_cuts(hashed: DataFrame, ranges: DataFrame, quotas: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(stratum, cut, last_hash): the hash of the ``quota``-th row of each stratum.

    ``hashed`` has (stratum, h); ``quotas`` has (stratum, cut, quota), a few rows per stratum.
    The result is computed here and small: one row per quota.
    """
    spark = hashed.sparkSession
    upto = Window.partitionBy("stratum").orderBy("range")
    crossing = (
        ranges.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(quotas), "stratum")
        .filter((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("n") < F.col("quota")))
        .select("stratum", "cut", "range", (F.col("quota") - F.col("upto") + F.col("n")).cast("int").alias("rank"))
    )
    crossing = spark.createDataFrame(crossing.collect(), crossing.schema)  # one row per quota
    rows = hashed.withColumn("range", F.left("h", F.lit(prefix)))
    inside = rows.join(F.broadcast(crossing.select("stratum", "range").distinct()), ["stratum", "range"], "left_semi")
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("stratum", "range").orderBy("h")))
    cuts = ranked.join(F.broadcast(crossing), ["stratum", "range", "rank"]).select(
        "stratum", "cut", F.col("h").alias("last_hash")
    )
    return spark.createDataFrame(cuts.collect(), cuts.schema)


def _apportion(sizes: DataFrame, of: str, total: Column, out: str) -> DataFrame:
    """Share ``total`` among strata in proportion to ``of``: floors first, then largest remainders."""
    everything = Window.partitionBy()  # one row per class
    exact = F.col(of) * total / F.sum(of).over(everything)
    step = sizes.withColumn("_floor", F.floor(exact)).withColumn("_rest", exact - F.col("_floor"))
    step = step.withColumn("_left", total - F.sum("_floor").over(everything))
    step = step.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_rest"), "stratum")))
    extra = (F.col("_rank") <= F.col("_left")).cast("long")
    return step.withColumn(out, F.col("_floor") + extra).drop("_floor", "_rest", "_left", "_rank")


def split_sizes(strata: DataFrame, val: float = K.VAL_SHARE, test: float = K.TEST_SHARE) -> DataFrame:
    """(stratum, n, n_train, n_val, n_test) from (stratum, n): hold-out rounded up, then halved likewise."""
    everything = Window.partitionBy()
    sizes = strata.withColumn("_all", F.sum("n").over(everything))
    # ceil on a value cleaned of binary noise, e.g. 0.1 + 0.1 or 0.7 * 10
    held = F.ceil(F.round(F.col("_all") * F.lit(val + test), 6))
    sizes = _apportion(sizes, "n", F.col("_all") - held, "n_train")
    sizes = sizes.withColumn("_held", F.col("n") - F.col("n_train")).withColumn("_heldall", F.sum("_held").over(everything))
    in_test = F.ceil(F.round(F.col("_heldall") * F.lit(test / (val + test)), 6))
    sizes = _apportion(sizes, "_held", F.col("_heldall") - in_test, "n_val")
    return sizes.select("stratum", "n", "n_train", "n_val", (F.col("_held") - F.col("n_val")).alias("n_test"))


def stratified_split(df: DataFrame, label: str = "label", key: str = "row_id", seed: int = K.SEED,
                     val: float = K.VAL_SHARE, test: float = K.TEST_SHARE) -> DataFrame:
    """Input plus ``split`` in train/val/test with exact per-class sizes.

    ``key`` must identify a row. Two light scans find the cuts, then each row is placed
    by itself; the big table is never shuffled.
    """
    hashed = df.select(F.col(label).alias("stratum"), order_hash(key, seed).alias("h"))
    ranges = hash_ranges(hashed).persist()
    sizes = split_sizes(ranges.groupBy("stratum").agg(F.sum("n").alias("n")), val, test)
    quotas = sizes.select(
        "stratum",
        F.explode(F.array(
            F.struct(F.lit("train").alias("cut"), F.col("n_train").alias("quota")),
            F.struct(F.lit("val").alias("cut"), (F.col("n_train") + F.col("n_val")).alias("quota")),
        )).alias("q"),
    ).select("stratum", "q.*")
    found = hash_cuts(hashed, ranges, quotas)
    ranges.unpersist()
    cuts = found.groupBy(F.col("stratum").alias(label)).agg(
        F.max(F.when(F.col("cut") == "train", F.col("last_hash"))).alias("_train"),
        F.max(F.when(F.col("cut") == "val", F.col("last_hash"))).alias("_val"),
    )
    h = order_hash(key, seed)
    place = F.when(h <= F.col("_train"), "train").when(h <= F.col("_val"), "val").otherwise("test")
    # one cut row per class, two classes here
    return df.join(F.broadcast(cuts), label, "left").withColumn("split", place).select(*df.columns, "split")


def split_distribution(split: DataFrame, label: str = "label") -> DataFrame:
    return split.groupBy("split", label).agg(F.count(F.lit(1)).alias("n"))


def subsample_cuts(df: DataFrame, runs: int, fraction: float, key: str = "row_id", seed: int = K.SEED) -> DataFrame:
    """(run, last_hash): row belongs to run r iff md5(seed+r, key) <= last_hash; exactly int(fraction*n) rows."""
    seeds = [seed + r for r in range(runs)]
    hashed = df.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("stratum"), order_hash(key, s).alias("h")) for r, s in enumerate(seeds)
    ])).alias("x")).select("x.*")
    ranges = hash_ranges(hashed).persist()
    n = ranges.filter(F.col("stratum") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    quotas = df.sparkSession.createDataFrame([(r, "sample", int(fraction * n)) for r in range(runs)],
                                             "stratum int, cut string, quota long")
    cuts = hash_cuts(hashed, ranges, quotas)
    ranges.unpersist()
    return cuts.select(F.col("stratum").alias("run"), "last_hash")


def subsample_counts(df: DataFrame, runs: int, fraction: float, key: str = "row_id", seed: int = K.SEED) -> DataFrame:
    """(key, runs): of how many subsamples each row is part, as ``subsample_cuts`` has them; rows of none are left out.

    Each hash is made once. Hashes lie evenly, so a cut lies within a few deviations of the quota's share of all hashes: a row
    below that window is in, one above is out, and only the hashes inside are kept and ranked, some sqrt(n) a run. Where a
    window misses its cut, the cuts are found by ``subsample_cuts``.
    """
    n = df.count()
    quota = int(fraction * n)
    share, room = quota / max(n, 1), WINDOW * (quota * (1 - quota / max(n, 1))) ** 0.5 / max(n, 1) + 10 / max(n, 1)
    low, high = (np.uint64(min(max(int(s * 2.0 ** 64), 0), 2 ** 64 - 1)) for s in (share - room, share + room))
    if runs <= MAX_RUNS:
        rows = _hashed_once(df, runs, key, seed, low, high)
        cuts = _window_cuts(rows, runs, quota)
        if cuts is not None:
            last = F.array(*[F.lit(c) for c in cuts])
            inside = F.size(F.filter("near", lambda x: x["h"] <= F.get(last, x["run"])))
            return rows.select(key, (F.bit_count("sure") + inside).cast("long").alias("runs")).where("runs > 0")
    cuts = subsample_cuts(df, runs, fraction, key, seed).collect()  # one per run
    inside = [(order_hash(key, seed + c.run) <= c.last_hash).cast("long") for c in cuts]
    return df.select(key, sum(inside, F.lit(0).cast("long")).alias("runs")).where("runs > 0")


def _hashed_once(df: DataFrame, runs: int, key: str, seed: int, low: np.uint64, high: np.uint64) -> DataFrame:
    """(key, sure, near), written: a bit for each run whose hash lies below the window, and the hashes inside it."""
    bound_batches(df.sparkSession)
    alone = [str(seed + r).encode() for r in range(runs)]
    prefixes = [a + b"|" for a in alone]

    def measure(batches):
        for batch in batches:
            first, rest = md5_of(batch.column(1), prefixes, alone)
            sure = np.zeros(len(batch), np.int64)
            for r in range(runs):
                sure |= (first[r] < low).astype(np.int64) << r
            row, run = np.nonzero(((first >= low) & (first <= high)).T)
            names = [f"{a:016x}{b:016x}" for a, b in zip(first[run, row].tolist(), rest[run, row].tolist())]
            ends = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            near = pa.StructArray.from_arrays([pa.array(run, pa.int32()), pa.array(names, pa.string())], ["run", "h"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sure), pa.ListArray.from_arrays(pa.array(ends), near)], [key, "sure", "near"])

    path, kind = scratch_path(df.sparkSession, "subsamples"), df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, sure long, near array<struct<run: int, h: string>>"
    df.select(key, F.col(key).cast("string").alias("_text")).mapInArrow(measure, schema).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _window_cuts(rows: DataFrame, runs: int, quota: int) -> list[str] | None:
    """Per run the hash of its last row, the empty string where it has none; None if a cut lies outside its window."""
    if not quota:
        return [""] * runs
    below = rows.agg(*[F.sum(F.expr(f"shiftright(sure, {r}) & 1")) for r in range(runs)]).first()
    wanted = [quota - (b or 0) for b in below]
    inside = rows.where(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.*")
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy("h")))
    last = F.get(F.array(*[F.lit(w) for w in wanted]), F.col("run"))
    found = {r.run: r.h for r in ranked.where(F.col("rank") == last).collect()}  # one per run
    return [found[r] for r in range(runs)] if len(found) == runs else None
