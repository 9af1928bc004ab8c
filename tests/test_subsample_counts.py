"""Digests of many texts at once, and subsamples from one pass of them."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.functions.digest import md5_of
from urlspark.operators import split


def test_digests_equal_the_library():
    rng = np.random.default_rng(0)
    texts = ["", None, "é漢😀", *["x" * n for n in range(45, 70)], *[str(v) for v in rng.integers(0, 10 ** 12, 5_000)]]
    array = pa.array(["gone", *texts], pa.string()).slice(1)
    prefixes, alone = [b"9|", b"42|", b"43|", b"100|"], [b"9", b"42", b"43", b"100"]
    first, last = md5_of(array, prefixes, alone)
    for r, prefix in enumerate(prefixes):
        for i, t in enumerate(texts):
            want = hashlib.md5(alone[r] if t is None else prefix + t.encode()).hexdigest()
            assert f"{int(first[r, i]):016x}{int(last[r, i]):016x}" == want


@pytest.mark.parametrize("n, window", [(0, 10.0), (1, 10.0), (7, 10.0), (5_000, 10.0), (5_000, -0.5)])
def test_counts_are_those_of_the_cuts(spark, monkeypatch, n, window):
    """Also where the window misses, with repeated keys and without rows."""
    monkeypatch.setattr(split, "WINDOW", window)
    df = spark.range(n, numPartitions=3).select(F.concat_ws("-", F.lit("key"), F.col("id") % 4_000).alias("row_id"))
    got = split.subsample_counts(df, 20, K.STABILITY_FRACTION)
    tagged = df.crossJoin(split.subsample_cuts(df, 20, K.STABILITY_FRACTION)).where(
        split.order_hash("row_id", F.col("run") + K.SEED) <= F.col("last_hash"))
    want = tagged.groupBy("row_id").agg(F.count("*").alias("runs"))
    got = got.groupBy("row_id").agg(F.sum("runs").alias("runs"))
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and (n < 2 or want.count() > 0)


def test_each_hash_is_made_once(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("hashed again")

    df = spark.range(1_000).select(F.col("id").alias("row_id"))
    monkeypatch.setattr(split, "subsample_cuts", never)
    assert split.subsample_counts(df, 4, 0.5).agg(F.sum("runs")).first()[0] == 4 * 500
