"""Blocks and the batches that hold them have some MB, whatever the rows' width, and a small fit is one task's."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from urlspark.operators import blocks, boost, l1
from urlspark.session import BATCH, BATCH_BYTES


def wide(spark, n, width):
    return spark.range(n, numPartitions=1).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.col("id") * i % 7).cast("double")).alias("x"))


@pytest.mark.parametrize("width", [100, 1_000])
def test_blocks_of_wide_rows_have_few_rows(spark, width):
    from pyspark.ml.functions import array_to_vector

    rows = wide(spark, 5_000, width).select("row_id", "label", array_to_vector("x").alias("features"))
    sizes = blocks.row_blocks(rows, "label", "features", F.lit(1).cast("long"), width).select("n", F.octet_length("vals").alias("b"))
    found = sizes.collect()
    assert sum(r.n for r in found) == 5_000 and max(r.b for r in found) <= 8 * blocks.BLOCK_VALUES
    edges = [np.array([1.0, 3.0])] * width
    found = boost.binned(rows, edges, "features", "label").select("n", F.octet_length("dense").alias("b")).collect()
    assert sum(r.n for r in found) == 5_000 and max(r.b for r in found) <= boost.ENTRIES_A_BLOCK
    assert spark.conf.get(BATCH) in (str(BATCH_BYTES), f"{BATCH_BYTES}b")
    assert blocks.block_session(spark).conf.get(BATCH) == str(BATCH_BYTES // 4)


@pytest.mark.parametrize("sparse, metric", [(False, 512), (True, 512), (True, 0)])
def test_one_task_fits_what_the_passes_fit(spark, monkeypatch, sparse, metric):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((500, 7)) < 0.4, rng.normal(size=(500, 7)), 0.0)
    y = (x[:, 0] + x[:, 1] + rng.logistic(size=500) > 0).astype(int)
    rows = [(i, int(c), Vectors.sparse(7, np.flatnonzero(r), r[r != 0]) if sparse else Vectors.dense(r))
            for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["row_id", "label", "features"]).repartition(3)
    members, found = [F.col("row_id") % 3 != r for r in range(3)], []
    monkeypatch.setattr(l1, "METRIC_SLOTS", metric)
    for limit in (l1.ALONE_VALUES, 0):
        monkeypatch.setattr(l1, "ALONE_VALUES", limit)
        found.append(l1.fit_l1(df, 0.5, members=members, max_iter=30))
    alone, passes = found
    assert np.allclose(alone.coefficients, passes.coefficients) and np.allclose(alone.intercepts, passes.intercepts)
    assert alone.passes == passes.passes and np.abs(alone.coefficients).max() > 0.1


def test_one_task_makes_all_passes(spark, monkeypatch):
    jobs, total = [], l1.total
    monkeypatch.setattr(l1, "total", lambda *a: (jobs.append(1), total(*a))[1])
    df = spark.createDataFrame([(int(i % 7 > 3), Vectors.dense(float(i % 5 + i % 7), 1.0)) for i in range(50)], ["label", "features"])
    assert l1.fit_l1(df, 1.0).passes > 1 and len(jobs) == 1


def test_tables_of_blocks_have_small_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    big = F.randstr(F.lit(1 << 20), F.lit(1)).cast("binary") if hasattr(F, "randstr") else F.unhex(F.repeat(F.lit("a7"), 1 << 20))
    names = [c.split()[0] for c in blocks.BLOCK_SCHEMA.split(", ")]
    rows = spark.range(40, numPartitions=1).select(F.lit(1).alias("n"), *[(big if c == "vals" else F.lit(b"")).alias(c) for c in names[1:]])
    blocks.write_blocks(rows, str(tmp_path / "blocks"))
    meta = pq.ParquetFile(glob.glob(str(tmp_path / "blocks" / "*.parquet"))[0]).metadata
    assert meta.num_rows == 40 and meta.num_row_groups > 1
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 20 << 20
