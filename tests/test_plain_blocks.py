"""Narrow vectors go to Python as plain arrays: the same blocks, cuts and sums as through vectors."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.operators import blocks, boost, l1, split
from workload import data, queries


@pytest.fixture(scope="module")
def mixed(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(400):
        x = np.where(rng.random(6) < (0.1, 0.9, 0.5, 0.0, 1.0, 0.2), rng.normal(size=6).round(1), 0.0)
        x[5] = np.nan if i % 50 == 0 else x[5]
        held = np.flatnonzero(x != 0)
        rows.append((int(i % 3 == 0), Vectors.sparse(6, held, x[held]) if i % 2 else Vectors.dense(x)))
    return spark.createDataFrame(rows, ["label", "features"]).coalesce(1)


def test_blocks_and_edges_are_those_of_vectors(mixed, monkeypatch):
    edges = boost.feature_edges(mixed)
    plain = boost.binned(mixed, edges, "features", "label")
    got = plain.collect()
    monkeypatch.setattr(boost, "DENSE_SLOTS", 0)
    assert all((a == b).all() for a, b in zip(edges, boost.feature_edges(mixed), strict=True))
    assert got == boost.binned(mixed, edges, "features", "label").collect()


def test_row_blocks_hold_the_same_values(mixed):
    w, one = np.arange(6.0)[:, None], F.lit(1).cast("long")
    found = []
    for width in (6, None):
        batch = blocks.row_blocks(mixed, "label", "features", one, width).toArrow().to_batches()[0]
        y, member, times, *_ = blocks.reader(6, 1)(batch, 0)
        found.append((y, member, times(w)))
    assert all(np.allclose(a, b, equal_nan=True) for a, b in zip(*found))


def test_subsample_runs_write_no_row_per_run(spark, sf):
    plan = queries.subsample_runs(spark, sf)
    assert "Generate" not in plan._jdf.queryExecution().optimizedPlan().toString()
    rows = data.numeric_rows(spark, sf).select("row_id")
    cuts = split.subsample_cuts(rows, K.STABILITY_RUNS, K.STABILITY_FRACTION)
    tagged = rows.crossJoin(cuts).where(split.order_hash("row_id", F.col("run") + K.SEED) <= F.col("last_hash"))
    assert plan.exceptAll(tagged.groupBy("row_id").agg(F.count("*").alias("runs"))).count() == 0 < plan.count()


def test_blocks_are_read_a_few_at_a_time(mixed, monkeypatch):
    asked, total = [], l1.total

    def seen(found, *rest):
        asked.append(found.sparkSession.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
        return total(found, *rest)

    monkeypatch.setattr(l1, "total", seen)
    l1.fit_l1(mixed.where("label IS NOT NULL").limit(40), 0.1, max_iter=1)
    assert set(asked) == {str(blocks.BLOCKS_AT_ONCE)}
