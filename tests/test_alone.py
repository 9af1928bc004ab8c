"""Boosting by one task and by a job a pass: the same trees, grouped rows or not."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tests.test_sparse_boost import frame, sparse_rows
from urlspark.operators import boost


def repeated(spark, times):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 5, (300, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 1)).astype(int)
    rows = [(int(c), Vectors.dense(r)) for r, c in zip(x, y)] * times
    return spark.createDataFrame(rows, ["label", "features"]).repartition(3)


@pytest.mark.parametrize("sparse, width", [(False, 20), (True, 20), (True, 200)])
def test_one_task_grows_the_trees_of_the_passes(spark, monkeypatch, sparse, width):
    x, y = sparse_rows(900, width, 0.1)
    x[:5, 3] = np.nan
    x[5:9, 4] = -1.0
    df, found = frame(spark, x, y, sparse).repartition(3), []
    for limit in (boost.ALONE_BYTES, 0):
        monkeypatch.setattr(boost, "ALONE_BYTES", limit)
        history = []
        nodes = boost.fit_focal_boost(df, rounds=4, max_leaves=9, min_child=10, history=history, checkpoint_every=2).nodes
        found.append((nodes, history))
    (alone, losses), (passes, want) = found
    assert alone.drop(columns=["threshold", "value"]).equals(passes.drop(columns=["threshold", "value"]))
    assert np.allclose(alone[["threshold", "value"]], passes[["threshold", "value"]]) and np.allclose(losses, want)
    assert (alone.leaf >= 0).sum() > 12


def test_one_task_takes_one_job(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a job a pass")

    monkeypatch.setattr(boost, "_fitted_by_passes", never)
    assert boost.fit_focal_boost(repeated(spark, 1), rounds=30, max_leaves=4, min_child=5).nodes.tree.nunique() == 30


@pytest.mark.parametrize("limit", [boost.ALONE_BYTES, 0])
def test_equal_rows_are_one_group(spark, monkeypatch, limit):
    """Seven copies of each row weigh seven times as much as one."""
    monkeypatch.setattr(boost, "ALONE_BYTES", limit)
    df = repeated(spark, 7)
    edges = boost.feature_edges(df)
    groups = boost.grouped(boost.binned(df, edges, "features", "label"), edges).collect()
    assert sum(r.held for r in groups) == 2_100 and sum(r.n for r in groups) == df.distinct().count() < 300
    grown = boost.fit_focal_boost(df, rounds=2, max_leaves=5, min_child=70).nodes
    monkeypatch.setattr(boost, "DENSE_SLOTS", 0)  # no groups
    plain = boost.fit_focal_boost(df, rounds=2, max_leaves=5, min_child=70).nodes
    assert np.allclose(grown, plain) and grown.cover[0] == 2_100


@pytest.mark.parametrize("dense", [True, False])
def test_blocks_leave_out_the_usual_bin(spark, monkeypatch, dense):
    """Slots that mostly are 2 or, centred, -0.3: few entries are held, and zeros that a sparse vector leaves out are told."""
    monkeypatch.setattr(boost, "DENSE_SLOTS", 0)
    rng = np.random.default_rng(8)
    x = np.where(rng.random((600, 4)) < 0.9, [2.0, -0.3, 0.0, 7.0], rng.integers(0, 4, (600, 4)))
    rows = [(i % 2, Vectors.dense(r) if dense or i % 3 else Vectors.sparse(4, np.flatnonzero(r), r[r != 0])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    edges = boost.feature_edges(df)
    read, blocks = boost._block_reader(edges), boost.binned(df, edges, "features", "label").toArrow().combine_chunks().to_batches()[0]
    assert len(blocks) == 1
    n, *_, rows_held, bins, column = read(blocks, 0)
    assert n == 600 and len(rows_held) < 600 and not len(blocks.column("dense")[0].as_buffer())
    for j in range(4):
        assert column(j).tolist() == np.searchsorted(edges[j], x[:, j], side="left").tolist()
