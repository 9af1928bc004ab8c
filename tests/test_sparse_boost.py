import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors

from urlspark.operators import boost


def sparse_rows(n, width, share=0.01, seed=0):
    """Counts that mostly are 0, two dense slots in front, and a label that some of them explain."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < share, rng.integers(1, 5, (n, width)), 0).astype(float)
    x[:, :2] = rng.normal(size=(n, 2))
    y = ((x[:, 0] > 0) ^ (x[:, 2:6].sum(axis=1) > 0)).astype(int)
    return x, y


def frame(spark, x, y, sparse):
    def vector(r):
        return Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)]) if sparse else Vectors.dense(r)

    return spark.createDataFrame([(i, int(c), vector(r)) for i, (r, c) in enumerate(zip(x, y))], ["row_id", "label", "features"])


def test_same_trees_from_sparse_and_dense_vectors(spark, monkeypatch):
    x, y = sparse_rows(800, 30, 0.1)
    x[:5, 3] = np.nan
    x[5:9, 4] = -1.0  # bins below that of zero
    dense = boost.fit_focal_boost(frame(spark, x, y, False), rounds=2, max_leaves=9, min_child=10)
    monkeypatch.setattr(boost, "CELLS_A_PASS", 300)  # one leaf a job
    sparse = boost.fit_focal_boost(frame(spark, x, y, True).repartition(3), rounds=2, max_leaves=9, min_child=10)
    assert dense.nodes.equals(sparse.nodes) and (dense.nodes.leaf >= 0).sum() > 6


def test_blocks_hold_what_is_not_zero(spark):
    x, y = sparse_rows(2_000, 1_000)
    df = frame(spark, x, y, True)
    edges = [np.array([0.0]) if j < 2 else np.array([0.0, 1.0, 2.0, 3.0]) for j in range(1_000)]
    blocks = boost.binned(df, edges, "features", "label").collect()
    kept = sum(len(r.dense) + len(r.rows) + len(r.bins) + len(r.slots) + len(r.ends) for r in blocks)
    entries = int((x[:, 2:] != 0).sum())
    assert entries * 3 <= kept <= 3 * entries + len(blocks) * 8_100 + 2 * len(x)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in blocks])
    read, at = boost._block_reader(edges), 0
    for i in range(len(batch)):
        n, label, *_, column = read(batch, i)
        assert label.tolist() == y[at:at + n].tolist()
        for j in (0, 1, 2, 500, 999):
            assert column(j).tolist() == np.searchsorted(edges[j], x[at:at + n, j], side="left").tolist()
        at += n
    assert at == len(x)


def test_a_round_takes_no_more_passes_than_the_tree_is_deep(spark, monkeypatch):
    x, y = sparse_rows(1_500, 12, 0.3, seed=3)
    passes, scan = [], boost._Histograms._scan

    def counted(self, tree, nodes):
        passes.append(len(nodes))
        return scan(self, tree, nodes)

    monkeypatch.setattr(boost._Histograms, "_scan", counted)
    nodes = boost.fit_focal_boost(frame(spark, x, y, True), rounds=1, max_leaves=20, min_child=5).nodes.set_index("node")

    def depth(i):
        return 0 if nodes.left[i] < 0 else 1 + max(depth(nodes.left[i]), depth(nodes.right[i]))

    assert len(passes) <= depth(0) + 1
    assert sum(passes) <= 20 + len(passes)  # of two siblings only one is counted


@pytest.mark.parametrize("width", [0, 1])
def test_slots_without_cuts(spark, width):
    df = frame(spark, np.zeros((60, width)), np.arange(60) % 2, False)
    nodes = boost.fit_focal_boost(df, rounds=1).nodes
    assert len(nodes) == 1 and nodes.cover[0] == 60
