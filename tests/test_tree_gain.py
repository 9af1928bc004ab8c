import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from urlspark.operators import boost, select


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (400, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] > 1) | (rng.random(400) < 0.1)).astype(int)
    df = spark.createDataFrame([(Vectors.dense(r), int(c)) for r, c in zip(x, y)], ["features", "label"]).repartition(4)
    return x, y, df


def mean_gains(x, y, trees, depth, rate=0.3):
    """The definition: all rows at every node, L2 of 1, at least 1 of curvature a side, first cut of the highest gain."""
    z, found = np.zeros(len(y)), {}

    def quality(g, h):
        return g.sum() ** 2 / (h.sum() + 1.0)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h, step = p - y, p * (1 - p), np.zeros(len(y))

        def grow(rows, level):
            best = (0.0, None, None)
            for f in range(x.shape[1]) if level < depth else ():
                for cut in np.unique(x[:, f])[:-1]:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if len(left) and len(right) and min(h[left].sum(), h[right].sum()) >= 1.0:
                        gain = quality(g[left], h[left]) + quality(g[right], h[right]) - quality(g[rows], h[rows])
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
            gain, f, cut = best
            if f is None:
                step[rows] = -rate * g[rows].sum() / (h[rows].sum() + 1.0)
                return
            found.setdefault(f, []).append(gain)
            grow(rows[x[rows, f] <= cut], level + 1)
            grow(rows[x[rows, f] > cut], level + 1)

        grow(np.arange(len(y)), 0)
        z += step
    return np.array([np.mean(found.get(f, [0.0])) for f in range(x.shape[1])])


@pytest.mark.parametrize("at_once", [1, boost.ROWS_A_REDUCER])
def test_equal_to_the_definition(made, monkeypatch, at_once):
    """With partial sums added up on the driver or by a shuffle."""
    monkeypatch.setattr(boost, "ROWS_A_REDUCER", at_once)
    x, y, df = made
    want = mean_gains(x, y, 3, 4)
    assert select.tree_gain(df, trees=3, depth=4) == pytest.approx(want / want.sum(), abs=1e-6)


def test_a_tree_takes_a_pass_a_level(made, monkeypatch):
    passes, scan = [], boost._Histograms._scan
    monkeypatch.setattr(boost._Histograms, "_scan", lambda self, *a: (passes.append(1), scan(self, *a)))
    assert select.tree_gain(made[2], trees=2, depth=3).sum() == pytest.approx(1.0)
    assert len(passes) <= 6


def test_one_class_gives_no_gain(made):
    assert not select.tree_gain(made[2].where("label = 1"), trees=1).any()
