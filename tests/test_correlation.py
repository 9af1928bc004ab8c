import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from urlspark.operators import quantiles, select


def frame(spark, x, sparse=True):
    def vector(r):
        return Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)]) if sparse else Vectors.dense(r)

    return spark.createDataFrame([(i, vector(r)) for i, r in enumerate(x)], ["row_id", "features"]).repartition(2)


def brute_matrix(x):
    deviation = x.std(axis=0)
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 1e-9)
    z = (x - x.mean(axis=0)) * scale
    return z.T @ z / len(x)


def made(n, width, seed=0):
    """Sparse counts with copies, near copies, negated copies and constants among them."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.2, rng.integers(1, 6, (n, width)), 0).astype(float)
    for j in range(3, width, 4):
        x[:, j] = x[:, j - int(rng.integers(1, 4))] * rng.choice([1.0, 2.0, -1.0])
        if j % 3 == 0:
            x[rng.integers(n), j] += 1
    x[:, 7::50] = 3.0
    return x


@pytest.mark.parametrize("absolute", [False, True])
@pytest.mark.parametrize("sparse", [False, True])
def test_pruning_by_blocks_equals_the_whole_matrix(spark, absolute, sparse):
    x = made(80, 60)
    want = select.greedy_prune(brute_matrix(x), 0.9, 30, absolute)
    for block in (7, 60, 200):
        assert select.prune_correlated(frame(spark, x, sparse), 60, 0.9, 30, absolute, block=block) == want
    assert 10 < len(want) <= 30


def test_pruning_of_5000_slots(spark):
    x = made(60, 5_000, seed=1)
    want = select.greedy_prune(brute_matrix(x), 0.6, 1_000)
    assert select.prune_correlated(frame(spark, x), 5_000, 0.6, 1_000) == want and len(want) == 1_000


def test_pairs_by_blocks(spark):
    x = made(50, 9, seed=2)
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, *[1.0] * 8)], ", ".join(f"{c} double" for c in names))
    want = brute_matrix(x)
    for block in (2, 100):
        got = {(r.f1, r.f2): r.r for r in select.correlation_pairs(df, names, block).collect()}
        assert len(got) == 36
        for i in range(9):
            for j in range(i + 1, 9):
                assert got[names[i], names[j]] == pytest.approx(want[i, j], abs=1e-9)


def test_no_rows(spark):
    df = frame(spark, made(5, 6))
    assert select.prune_correlated(df.limit(0), 6) == list(range(6))


def columns():
    rng = random.Random(3)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(997)], "ties": [float(rng.randrange(4)) for _ in range(997)],
        "one": [5.0] * 997, "tails": [rng.choice([1.0, -1.0]) * 10 ** rng.uniform(-300, 300) for _ in range(997)],
        "gaps": [None if i % 3 else (float("nan") if i % 5 == 0 else i / 7) for i in range(997)], "none": [None] * 997,
        "huge": [1e308 * rng.uniform(-1.7, 1.7) for _ in range(997)],
        "close": [1.0 + rng.randrange(5) * 2.3e-16 for _ in range(997)],
    }


@pytest.mark.parametrize("cells", [4, quantiles.CELLS])
def test_exact_order_statistics(spark, monkeypatch, cells):
    monkeypatch.setattr(quantiles, "CELLS", cells)
    held = columns()
    if cells == 4:
        held = {c: held[c] for c in ("normal", "ties", "gaps")}
    df = spark.createDataFrame(list(zip(*held.values())), ", ".join(f"{c} double" for c in held)).repartition(3)
    got = quantiles.order_statistics(df, list(held), lambda n: [1, (n + 1) // 2, n, math.ceil(0.9 * n)])
    for c, values in held.items():
        full = sorted(v for v in values if v is not None and v == v)
        n = len(full)
        assert got[c] == ({k: full[k - 1] for k in (1, (n + 1) // 2, n, math.ceil(0.9 * n))} if n else {})


def test_edges(spark):
    df = spark.range(1, 101).selectExpr("double(id) AS a", "double(id % 2) AS b")
    assert select.quantile_bins(df, ["a", "b"], 4) == {"a": [25.0, 50.0, 75.0], "b": [0.0, 1.0]}
    assert select.quantile_bins(df.limit(0), ["a"], 4) == {"a": []}
