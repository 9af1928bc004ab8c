"""Queries run the whole job, and what the whole job needs is exact."""

import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors

from urlspark import constants as K
from urlspark.operators import boost
from urlspark.plans.train import Settings
from workload import queries


class Seen(Exception):
    pass


def test_focal_boost_scores_runs_all_rounds(spark, sf, monkeypatch):
    signature = inspect.signature(boost.fit_focal_boost)

    def seen(*args, **named):
        call = signature.bind(*args, **named)
        call.apply_defaults()
        raise Seen(call.arguments["rounds"], call.arguments["max_leaves"])

    monkeypatch.setattr(boost, "fit_focal_boost", seen)
    with pytest.raises(Seen) as found:
        queries.focal_boost_scores(spark, sf)
    assert found.value.args == (K.BOOST_ROUNDS, K.BOOST_LEAVES)


def test_train_run_has_the_sizes_of_the_full_job(spark, sf, monkeypatch):
    def seen(urls, settings=None, **_):
        raise Seen(settings or Settings())

    monkeypatch.setattr(queries, "train", seen)
    with pytest.raises(Seen) as found:
        queries.train_run(spark, sf)
    full = found.value.args[0]
    assert full == Settings() and (full.gram_count, full.stability_runs, full.importance_trees, full.rounds) == (
        K.NGRAM_TOP, K.STABILITY_RUNS, K.IMPORTANCE_TREES, K.BOOST_ROUNDS)


def random_tree(rng, number, leaves, width):
    rows = []

    def add(n):
        at = len(rows)
        rows.append({"tree": number, "node": at, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "leaf": -1,
                     "value": rng.normal(), "cover": 1.0})
        if n > 1:
            cut = int(rng.integers(1, n))
            rows[at] |= {"feature": int(rng.integers(width)), "threshold": float(rng.integers(0, 9))}
            rows[at]["left"], rows[at]["right"] = add(cut), add(n - cut)
        return at

    add(leaves)
    return rows


def walked(nodes, x):
    total = 0.0
    for _, t in nodes.groupby("tree"):
        t, n = t.set_index("node"), 0
        while t.left[n] >= 0:
            n = t.left[n] if x[t.feature[n]] <= t.threshold[n] else t.right[n]
        total += t.value[n]
    return total


@pytest.mark.parametrize("width, sizes", [(3, [1, 2, 50, 64]), (40, [64, 65, 90, 3, 64]), (5, [70]), (4, [1, 1])])
def test_scores_by_leaf_masks_equal_the_walk(spark, width, sizes):
    """Trees of 64 leaves use every bit; larger ones are walked; a NaN goes right."""
    rng = np.random.default_rng(len(sizes))
    nodes = pd.DataFrame([r for k, n in enumerate(sizes) for r in random_tree(rng, k, n, width)])
    x = rng.integers(-1, 10, (60, width)).astype(float)
    x[:4, 0] = np.nan
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["row_id", "features"])
    got = {r.row_id: r.raw for r in boost.predict_raw(df, boost.Ensemble(nodes)).collect()}
    assert [got[i] for i in range(60)] == pytest.approx([walked(nodes, r) for r in x])
