from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors

from urlspark.operators import boost, explain
from workload import queries


def made_tree(rng, number, depth, width, rows=1000.0):
    """A random tree of this depth; every inner node's rows go to its sides in random parts, sometimes all to one."""
    out = []

    def grow(level, cover):
        at = len(out)
        out.append({"tree": number, "node": at, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "leaf": -1,
                    "value": 0.0, "cover": cover})
        if level == depth or level and rng.random() < 0.1:
            out[at]["value"] = float(rng.normal())
            return at
        part = 0.0 if rng.random() < 0.05 else float(rng.uniform(0.1, 0.9))
        out[at] |= {"feature": int(rng.integers(width)), "threshold": float(rng.normal()),
                    "left": grow(level + 1, cover * part), "right": grow(level + 1, cover * (1 - part))}
        return at

    grow(0, rows)
    return out


def expectation(nodes, x, known):
    def value(i):
        n = nodes[i]
        if n["left"] < 0:
            return n["value"]
        if n["feature"] in known:
            return value(n["left"] if x[n["feature"]] <= n["threshold"] else n["right"])
        if not n["cover"]:
            return 0.0
        return sum(value(n[s]) * nodes[n[s]]["cover"] / n["cover"] for s in ("left", "right"))

    return value(0)


def shapley(trees, x, width):
    phi = np.zeros(width)
    for i in range(width):
        others = [j for j in range(width) if j != i]
        for size in range(width):
            weight = factorial(size) * factorial(width - size - 1) / factorial(width)
            for known in combinations(others, size):
                phi[i] += weight * sum(expectation(t, x, {*known, i}) - expectation(t, x, set(known)) for t in trees)
    return phi


def explained(spark, nodes, x, width):
    df = spark.createDataFrame([(i, Vectors.sparse(width, [(j, float(v)) for j, v in enumerate(r) if v])) for i, r in enumerate(x)],
                               ["row_id", "features"])
    rows = explain.contributions(df, boost.Ensemble(nodes), [f"f{i}" for i in range(width)]).collect()
    got = np.zeros((len(x), width))
    for r in rows:
        got[r.row_id, r.idx] = r.contribution
        assert r.value == x[r.row_id][r.idx]
    return got, rows[0].base


@pytest.mark.parametrize("sent", [1, explain.SENT_BYTES])
def test_equal_to_the_definition(spark, monkeypatch, sent):
    """Also with one broadcast a tree."""
    monkeypatch.setattr(explain, "SENT_BYTES", sent)
    monkeypatch.setattr(explain._tree_groups, "__defaults__", (sent,))
    monkeypatch.setattr(explain, "ROWS_AT_ONCE", 3)
    rng = np.random.default_rng(0)
    trees = [made_tree(rng, i, 5, 6) for i in range(4)]
    x = np.where(rng.random((7, 6)) < 0.3, 0.0, rng.normal(size=(7, 6)))
    got, base = explained(spark, pd.DataFrame([n for t in trees for n in t]), x, 6)
    for row, phi in zip(x, got):
        assert phi == pytest.approx(shapley(trees, row, 6), abs=1e-9)
    assert base == pytest.approx(sum(expectation(t, x[0], set()) for t in trees))


def chain(number, rng, depth, width):
    """A tree as deep as it has leaves less one."""
    nodes, cover, drawn = [], 10_000.0, rng.permutation(width)[:depth]
    for level in range(depth):
        at = 2 * level
        nodes.append({"tree": number, "node": at, "feature": int(drawn[level]), "threshold": float(rng.normal()), "left": at + 1,
                      "right": at + 2, "leaf": -1, "value": 0.0, "cover": cover})
        nodes.append({"tree": number, "node": at + 1, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "leaf": level,
                      "value": float(rng.normal()), "cover": cover * 0.3})
        cover *= 0.7
    nodes.append({"tree": number, "node": 2 * depth, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "leaf": depth,
                  "value": float(rng.normal()), "cover": cover})
    return nodes


def test_a_whole_model(spark):
    """1,000 trees of 50 leaves and depth 15 and more: under 20 MB are sent, and contributions add up to the score."""
    rng = np.random.default_rng(1)
    rows = []
    for number in range(1_000):
        rows += chain(number, rng, 15, 40) if number % 2 else chain(number, rng, 49, 60)
    nodes = pd.DataFrame(rows)
    assert sum(len(explain.node_bytes(g)) for g in explain._tree_groups(nodes)) < 20_000_000
    x = rng.normal(size=(6, 60))
    got, base = explained(spark, nodes, x, 60)
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["row_id", "features"])
    raw = {r.row_id: r.raw for r in boost.predict_raw(df, boost.Ensemble(nodes)).collect()}
    assert [base + phi.sum() for phi in got] == pytest.approx([raw[i] for i in range(6)], abs=1e-6)


def test_without_splits_and_rows(spark):
    nodes = pd.DataFrame([{"tree": 0, "node": 0, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "leaf": 0,
                           "value": 0.5, "cover": 3.0}])
    df = spark.createDataFrame([(1, Vectors.dense([1.0]))], ["row_id", "features"])
    one = explain.contributions(df, boost.Ensemble(nodes), ["a"]).collect()
    assert [(r.idx, r.contribution, r.base) for r in one] == [(-1, 0.0, 0.5)]
    assert explain.contributions(df.limit(0), boost.Ensemble(nodes), ["a"]).count() == 0


def test_a_tree_is_computed_once_a_cell(monkeypatch):
    """Of 20,000 rows only one for each cell of a tree's grid goes through its paths, in one batch or several."""
    rng = np.random.default_rng(3)
    nodes = pd.DataFrame([n for i in range(3) for n in made_tree(rng, i, 4, 4)])
    x = rng.normal(size=(20_000, 4))
    seen, reduceat = [], np.add.reduceat
    prepare = explain._explainer(explain.NODE, 128, explain.TABLE_BYTES)
    values = prepare(explain.node_bytes(nodes), [0, 1, 2, 3])
    once = explain._explainer(explain.NODE, 128, 0)(explain.node_bytes(nodes), [0, 1, 2, 3])

    class Counted:
        def __getattr__(self, name):
            return getattr(np.add, name)

        def reduceat(self, a, *args, **named):
            seen.append(len(a))
            return reduceat(a, *args, **named)

    class Numpy:
        add = Counted()

        def __getattr__(self, name):
            return getattr(np, name)

    monkeypatch.setattr(explain, "np", Numpy())
    got = np.vstack([values(x[a:a + 5_000]) for a in range(0, len(x), 5_000)])
    assert 0 < sum(seen) < 5_000
    assert np.array_equal(got, once(x))
    one_by_one = np.vstack([once(r[None]) for r in x[:20]])
    assert np.array_equal(got[:20], one_by_one)


def test_a_grid_of_more_than_64_bits():
    rng = np.random.default_rng(4)
    nodes = pd.DataFrame(chain(0, rng, 49, 80) + chain(1, rng, 70, 80))
    x = np.repeat(rng.normal(size=(5, 80)), 3, axis=0)
    values = explain._explainer(explain.NODE, 128, explain.TABLE_BYTES)(explain.node_bytes(nodes), list(range(80)))
    assert np.allclose(values(x), np.vstack([values(r[None]) for r in x]), atol=1e-12)


def test_missing_and_infinite_values_add_up(spark):
    """They go the way they go when a row is scored."""
    rng = np.random.default_rng(6)
    nodes = pd.DataFrame([n for i in range(3) for n in made_tree(rng, i, 4, 4)])
    x = np.array([[np.nan, 0.1, -np.inf, 2.0], [np.inf, np.nan, 0.0, -np.inf], [0.0, 0.0, 0.0, 0.0]])
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["row_id", "features"])
    model = boost.Ensemble(nodes)
    raw = {r.row_id: r.raw for r in boost.predict_raw(df, model).collect()}
    total = {i: 0.0 for i in raw}
    for r in explain.contributions(df, model, list("abcd")).collect():
        total[r.row_id] += r.contribution
        base = r.base
    assert [base + total[i] for i in sorted(raw)] == pytest.approx([raw[i] for i in sorted(raw)], abs=1e-9)


def test_additivity_needs_no_shuffle(spark, sf, monkeypatch):
    nodes = pd.DataFrame(made_tree(np.random.default_rng(7), 0, 4, 6))
    monkeypatch.setattr(queries, "_fitted", lambda app, folder: boost.Ensemble(nodes))
    gaps = queries.contributions_additivity(spark, sf)
    assert {r.gap for r in gaps.select("gap").distinct().collect()} == {0.0}
    assert "SortMergeJoin" not in gaps._jdf.queryExecution().executedPlan().toString()
