import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.functions import focal
from urlspark.operators import boost, explain, metrics, ngrams, select, split
from urlspark.operators.scale import apply_scaler, fit_scaler
from workload import data


def py_grams(text):
    t = re.sub(r"\s\s+", " ", text.lower())
    return Counter(t[i:i + k] for k in (2, 3) for i in range(len(t) - k + 1))


TEXTS = ["Ab  ab\n\n x", "aaaa", "", "z", "😀😀😀", "tab\there   end", "http://a.com/aa"]


def test_ngram_counts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id long, url string")
    got = {}
    for r in ngrams.ngram_counts(df).collect():
        got.setdefault(r.row_id, {})[r.gram] = r.tf
    assert got == {i: dict(py_grams(t)) for i, t in enumerate(TEXTS) if py_grams(t)}


def test_ngram_counts_does_not_shuffle(spark, sf):
    plan = ngrams.ngram_counts(data.table(spark, sf, "pages").withColumnRenamed("page_id", "row_id"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_vectors_same_on_both_paths(spark, sf):
    pages = data.pages(spark, sf)
    grams = ngrams.number_grams(ngrams.ngram_counts(pages).select("gram").distinct())
    idx = [r.idx for r in grams.collect()]
    assert sorted(idx) == list(range(len(idx)))
    assert [r.gram for r in grams.orderBy("idx").collect()] == sorted(r.gram for r in grams.collect())
    small = {r.row_id: r.vector.toArray() for r in ngrams.gram_vectors(pages, grams).collect()}
    big = {r.row_id: r.vector.toArray() for r in ngrams.gram_vectors(pages, grams, max_rows=10).collect()}
    assert small.keys() == big.keys() and all((small[k] == big[k]).all() for k in small)


def test_split_is_exact_and_by_hash(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    rows = split.stratified_split(df).collect()
    assert Counter(r.split for r in rows) == {"train": 802, "val": 100, "test": 101}
    assert len({r.row_id for r in rows}) == 1003
    for label in (0, 1):
        mine = sorted((r for r in rows if r.label == label), key=lambda r: hashlib.md5(f"42|{r.row_id}".encode()).hexdigest())
        order = [r.split for r in mine]
        assert order == sorted(order, key=["train", "val", "test"].index)


def test_subsample_sizes(spark):
    df = spark.range(777).select(F.col("id").alias("row_id"))
    cuts = {r.run: r.last_hash for r in split.subsample_cuts(df, 3, 0.905).collect()}
    for run, cut in cuts.items():
        assert df.filter(split.order_hash("row_id", K.SEED + run) <= cut).count() == int(0.905 * 777)


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in apply_scaler(df, fit_scaler(df, ["a", "b"])).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_auc_with_ties_and_hot_score(spark):
    rng = np.random.RandomState(1)
    rows = [(int(y), float(s)) for y, s in zip(rng.randint(0, 2, 600), np.round(rng.rand(600), 2))]
    rows += [(i % 2, 0.5) for i in range(400)]  # one score holds many rows
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wanted = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    df = spark.createDataFrame(rows, "label int, score double")
    for ranges in (2, 7, 1000):
        assert metrics.roc_auc(df, ranges=ranges).first().auc == pytest.approx(wanted)
    assert metrics.roc_auc(df.filter("label = 1")).first().auc is None


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert tuple(metrics.binary_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)
    assert tuple(metrics.weighted_f1(df).first()) == (0.5, pytest.approx(1 / 3))


def numeric_frame(spark, n=400):
    """One constant, one exact copy, one negated copy, one noise column."""
    rng = np.random.RandomState(0)
    x, noise = rng.rand(n), rng.rand(n)
    rows = [(i, int(x[i] > 0.5), float(x[i]), 1.0, float(x[i]), float(-x[i]), float(noise[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, flat double, copy double, minus double, noise double")
    return VectorAssembler(inputCols=["a", "flat", "copy", "minus", "noise"], outputCol="features").transform(df)


def test_greedy_prune(spark):
    df = numeric_frame(spark)
    assert select.prune_correlated(df, 5, 0.95) == [0, 1, 3, 4]  # copy goes, constant and negated copy stay
    assert select.prune_correlated(df, 5, 0.95, absolute=True) == [0, 1, 4]
    assert select.prune_correlated(df, 5, 0.95, limit=2) == [0, 1]


def test_correlation_pairs_of_constant(spark):
    pairs = {(r.f1, r.f2): r.r for r in select.correlation_pairs(numeric_frame(spark), ["a", "flat", "minus"]).collect()}
    assert pairs[("a", "flat")] == 0.0 and pairs[("a", "minus")] == pytest.approx(-1.0)


def test_stability_finds_the_informative_column(spark):
    freq = select.stability_selection(numeric_frame(spark), runs=3, c=5.0)
    assert freq[0] + freq[2] + freq[3] > 0 and freq[1] == 0


def test_select_features(spark):
    df = numeric_frame(spark)
    names = ["a", "flat", "copy", "minus", "noise"]
    mi = select.binned_mutual_information(df, select.quantile_bins(df, names))
    kept = select.select_features(df, names, mi, runs=3, trees=3)
    assert kept and len(set(kept)) == len(kept) and set(kept) <= set(range(5))


def test_merged_rank_keeps_all_when_none_is_frequent(spark):
    df = spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.2, 0.1)], "feature string, frequency double, hybrid double")
    assert [r.feature for r in select.merged_rank(df).collect()] == ["a", "b"]
    df = spark.createDataFrame([("a", 0.8, 0.5), ("b", 0.2, 0.9)], "feature string, frequency double, hybrid double")
    assert [r.feature for r in select.merged_rank(df).collect()] == ["a"]


def test_gradient_is_the_derivative_of_the_loss(spark):
    rows = [(y, z) for y in (0, 1) for z in (-3.0, -0.5, 0.0, 2.0)]
    y, e = F.col("y"), 1e-5

    def loss(z):
        return focal.loss(y, focal.sigmoid(z))

    df = spark.createDataFrame(rows, "y int, z double")
    for r in df.select(
        focal.gradient(y, focal.sigmoid(F.col("z"))).alias("g"), ((loss(F.col("z") + e) - loss(F.col("z") - e)) / (2 * e)).alias("d"),
        focal.curvature(y, focal.sigmoid(F.col("z"))).alias("h"),
    ).collect():
        assert r.g == pytest.approx(r.d, abs=1e-7) and r.h >= 0


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.RandomState(3)
    x = rng.rand(600, 3)
    y = ((x[:, 0] > 0.6) | (x[:, 1] * x[:, 2] > 0.5)).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist()
    history = []
    model = boost.fit_focal_boost(df, rounds=4, max_leaves=8, history=history, checkpoint_every=2)
    return df, x, model, history


def test_boosting_lowers_the_loss(fitted):
    history = fitted[3]
    assert all(a > b for a, b in zip(history, history[1:]))


def test_boosting_is_deterministic(fitted):
    df, _, model, _ = fitted
    again = boost.fit_focal_boost(df, rounds=4, max_leaves=8)
    assert np.allclose(again.nodes.value, model.nodes.value)


def raw_score(model, row):
    total = 0.0
    for _, t in model.nodes.groupby("tree"):
        t = t.set_index("node")
        n = 0
        while t.left[n] >= 0:
            n = t.left[n] if row[t.feature[n]] <= t.threshold[n] else t.right[n]
        total += t.value[n]
    return total


def test_prediction_walks_the_trees(fitted, spark):
    df, x, model, _ = fitted
    same = boost.Ensemble.from_table(model.table(spark))
    got = {r.row_id: r for r in boost.predict(df, same).collect()}
    for i in range(0, 600, 37):
        z = raw_score(model, x[i])
        assert got[i].raw == pytest.approx(z) and got[i].prob_1 == pytest.approx(1 / (1 + math.exp(-z)))
        assert got[i].prediction == int(got[i].prob_1 >= 0.5)


def expected(nodes, row, known, n=0):
    """Tree value when only ``known`` features are given, the others averaged by cover."""
    t = nodes
    if t.left[n] < 0:
        return t.value[n]
    l, r = t.left[n], t.right[n]
    if t.feature[n] in known:
        return expected(t, row, known, l if row[t.feature[n]] <= t.threshold[n] else r)
    return (t.cover[l] * expected(t, row, known, l) + t.cover[r] * expected(t, row, known, r)) / t.cover[n]


def test_contributions_are_shapley_values(fitted):
    from itertools import combinations

    df, x, model, _ = fitted
    trees = [t.set_index("node") for _, t in model.nodes.groupby("tree")]
    got = {(r.row_id, r.idx): r for r in explain.contributions(df, model, ["a", "b", "c"]).collect()}
    for i in (0, 7, 99):
        def value(known):
            return sum(expected(t, x[i], known) for t in trees)

        for f in range(3):
            others = [g for g in range(3) if g != f]
            phi = sum(
                math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value({*s, f}) - value(set(s)))
                for k in range(3) for s in combinations(others, k)
            )
            assert got[(i, f)].contribution == pytest.approx(phi, abs=1e-9)
        assert got[(i, 0)].base == pytest.approx(value(set()))


def test_row_views(fitted, spark):
    df, x, model, _ = fitted
    contribs = explain.contributions(df, model, ["a", "b", "c"])
    key = explain.row_key_at(df, 5)
    assert key == 5 and explain.row_key_at(df, 10_000, fallback=0) == 0 and explain.row_key_at(df, 10_000) is None
    one = contribs.filter(F.col("row_id") == key)
    path = explain.decision_path(one).orderBy("step").collect()
    assert path[-1].cumulative == pytest.approx(raw_score(model, x[5]))
    assert [abs(r.contribution) for r in path] == sorted(abs(r.contribution) for r in path)
    labelled = boost.predict(df, model)
    bars = explain.waterfall(one, labelled, bars=2).orderBy("bar").collect()
    assert [b.feature for b in bars][-1] == "other" and [b.features for b in bars] == [1, 2]
    assert explain.contribution_summary(contribs, 2).count() == 2
    assert explain.scatter(contribs, "a").count() == 600
    assert explain.summary_points(contribs, 1).count() == 600


def test_both_gram_branches_give_the_same_features(spark):
    from urlspark.plans.frames import extract_features

    rows = spark.createDataFrame(
        [(1, "http://a.com/abab", None), (2, "http://b.com/ba", "x"), (2, "http://b.com/ba", "x"), (3, None, None),
         (4, "http://[bad", None)], "row_id int, url string, note string")
    grams = spark.createDataFrame([("ab", 0), ("ba", 1), ("com", 2)], "gram string, idx int")
    small, big = (
        sorted((r.row_id, r.note or "", r.url or "", r.feature_error or "", r.features.toArray().tolist() if r.features else [])
               for r in extract_features(rows, grams, keep=("row_id", "note"), max_rows=m).collect())
        for m in (10, 1)
    )
    assert small == big
    assert small[0][4][-3:] == [2.0, 1.0, 1.0]


def test_vector_scaler_centres_constant_slots(spark):
    from pyspark.ml.linalg import Vectors

    from urlspark.operators.scale import apply_scaler, fit_scaler, fit_vector_scaler

    def frame(rows):
        return spark.createDataFrame([(a, b, Vectors.dense(a, b)) for a, b in rows], ["a", "b", "features"])

    train, test = frame([(1.0, 1.0), (1.0, 4.0), (1.0, 5.0)]), frame([(5.0, 2.0)])
    vector = fit_vector_scaler(train, 3, 2).transform(test).first().scaled.toArray()
    row = apply_scaler(test, fit_scaler(train, ["a", "b"])).first()
    assert abs(vector[0] - row.a) < 1e-9 and abs(vector[1] - row.b) < 1e-9 and row.a == 4.0


def test_tree_has_at_most_the_wanted_leaves_and_splits_the_best_first(spark, fitted):
    df = fitted[0]
    for leaves in (1, 2, 5, 50):
        nodes = boost.fit_focal_boost(df, rounds=1, max_leaves=leaves, min_child=5).nodes
        count = int((nodes.leaf >= 0).sum())
        assert count <= leaves and (leaves > 5 or count == leaves)
        assert nodes[nodes.leaf >= 0].cover.sum() == nodes.cover[0] == 600
        assert nodes[nodes.leaf >= 0].leaf.tolist() == list(range(count))


def test_trees_equal_brute_force(spark, fitted):
    """The same trees from sorted columns and plain sums, every leaf looked at after every split."""
    df, x, _, _ = fitted
    y = np.array([r.label for r in df.select("row_id", "label").orderBy("row_id").collect()])
    z, leaves = np.zeros(len(y)), 5
    edges = boost.feature_edges(df, bins=16)
    model = boost.fit_focal_boost(df, rounds=3, max_leaves=leaves, min_child=20, bins=16)
    for tree in range(3):
        p = 1 / (1 + np.exp(-z))
        pt = np.where(y == 1, p, 1 - p)
        h = np.where(y == 1, K.FOCAL_ALPHA, 1 - K.FOCAL_ALPHA) * p * (1 - p) * (1 - pt) ** (K.FOCAL_GAMMA - 1)
        g = h * (2 * y - 1) * (K.FOCAL_GAMMA * np.log(pt) - (1 - pt) / pt)

        def quality(rows):
            return max(abs(g[rows].sum()) - K.BOOST_L1, 0) ** 2 / (h[rows].sum() + K.BOOST_L2)

        def best(rows):
            out = (0.0, None)
            for f in range(3):
                for cut in edges[f]:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(left), len(right)) >= 20:
                        gain = quality(left) + quality(right) - quality(rows)
                        if gain > out[0] + 1e-9:
                            out = (gain, (left, right))
            return out

        groups = [np.arange(len(y))]
        while len(groups) < leaves:
            found = [best(rows) for rows in groups]
            at = max(range(len(groups)), key=lambda i: found[i][0])
            if found[at][1] is None:
                break
            groups[at:at + 1] = found[at][1]
        nodes = model.nodes[model.nodes.tree == tree]
        values = []
        for rows in groups:
            total = g[rows].sum()
            value = -K.BOOST_RATE * math.copysign(max(abs(total) - K.BOOST_L1, 0), total) / (h[rows].sum() + K.BOOST_L2)
            z[rows] += value
            values.append((len(rows), value))
        got = nodes[nodes.leaf >= 0]
        assert got.cover.tolist() == [n for n, _ in values]
        assert np.allclose(got.value, [v for _, v in values], atol=1e-6)


def test_boosting_edge_cases(spark):
    from pyspark.ml.linalg import Vectors

    schema = VectorAssembler(inputCols=["a"], outputCol="features")
    empty = schema.transform(spark.createDataFrame([], "row_id long, label int, a double"))
    assert boost.fit_focal_boost(empty, rounds=2).nodes.value.tolist() == [0.0, 0.0]
    rows = [(i % 2, Vectors.dense(float("nan") if i % 2 else 1.0, 3.0)) for i in range(100)]
    rows += [(None, Vectors.dense(1.0, 1.0)), (1, None)]
    df = spark.createDataFrame(rows, ["label", "features"])
    nodes = boost.fit_focal_boost(df, rounds=1, min_child=1).nodes
    assert nodes.cover[0] == 100 and nodes.feature.max() in (-1, 0)
