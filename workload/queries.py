"""Every operator as a query over whole tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.functions import focal
from urlspark.functions import text as X
from urlspark.operators import boost, explain, l1, metrics, ngrams, select, split, suffix
from urlspark.operators.features import FAMILIES, FEATURES, url_features
from urlspark.operators.parse import PARTS, parse_urls, quarantine, split_host_naive
from urlspark.operators.scale import apply_scaler, fit_scaler, fit_vector_scaler, pick_columns
from urlspark.plans.frames import extract_features
from urlspark.plans.scoring import Scorer, score_urls
from urlspark.plans.train import Settings, train
from urlspark.session import BROADCAST_ROWS, cut_lineage, scratch_path
from urlspark.sources.artifacts import metric_lines
from urlspark.streaming.score import read_batches, score_batches, write_stream
from workload import data
from workload.data import NUMERIC

OTHER_NAMES = [a + b for a in "abcdefghij" for b in "abcdefghij"]
NAMES = [n for names in K.FEATURE_FAMILIES.values() for n in names] + OTHER_NAMES
SMALL_ROUNDS = 5


def rounded(df: DataFrame, columns: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding 0.0 turns a negative zero into zero."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


# --- URLs ---------------------------------------------------------------------------------
def url_parse(spark, sf):
    return parse_urls(data.url_variants(spark, sf)).select("row_id", *PARTS)


def url_suffix(spark, sf):
    return suffix.split_registrable(data.url_variants(spark, sf)).select("row_id", "subdomain", "domain", "tld")


def url_suffix_table(spark, sf):
    """The same with the rules given as a table, to which every line item adds a rule of its own that no host has."""
    name = F.concat_ws("-", F.lit("q"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    own = data.table(spark, sf, "lineitem").select(
        F.concat(name, F.lit(".test")).alias("suffix"), F.lit(False).alias("is_wildcard"), F.lit(False).alias("is_exception"))
    rules = suffix.SuffixRules.from_table(suffix.default_rules_table(spark).unionByName(own))
    return suffix.split_registrable(data.url_variants(spark, sf), rules=rules).select("row_id", "subdomain", "domain", "tld")


def url_suffix_joined(spark, sf):
    """The same on the way of a table beyond memory: different hosts are joined with it, URLs with their host's suffix."""
    rules = suffix.SuffixRules.from_table(suffix.default_rules_table(spark), max_inline=0, max_broadcast=0)
    split = suffix.split_registrable(data.url_variants(spark, sf), rules=rules, known="suffix_known")
    return split.select("row_id", "subdomain", "domain", "tld", "suffix_known")


def url_host_naive(spark, sf):
    good, _ = quarantine(parse_urls(data.url_variants(spark, sf)))
    return split_host_naive(good).select("row_id", "naive_subdomain", "naive_domain", "naive_tld")


def url_quarantine(spark, sf):
    _, bad = quarantine(parse_urls(data.url_variants(spark, sf)))
    return bad.select("row_id", "url", "feature_error")


def family(name: str):
    def run(spark, sf):
        return rounded(url_features(data.url_variants(spark, sf), families=[name])).select("row_id", *FAMILIES[name])

    return run


def url_stream(spark, sf):
    """Lexical features of a URL stream: everything there is, then stop; returns the sink."""
    pages = data.page_stream(spark, sf)
    features = url_features(data.make_variants(pages), families=["lexical"]).select("row_id", *FAMILIES["lexical"])
    out = scratch_path(spark, "stream")
    write_stream(features, f"{out}/rows", f"{out}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{out}/rows"))


def url_feature_vectors(spark, sf):
    """The 86 features and every vocabulary gram of the pages as one vector per URL, in long form."""
    return _feature_vectors(spark, sf, BROADCAST_ROWS)


def url_feature_vectors_joined(spark, sf):
    """The same when the vocabulary is too large to be sent to every executor."""
    return _feature_vectors(spark, sf, 10)


def _feature_vectors(spark, sf, max_rows):
    pages = data.pages(spark, sf)
    frame = extract_features(pages, cut_lineage(ngrams.number_grams(_kept(pages))), max_rows=max_rows)
    values = vector_to_array("features")
    return frame.select("row_id", F.posexplode(values).alias("slot", "value")).filter("value <> 0").select(
        "row_id", "slot", (F.round("value", 6) + 0.0).alias("value")
    )


# --- text and n-grams ---------------------------------------------------------------------
def text_entropy(spark, sf):
    docs = data.texts(spark, sf)
    return rounded(ngrams.text_entropies(docs, "text", ("doc_id",)))


def _pages(spark, sf):
    return data.pages(spark, sf).select("row_id", F.col("url").alias("text"), F.col("phishing").alias("label"))


def _documents(spark, sf):
    return data.texts(spark, sf).withColumnRenamed("doc_id", "row_id")


def _vocab(rows, text="text"):
    n_rows = rows.count()
    stats = ngrams.gram_statistics(ngrams.gram_cells(rows, text), n_rows)
    return ngrams.vocabulary(stats, n_rows)


def _kept(pages):
    return ngrams.variance_filter(_vocab(pages, "url"))


def ngram_counts(source):
    def run(spark, sf):
        return ngrams.ngram_counts(source(spark, sf), "text")

    return run


def ngram_vocab(source):
    def run(spark, sf):
        return _vocab(source(spark, sf)).select("gram", "df")

    return run


def ngram_variance(source):
    def run(spark, sf):
        return rounded(ngrams.variance_filter(_vocab(source(spark, sf))).select("gram", "variance"))

    return run


def _scores(rows):
    stats, totals = ngrams.labelled_statistics(rows, "text")
    return ngrams.variance_filter(ngrams.vocabulary(stats, sum(totals.values())))


def ngram_mi(source):
    def run(spark, sf):
        return rounded(_scores(source(spark, sf)).select("gram", "mi"))

    return run


def ngram_top(spark, sf):
    """Best 500 grams by mutual information and a given second score (document frequency)."""
    scores = _scores(data.labelled_texts(spark, sf)).select(
        "gram", F.round("mi", 9).alias("mi"), F.col("df").cast("double").alias("weight")
    )
    scored = rounded(ngrams.combined_score(scores), ["score"])
    return ngrams.top_grams(scored, 500).select("gram", "score")


def ngram_vectors(spark, sf):
    rows = _pages(spark, sf)
    grams = cut_lineage(ngrams.number_grams(ngrams.variance_filter(_vocab(rows))))
    vectors = ngrams.gram_vectors(rows, grams, "text")
    return vectors.select("row_id", F.posexplode(vector_to_array("vector")).alias("idx", "tf")).filter("tf > 0")


def ngram_names(spark, sf):
    grams = ngrams.number_grams(ngrams.variance_filter(_vocab(_pages(spark, sf))))
    return ngrams.feature_names(grams)


def ngram_l1_rank(spark, sf):
    return ngrams.select_ngrams(_pages(spark, sf), "text")


def ngram_validation(spark, sf):
    rows = split.stratified_split(_pages(spark, sf))
    train, val = (rows.filter(F.col("split") == p).drop("split") for p in ("train", "val"))
    best = ngrams.select_ngrams(train, "text")
    return ngrams.validate_ngrams(train, val, best, "text")


# --- split, scale, selection ----------------------------------------------------------------
def split_stratified(spark, sf):
    return split.stratified_split(data.numeric_rows(spark, sf)).select("row_id", "label", "split")


def split_distribution(spark, sf):
    return split.split_distribution(split.stratified_split(data.numeric_rows(spark, sf)))


def scale_standard(spark, sf):
    rows = split.stratified_split(data.numeric_rows(spark, sf))
    scaler = fit_scaler(rows.filter(F.col("split") == "train"), NUMERIC)
    return rounded(apply_scaler(rows.filter(F.col("split") == "test"), scaler).select("row_id", *NUMERIC))


def scale_vectors(spark, sf):
    """The same through the vector scaler."""
    rows = split.stratified_split(assembled(data.numeric_rows(spark, sf), ("row_id", "label")))
    train = rows.filter(F.col("split") == "train")
    model = fit_vector_scaler(train, train.count(), len(NUMERIC))
    scaled = model.transform(rows.filter(F.col("split") == "test")).withColumn("v", vector_to_array("scaled"))
    return rounded(scaled.select("row_id", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(NUMERIC)]))


def column_subset(spark, sf):
    """Chosen slots of a feature vector, in the chosen order."""
    picked = pick_columns(assembled(data.numeric_rows(spark, sf), ("row_id",)), [5, 0, 3])
    array = vector_to_array("picked")
    return rounded(picked.select("row_id", *[F.get(array, F.lit(i)).alias(NUMERIC[s]) for i, s in enumerate([5, 0, 3])]))


def assembled(df: DataFrame, keep: tuple[str, ...], columns: list[str] = NUMERIC) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df).select(*keep, "features")


def subsample_runs(spark, sf):
    rows = data.numeric_rows(spark, sf).select("row_id")
    counted = split.subsample_counts(rows, K.STABILITY_RUNS, K.STABILITY_FRACTION)
    return counted.groupBy("row_id").agg(F.sum("runs").alias("runs"))


def binned_mi(spark, sf):
    rows = data.numeric_rows(spark, sf)
    return rounded(select.binned_mutual_information(rows, select.width_bins(rows, NUMERIC)))


def quantile_mi(spark, sf):
    rows = data.learnable_rows(spark, sf)
    return rounded(select.binned_mutual_information(rows, select.quantile_bins(rows, NUMERIC)))


def correlation_pairs(spark, sf):
    return rounded(select.correlation_pairs(data.numeric_rows(spark, sf), NUMERIC))


def _given_scores(spark, sf):
    """Frequency, information and gain columns computed from the rows themselves."""
    rows = data.numeric_rows(spark, sf)
    mi = select.binned_mutual_information(rows, select.width_bins(rows, NUMERIC))
    aggs = [F.avg(F.col(c) / F.greatest(F.col(c), F.lit(50.0))).alias(c) for c in NUMERIC]
    frequency = rows.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(c, 9).alias("frequency")) for c in NUMERIC
    ])).alias("x")).select("x.*")
    gains = rows.agg(*[F.stddev_pop(c).alias(c) for c in NUMERIC]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(c, 6).alias("gain")) for c in NUMERIC
    ])).alias("x")).select("x.*")
    return mi.withColumn("mi", F.round("mi", 9)).join(frequency, "feature").join(gains, "feature")


def merged_rank(spark, sf):
    scores = select.hybrid_score(_given_scores(spark, sf))
    return rounded(select.merged_rank(scores).select("feature", "frequency", "hybrid", "merged"))


def stability_frequency(spark, sf):
    """All runs and passes of the operator's defaults."""
    rows = assembled(data.learnable_rows(spark, sf), ("row_id", "label"))
    freq = select.stability_selection(rows)
    return spark.createDataFrame([(c, float(f)) for c, f in zip(NUMERIC, freq)], "feature string, frequency double")


def l1_residual_given(spark, sf):
    """Gradient and distance from the optimum of every coefficient of a given linear model."""
    rows = assembled(data.numeric_rows(spark, sf), ("row_id", "label"))
    return rounded(l1.l1_residuals(rows, data.GIVEN_COEFFICIENTS, data.GIVEN_INTERCEPT, data.GIVEN_C, NUMERIC), digits=4)


def l1_residual_fit(spark, sf):
    """The same distance of a fitted model, a coefficient in units of its column's deviation: 0 to four decimals."""
    rows = data.learnable_rows(spark, sf)
    vectors = assembled(rows, ("row_id", "label"))
    fit = l1.fit_l1(vectors, K.STABILITY_C, max_iter=400)
    found = l1.l1_residuals(vectors, fit.coefficients[:, 0], fit.intercepts[0], K.STABILITY_C, NUMERIC)
    scale = rows.agg(*[F.stddev_pop(c).alias(c) for c in NUMERIC]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("deviation")) for c in NUMERIC])).alias("x")).select("x.*")
    scaled = F.col("residual") / F.coalesce(F.nullif("deviation", F.lit(0.0)), F.lit(1.0))
    return found.join(scale, "feature", "left").select("feature", (F.round(scaled, 4) + F.lit(0.0)).alias("residual"))


def tree_gain(spark, sf):
    rows = assembled(data.learnable_rows(spark, sf), ("row_id", "label"))
    gain = select.tree_gain(rows)
    return spark.createDataFrame([(c, float(g)) for c, g in zip(NUMERIC, gain)], "feature string, gain double")


def greedy_prune(spark, sf):
    """Columns kept, best first, from correlations over all rows, three candidates at a time."""
    kept = select.prune_correlated(assembled(data.numeric_rows(spark, sf), ("row_id",)), len(NUMERIC), block=3)
    return spark.createDataFrame([(i, NUMERIC[k]) for i, k in enumerate(kept)], "position int, feature string")


# --- model -------------------------------------------------------------------------------------
def _given_raw(spark, sf):
    return data.numeric_rows(spark, sf).withColumn("raw", F.col("score") * 8.0 - 4.0)


def focal_grad_hess(spark, sf):
    p = focal.sigmoid(F.col("raw"))
    return rounded(_given_raw(spark, sf).select(
        "row_id", p.alias("prob"), focal.gradient(F.col("label"), p).alias("grad"),
        focal.curvature(F.col("label"), p).alias("hess"),
    ))


def predict_class(spark, sf):
    return rounded(boost.add_class(_given_raw(spark, sf)).select("row_id", "prob_0", "prob_1", "prediction"))


@functools.lru_cache(maxsize=4)
def _fitted(app: str, sf: str):
    from pyspark.sql import SparkSession

    rows = assembled(data.learnable_rows(SparkSession.active(), sf), ("row_id", "label"))
    return boost.fit_focal_boost(rows, rounds=SMALL_ROUNDS)


def _model(spark, sf):
    """One small fit per table folder, shared by the queries that only read the model."""
    rows = assembled(data.learnable_rows(spark, sf), ("row_id", "label"))
    return rows, _fitted(spark.sparkContext.applicationId, sf)


def focal_boost_scores(spark, sf):
    """All rounds of the operator's defaults."""
    rows = assembled(data.learnable_rows(spark, sf), ("row_id", "label"))
    model = boost.fit_focal_boost(rows)
    return boost.predict(rows, model).select("row_id", "label", "raw", "prob_1", "prediction")


def model_trees(spark, sf):
    return _model(spark, sf)[1].table(spark)


def model_scores(spark, sf):
    rows, model = _model(spark, sf)
    return boost.predict(rows, model).select("row_id", "label", "raw", "prob_1", "prediction")


def _few_values(spark, sf, leaves: int):
    """The first tree over the columns of few values, its nodes by number."""
    columns = ["discount", "tax", "line"]
    rows = assembled(data.learnable_rows(spark, sf), ("row_id", "label"), columns)
    return columns, boost.fit_focal_boost(rows, rounds=1, max_leaves=leaves).nodes.set_index("node")


def _cut_row(columns: list[str], nodes: pd.DataFrame, at: int) -> tuple:
    top = nodes.loc[at]
    left, right = nodes.loc[int(top.left)], nodes.loc[int(top.right)]
    return columns[int(top.feature)], float(top.threshold), float(left.value), float(right.value), int(left.cover), int(right.cover)


CUT = "feature string, threshold double, left_value double, right_value double, left_rows long, right_rows long"


def boost_stump(spark, sf):
    """First tree of two leaves: its cut, Newton steps and row counts."""
    return rounded(spark.createDataFrame([_cut_row(*_few_values(spark, sf, 2), 0)], CUT))


def boost_second_level(spark, sf):
    """First tree of three leaves: the side of the first cut that is split again, and that cut."""
    columns, nodes = _few_values(spark, sf, 3)
    side = next(s for s in ("left", "right") if nodes.loc[int(nodes.loc[0, s])].left >= 0)
    found = (side, *_cut_row(columns, nodes, int(nodes.loc[0, side])))
    return rounded(spark.createDataFrame([found], f"side string, {CUT}"))


def given_trees(trees: list[tuple] = data.GIVEN_TREES, columns: list[str] = NUMERIC) -> boost.Ensemble:
    """Trees written down in ``data`` as a model over the columns."""
    rows: list[dict] = []

    def add(tree: int, node) -> int:
        at = len(rows) - starts[tree]
        row = {"tree": tree, "node": at, "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "leaf": -1, "value": 0.0}
        rows.append(row)
        if len(node) == 2:
            row["value"], row["cover"] = node
            row["leaf"] = sum(r["tree"] == tree and r["leaf"] >= 0 for r in rows)
        else:
            row["feature"], row["threshold"] = columns.index(node[0]), node[1]
            row["left"], row["right"] = add(tree, node[2]), add(tree, node[3])
            row["cover"] = sum(rows[starts[tree] + row[side]]["cover"] for side in ("left", "right"))
        return at

    starts: dict[int, int] = {}
    for tree, root in enumerate(trees):
        starts[tree] = len(rows)
        add(tree, root)
    return boost.Ensemble(pd.DataFrame(rows))


def tree_scores(spark, sf):
    """Scores and classes of all rows under given trees."""
    rows = assembled(data.numeric_rows(spark, sf), ("row_id",))
    return rounded(boost.predict(rows, given_trees()).select("row_id", "raw", "prob_1", "prediction"))


def _tree_contributions(spark, sf):
    return explain.contributions(assembled(data.numeric_rows(spark, sf), ("row_id",)), given_trees(), NUMERIC)


def tree_contributions(spark, sf):
    """Shapley values of all rows under given trees."""
    return rounded(_tree_contributions(spark, sf).select("row_id", "feature", "value", "contribution", "base"))


def url_scores(spark, sf):
    """Every URL variant through the scoring plan, with given trees over the URL features and a scaler that changes nothing."""
    same = PipelineModel([ElementwiseProduct(
        scalingVec=Vectors.dense([1.0] * len(FEATURES)), inputCol="picked", outputCol="scaled")])
    scorer = Scorer(None, list(range(len(FEATURES))), same, given_trees(data.GIVEN_URL_TREES, FEATURES), FEATURES)
    scored = score_urls(data.url_variants(spark, sf), scorer)
    return rounded(scored.select("row_id", F.col("feature_error").isNotNull().alias("rejected"), "prob_1", "prediction"))


def url_scores_stream(spark, sf):
    """The same as a stream of the pages that is stopped and started again."""
    same = PipelineModel([ElementwiseProduct(
        scalingVec=Vectors.dense([1.0] * len(FEATURES)), inputCol="picked", outputCol="scaled")])
    scorer = Scorer(None, list(range(len(FEATURES))), same, given_trees(data.GIVEN_URL_TREES, FEATURES), FEATURES)
    out = scratch_path(spark, "scored")
    for _ in range(2):
        pages = data.page_stream(spark, sf)
        score_batches(data.make_variants(pages), scorer, f"{out}/rows", f"{out}/state").awaitTermination()
    scored = read_batches(spark, f"{out}/rows")
    return rounded(scored.select("row_id", F.col("feature_error").isNotNull().alias("rejected"), "prob_1", "prediction"))


def train_run(spark, sf):
    """Test metrics of a whole run on every URL variant, with the sizes of the full job."""
    urls = data.url_variants(spark, sf).select("row_id", "url", "phishing")
    return train(urls, Settings(), folder=scratch_path(spark, "train-run")).metrics


def tree_contribution_summary(spark, sf):
    """The summary of the same."""
    return rounded(explain.contribution_summary(_tree_contributions(spark, sf)))


# --- metrics --------------------------------------------------------------------------------------
def binary_metrics(spark, sf):
    return rounded(metrics.binary_metrics(data.numeric_rows(spark, sf)))


def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(data.numeric_rows(spark, sf)))


def weighted_f1(spark, sf):
    return rounded(metrics.weighted_f1(data.numeric_rows(spark, sf)))


def metrics_text(spark, sf):
    return metric_lines(metrics.binary_metrics(data.numeric_rows(spark, sf)))


# --- explanations ------------------------------------------------------------------------------------
def _names(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "idx int, feature string")


def _handcrafted(spark):
    return spark.createDataFrame([(n,) for n in NAMES[:len(FEATURES)]], "feature string")


def _importance(spark, sf):
    return explain.split_importance(data.tree_nodes(spark, sf, len(NAMES)), _names(spark))


def importance_splits(spark, sf):
    return _importance(spark, sf)


def importance_handcrafted(spark, sf):
    return explain.top_handcrafted(_importance(spark, sf), _handcrafted(spark))


def importance_ngram_bands(spark, sf):
    return explain.top_ngram_bands(_importance(spark, sf), _handcrafted(spark))


def contributions(spark, sf):
    rows, model = _model(spark, sf)
    return explain.contributions(rows, model, NUMERIC)


def contributions_additivity(spark, sf):
    """Per row: raw score minus (base + contributions), which must be 0."""
    rows, model = _model(spark, sf)
    explained = explain.row_contributions(boost.predict_raw(rows, model), model, keep=("row_id", "raw"))
    total = F.aggregate("phi", F.lit(explain.expected_score(model.nodes)), lambda a, b: a + b)
    return explained.select("row_id", F.round(F.abs(F.col("raw") - total), 6).alias("gap"))


def _given_contributions(spark, sf):
    """A table in the shape of contributions: a row per order, a feature per line item."""
    li = data.table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("row_id"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("feature"),
        F.col("l_quantity").alias("value"),
        F.round((F.col("l_discount") - 0.05) * F.col("l_quantity"), 4).alias("contribution"),
        F.lit(0.5).alias("base"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("group"),
    )


def contribution_summary(spark, sf):
    grouped = _given_contributions(spark, sf).withColumn("feature", F.col("group"))
    return rounded(explain.contribution_summary(grouped, K.SUMMARY_TOP))


def contribution_scatter(spark, sf):
    grouped = _given_contributions(spark, sf).withColumn("feature", F.col("group"))
    return rounded(explain.scatter(grouped, "s1"))


def decision_path(spark, sf):
    return rounded(explain.decision_path(_given_contributions(spark, sf)).select(
        "row_id", "feature", "contribution", "step", "cumulative"))


def waterfall(spark, sf):
    orders = data.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") > 200000).cast("int").alias("prediction"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return rounded(explain.waterfall(_given_contributions(spark, sf), orders, bars=4))


QUERIES = {
    "url_parse": url_parse, "url_suffix": url_suffix, "url_suffix_table": url_suffix_table,
    "url_suffix_joined": url_suffix_joined,
    "url_host_naive": url_host_naive, "url_quarantine": url_quarantine,
    **{f"url_{name}": family(name) for name in FAMILIES},
    "url_stream": url_stream, "url_feature_vectors": url_feature_vectors,
    "url_feature_vectors_joined": url_feature_vectors_joined,
    "text_entropy": text_entropy,
    "ngram_counts": ngram_counts(_pages), "ngram_counts_docs": ngram_counts(_documents),
    "ngram_vocab": ngram_vocab(_pages), "ngram_vocab_docs": ngram_vocab(_documents),
    "ngram_variance": ngram_variance(_pages), "ngram_variance_docs": ngram_variance(_documents),
    "ngram_mi": ngram_mi(_pages), "ngram_mi_docs": ngram_mi(data.labelled_texts),
    "ngram_top": ngram_top, "ngram_vectors": ngram_vectors, "ngram_names": ngram_names,
    "ngram_l1_rank": ngram_l1_rank, "ngram_validation": ngram_validation,
    "split_stratified": split_stratified, "split_distribution": split_distribution,
    "scale_standard": scale_standard, "scale_vectors": scale_vectors, "column_subset": column_subset,
    "subsample_runs": subsample_runs, "binned_mi": binned_mi, "quantile_mi": quantile_mi,
    "correlation_pairs": correlation_pairs, "merged_rank": merged_rank,
    "stability_frequency": stability_frequency, "l1_residual_given": l1_residual_given, "l1_residual_fit": l1_residual_fit,
     "tree_gain": tree_gain, "greedy_prune": greedy_prune,
    "focal_grad_hess": focal_grad_hess, "predict_class": predict_class,
    "boost_stump": boost_stump, "boost_second_level": boost_second_level, "tree_scores": tree_scores, "url_scores": url_scores,
    "url_scores_stream": url_scores_stream, "train_run": train_run, "tree_contributions": tree_contributions,
    "tree_contribution_summary": tree_contribution_summary,
    "focal_boost_scores": focal_boost_scores, "model_trees": model_trees, "model_scores": model_scores,
    "binary_metrics": binary_metrics, "roc_auc": roc_auc, "weighted_f1": weighted_f1, "metrics_text": metrics_text,
    "importance_splits": importance_splits, "importance_handcrafted": importance_handcrafted,
    "importance_ngram_bands": importance_ngram_bands,
    "contributions": contributions, "contributions_additivity": contributions_additivity,
    "contribution_summary": contribution_summary, "contribution_scatter": contribution_scatter,
    "decision_path": decision_path, "waterfall": waterfall,
}
