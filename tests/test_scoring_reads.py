from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors

from urlspark.operators.boost import predict
from urlspark.operators.features import FEATURES
from urlspark.plans.scoring import Scorer, read_features, scaled_frame, score_urls
from workload import data
from workload.queries import given_trees


def scorer(stage):
    selected = list(reversed(range(len(FEATURES))))
    names = [FEATURES[i] for i in selected]
    return Scorer(None, selected, PipelineModel([stage]), given_trees(data.GIVEN_URL_TREES, names), names)


def test_scoring_computes_only_what_trees_read(spark, sf):
    made = scorer(ElementwiseProduct(scalingVec=Vectors.dense([1.0] * len(FEATURES)), inputCol="picked", outputCol="scaled"))
    assert read_features(made) == {"url_length", "dot_count", "digit_count", "has_port", "path_depth"}
    urls = data.url_variants(spark, sf).filter("row_id < 300")
    scored = score_urls(urls, made)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1  # the trees; no entropies
    whole = predict(scaled_frame(urls, made), made.trees, "scaled").where("feature_error IS NULL")
    got = {r.row_id: r.prob_1 for r in scored.where("feature_error IS NULL").collect()}
    assert got and got == {r.row_id: r.prob_1 for r in whole.select("row_id", "prob_1").collect()}
    assert scored.count() == urls.count()


def test_scaler_that_mixes_slots_gets_all_features(spark):
    assert read_features(scorer(Normalizer(inputCol="picked", outputCol="scaled"))) is None
