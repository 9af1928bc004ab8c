"""End-to-end fit: split, grams, features, selection, scaling, focal boosting, test metrics."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.operators.boost import Ensemble, fit_focal_boost, predict
from urlspark.operators.features import DISPLAY_NAMES, FEATURES
from urlspark.operators.metrics import binary_metrics, roc_auc
from urlspark.operators.ngrams import (
    class_totals, contingency, gram_statistics, ngram_counts, select_ngrams, validate_ngrams,
)
from urlspark.operators.parse import parse_urls
from urlspark.operators.scale import fit_vector_scaler, pick_columns
from urlspark.operators.select import binned_mutual_information, quantile_bins, select_features
from urlspark.operators.split import stratified_split
from urlspark.operators.suffix import SuffixRules
from urlspark.plans.frames import extract_features, feature_names
from urlspark.plans.scoring import Scorer
from urlspark.plans.stages import Stages, job_fingerprint
from urlspark.session import remove_folder, scratch_path
from urlspark.sources.artifacts import read_artifacts, write_artifacts, write_metrics


@dataclass
class Settings:
    """Sizes of the fit; the defaults are those of the full job."""

    gram_count: int = K.NGRAM_TOP
    gram_min_df: int = K.NGRAM_MIN_DF
    stability_runs: int = K.STABILITY_RUNS
    importance_trees: int = K.IMPORTANCE_TREES
    importance_depth: int = 5
    correlation_threshold: float = K.CORRELATION_THRESHOLD
    max_features: int = K.MAX_FEATURES
    rounds: int = K.BOOST_ROUNDS
    gamma: float = K.FOCAL_GAMMA
    alpha: float = K.FOCAL_ALPHA
    max_iter: int = 100
    boost: dict = field(default_factory=dict)


@dataclass
class Fit:
    scorer: Scorer
    metrics: DataFrame  # one row: accuracy, precision, recall, f1, auc
    gram_validation: DataFrame  # one row: accuracy, weighted_f1
    rejected: DataFrame  # row_id, url, feature_error
    predictions: DataFrame  # row_id, label, raw, prob_0, prob_1, prediction of the test rows
    train_features: DataFrame  # row_id, label, picked
    test_features: DataFrame  # row_id, label, scaled


def feature_information(frame: DataFrame, train: DataFrame, grams: DataFrame, label: str = "label",
                        key: str = "row_id") -> DataFrame:
    """(feature, mi) of every feature: binned for the hand-written ones, exact counts for grams.

    ``frame`` has (key, label, features), whose first slots are the hand-written features;
    ``train`` has the URLs of the same rows.
    """
    sliced = pick_columns(frame, list(range(len(FEATURES))), "features", "_hand")
    sliced = sliced.select(label, vector_to_array("_hand").alias("_hand"))
    featured = sliced.select(label, *[F.get("_hand", F.lit(i)).alias(c) for i, c in enumerate(FEATURES)])
    by_column = binned_mutual_information(featured, quantile_bins(featured, FEATURES), label)
    names = F.create_map(*[F.lit(x) for c in FEATURES for x in (c, DISPLAY_NAMES[c])])
    dense = by_column.select(names[F.col("feature")].alias("feature"), "mi")
    totals = class_totals(train, label)
    counts = ngram_counts(train, "url", (key, label))
    chosen = counts.join(F.broadcast(grams.select("gram")), "gram", "left_semi")  # at most the top-k grams
    stats = gram_statistics(contingency(chosen, label, sorted(totals)), sum(totals.values()), totals)
    sparse = stats.select(F.col("gram").alias("feature"), "mi")
    return dense.unionByName(sparse)


def train(urls: DataFrame, settings: Settings | None = None, label: str = "phishing", key: str = "row_id",
          rules: SuffixRules | None = None, folder: str | None = None) -> Fit:
    """Fit on (row_id, url, phishing). Writes metrics and artifacts below ``folder`` when given.

    URLs that cannot be decomposed and rows without a label are set aside first, with a reason, and take part in no step.
    With a folder, every stage leaves its table in ``folder/_stages`` until the run has ended well; a run of the same
    settings on the same rows goes on after the last finished stage of one that failed. Without one the stages' tables
    stay in the checkpoint folder, as the results read them.
    """
    s = settings or Settings()
    spark = urls.sparkSession
    parsed = parse_urls(urls.select(key, "url", F.col(label).alias("label")))
    reason = F.coalesce("feature_error", F.when(F.col("label").isNull(), "no_label"))
    rejected = parsed.withColumn("feature_error", reason).filter(F.col("feature_error").isNotNull()).select(
        key, "url", "feature_error")

    if folder:
        base = f"{folder.rstrip('/')}/_stages"
        inputs = [urls.select(key, "url", label), *([rules.as_table(spark)] if rules else [])]
        stages = Stages(spark, f"{base}/{job_fingerprint({**asdict(s), 'label': label, 'key': key}, *inputs)}")
    else:
        base, stages = None, Stages(spark, scratch_path(spark, "train"))

    # Written once: finding the cuts then reads only key and label, and keys cannot change between scans.
    usable = stages.table("usable", lambda: parsed.filter(
        F.col("feature_error").isNull() & F.col("label").isNotNull()).select(key, "url", "label"))
    # The split is reused by every later step: written once, then read per part.
    everything = stages.table("split", lambda: stratified_split(usable, "label", key), "split")
    parts = {p: everything.filter(F.col("split") == p).drop("split") for p in ("train", "val", "test")}

    grams = stages.table("grams", lambda: select_ngrams(
        parts["train"], "url", "label", key, s.gram_count, s.gram_min_df, s.max_iter))
    gram_validation = stages.table("gram_validation", lambda: validate_ngrams(
        parts["train"], parts["val"], grams, "url", "label", key, s.max_iter))

    # A few small files of one part or another make uneven tasks of what is the longest step, so rows are dealt by key.
    whole = stages.table("features", lambda: extract_features(
        everything.repartition(key), grams, keep=(key, "label", "split"), rules=rules).select(key, "label", "split", "features"), "split")
    frames = {p: whole.filter(F.col("split") == p).drop("split") for p in ("train", "test")}

    names = feature_names(grams)
    information = stages.table("information", lambda: feature_information(frames["train"], parts["train"], grams, "label", key))
    selection = stages.table("selection", lambda: spark.createDataFrame(list(enumerate(select_features(
        frames["train"], names, information, key=key, runs=s.stability_runs, trees=s.importance_trees,
        correlation_threshold=s.correlation_threshold, limit=s.max_features, max_iter=s.max_iter,
        depth=s.importance_depth,
    ))), "position int, idx int"))
    selected = [r.idx for r in selection.orderBy("position").collect()]  # features, not rows
    picked = {p: pick_columns(f, selected, "features", "picked").select(key, "label", "picked") for p, f in frames.items()}
    scaler = stages.model("scaler", lambda: fit_vector_scaler(
        picked["train"], picked["train"].count(), len(selected), "picked", "scaled"))
    scaled = {p: scaler.transform(f).select(key, "label", "scaled") for p, f in picked.items()}
    trees = Ensemble.from_table(stages.table("trees", lambda: fit_focal_boost(
        scaled["train"], s.rounds, "scaled", "label", s.gamma, s.alpha, **s.boost).table(spark)))

    scorer = Scorer(grams, selected, scaler, trees, [names[i] for i in selected], rules)
    predictions = predict(scaled["test"], trees, "scaled").drop("scaled")
    one, auc = binary_metrics(predictions).first(), roc_auc(predictions, score="prob_1").first()
    metrics = spark.createDataFrame(
        [(*one, auc.auc)], "accuracy double, precision double, recall double, f1 double, auc double"
    )
    fit = Fit(scorer, metrics, gram_validation, rejected, predictions, picked["train"], scaled["test"])
    if not folder:
        return fit
    write_metrics(metrics, f"{folder.rstrip('/')}/results")
    write_artifacts(folder, artifact_tables(fit, names, key))
    validation = spark.createDataFrame([tuple(gram_validation.first())], gram_validation.schema)
    saved = read_artifacts(spark, folder)
    remove_folder(spark, base)
    scorer = Scorer(saved["ngrams"], selected, saved["scaler"], trees, scorer.names, rules)
    return Fit(scorer, metrics, validation, rejected, saved["predictions"], saved["train_features"], saved["test_features"])


def artifact_tables(fit: Fit, names: list[str], key: str = "row_id") -> dict:
    spark = fit.metrics.sparkSession
    return {
        "trees": fit.scorer.trees.table(spark),
        "ngrams": fit.scorer.grams,
        "train_features": fit.train_features,
        "test_features": fit.test_features,
        "test_labels": fit.test_features.select(key, "label"),
        "predictions": fit.predictions,
        "selected_features": spark.createDataFrame(list(enumerate(fit.scorer.selected)), "position int, idx int"),
        "feature_names": spark.createDataFrame(list(enumerate(names)), "idx int, feature string"),
        "suffix_rules": (fit.scorer.rules or SuffixRules.default()).as_table(spark),
        "scaler": fit.scorer.scaler,
    }
