import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check
from urlspark.operators.features import FEATURES
from urlspark.plans.scoring import load_scorer, score_urls
from urlspark.plans.train import Settings, train
from urlspark.sources.artifacts import MODELS, TABLES, read_artifacts, write_artifacts
from urlspark.sources.urls import read_urls_csv, read_urls_parquet
from urlspark.streaming.score import read_url_stream, score_stream
from workload import data

SMALL = Settings(gram_count=40, stability_runs=2, importance_trees=2, importance_depth=3, rounds=3, max_iter=10,
                 max_features=30, boost={"min_child": 10})


@pytest.fixture(scope="module")
def fit(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("artifacts"))
    urls = data.url_variants(spark, sf).select("row_id", "url", "phishing")
    return train(urls, SMALL, folder=folder), folder, urls


def test_train_and_artifacts(fit, spark):
    result, folder, _ = fit
    m = result.metrics.first()
    assert all(0.0 <= v <= 1.0 for v in m)
    assert result.rejected.count() == 50 * 6
    loaded = read_artifacts(spark, folder)
    assert set(loaded) == {*TABLES, *MODELS}
    assert loaded["predictions"].count() == result.predictions.count()
    lines = [r.value for r in spark.read.text(f"{folder}/results").collect()]
    assert lines[0] == "Test Set Metrics:" and f"Accuracy: {m.accuracy:.4f}" in lines
    assert loaded["selected_features"].count() == len(result.scorer.selected) <= 30
    assert result.gram_validation.first().accuracy > 0


def test_loaded_scorer_gives_the_same_scores(fit, spark):
    result, folder, urls = fit
    again = load_scorer(spark, folder)
    assert again.selected == result.scorer.selected and again.names == result.scorer.names
    columns = ["row_id", "feature_error", "prob_1", "prediction"]
    want, got = (score_urls(urls, s).select(columns) for s in (result.scorer, again))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_none_artifact_is_skipped(fit, tmp_path):
    assert write_artifacts(str(tmp_path), {"x": None, "ngrams": fit[0].scorer.grams}) == ["ngrams"]


def test_stream_scores_equal_batch_scores(fit, spark, tmp_path):
    result, _, urls = fit
    urls.select("row_id", "url").write.parquet(str(tmp_path / "in"))
    stream = read_url_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    score_stream(stream, result.scorer, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    def scores(df):
        return {r.row_id: (r.feature_error, r.prediction, r.prob_1 and round(r.prob_1, 9)) for r in df.collect()}

    got, want = scores(spark.read.parquet(str(tmp_path / "out"))), scores(score_urls(urls, result.scorer))
    assert got == want and len(got) == urls.count()
    rejected = [v for v in got.values() if v[0]]
    assert len(rejected) == 50 * 6 and all(v[1] is None and v[2] is None for v in rejected)


def test_read_csv_latin1(spark, tmp_path):
    path = tmp_path / "u.csv"
    path.write_bytes('url,phishing\n"http://é.com/a,b""c",1\nhttp://b.com,0\nhttp://c.com,x\n'.encode("latin-1"))
    rows = read_urls_csv(spark, str(path)).collect()
    # rows come in no stated order, as their keys depend on their contents only
    assert {(r.url, r.phishing) for r in rows} == {('http://é.com/a,b"c', 1), ("http://b.com", 0), ("http://c.com", None)}
    assert len(rows) == 3
    assert len({r.row_id for r in rows}) == 3
    read_urls_csv(spark, str(path)).write.parquet(str(tmp_path / "p"))
    assert read_urls_parquet(spark, str(tmp_path / "p")).count() == 3


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 50 and set(FEATURES) <= set(df.columns)
    assert df.filter(F.col("feature_error").isNotNull()).count() == 0


def test_sql_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    line = check.compare(spark, con, sf, name, entry.oracle_sql()[name])
    assert line.startswith("ok"), line
