import os

import pytest
from pyspark.sql import functions as F

from urlspark.operators.split import stratified_split
from urlspark.plans import train as plan
from urlspark.session import checkpoint_dir
from urlspark.sources import urls as U
from urlspark.streaming.score import read_batches, read_url_stream, write_batches
from workload import data

SMALL = plan.Settings(gram_count=30, stability_runs=2, importance_trees=2, importance_depth=2, rounds=2, max_iter=10,
                      max_features=20, boost={"min_child": 10, "max_leaves": 6})


def scratch(spark):
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "urlspark")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_training_goes_on_after_a_failure(spark, sf, tmp_path, monkeypatch):
    urls = data.url_variants(spark, sf).select("row_id", "url", "phishing").where("row_id % 3 = 0")
    before = scratch(spark)
    want = plan.train(urls, SMALL, folder=str(tmp_path / "whole"))

    def fails(*_, **__):
        raise RuntimeError("lost")

    folder, boost, chosen = str(tmp_path / "broken"), plan.fit_focal_boost, plan.select_features
    monkeypatch.setattr(plan, "fit_focal_boost", fails)
    with pytest.raises(RuntimeError, match="lost"):
        plan.train(urls, SMALL, folder=folder)
    assert os.path.isdir(f"{folder}/_stages")
    monkeypatch.setattr(plan, "fit_focal_boost", boost)
    for name in ("select_features", "select_ngrams", "extract_features", "stratified_split", "feature_information"):
        monkeypatch.setattr(plan, name, fails)  # what had been done is not done again
    got = plan.train(urls.orderBy(F.rand()), SMALL, folder=folder)  # the same rows in another order
    assert got.scorer.selected == want.scorer.selected and got.scorer.trees.nodes.equals(want.scorer.trees.nodes)
    assert got.metrics.collect() == want.metrics.collect()
    assert got.predictions.count() == want.predictions.count() > 0
    assert not os.path.exists(f"{folder}/_stages") and scratch(spark) == before

    monkeypatch.setattr(plan, "select_features", chosen)
    with pytest.raises(RuntimeError, match="lost"):  # other settings, other stages
        plan.train(urls, plan.Settings(**{**vars(SMALL), "rounds": 1}), folder=folder)


def test_a_batch_that_runs_again_repeats_nothing(spark, tmp_path):
    rows = spark.range(30).selectExpr("id AS row_id", "concat('u', id) AS url")
    for i in range(3):
        rows.where(F.col("row_id") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        write_batches(read_url_stream(spark, str(tmp_path / "in"), files_per_batch=1), path, state).awaitTermination()

    run()
    assert sorted(r.row_id for r in read_batches(spark, path).collect()) == list(range(30))
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    os.rename(f"{state}/commits/{last}", tmp_path / "commit")  # stopped after the batch was written, before it was noted
    if os.path.exists(f"{state}/commits/.{last}.crc"):
        os.rename(f"{state}/commits/.{last}.crc", tmp_path / "commit-crc")
    spark.createDataFrame([(99, "late")], "row_id long, url string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r.row_id for r in read_batches(spark, path).collect()) == [*range(30), 99]


def test_keys_do_not_depend_on_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "COPIES_AT_ONCE", 7)
    rows = spark.range(400).selectExpr("concat('http://h', if(id % 3 = 0, 0, id), '.com') AS url", "int(id % 2) AS phishing")
    rows = rows.union(spark.createDataFrame([(None, None), (None, None), ("", 1)], "url string, phishing int"))
    rows.repartition(1).write.option("header", True).csv(str(tmp_path / "a"))
    rows.orderBy(F.rand(1)).repartition(9).write.option("header", True).csv(str(tmp_path / "b"))
    a, b = (U.read_urls_csv(spark, str(tmp_path / n)) for n in "ab")
    first, second = (sorted(map(tuple, d.collect()), key=str) for d in (a, b))
    assert first == second and len({r[0] for r in first}) == len(first) == rows.count()
    split = [sorted((r.row_id, r.split) for r in stratified_split(d, "phishing").collect()) for d in
             (d.where("phishing IS NOT NULL") for d in (a, b))]
    assert split[0] == split[1]
    keyed = spark.createDataFrame([(5, "u", 1)], "row_id long, url string, phishing int")
    keyed.write.parquet(str(tmp_path / "c"))
    assert U.read_urls_parquet(spark, str(tmp_path / "c")).first().row_id == 5
