"""Streams over tables of one file and over folders of files."""

import os

from pyspark.sql import functions as F

from workload import data, queries


def test_streams_read_a_table_that_is_a_folder(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/pages.parquet").where("page_id % 25 = 0").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert os.path.isdir(tmp_path / "pages.parquet")
    for folder in (str(tmp_path), f"file://{tmp_path}"):
        streamed, whole = queries.url_stream(spark, folder), queries.family("lexical")(spark, folder)
        assert whole.count() == streamed.count() > 0
        assert streamed.exceptAll(whole).count() == 0
    scored, whole = queries.url_scores_stream(spark, str(tmp_path)), queries.url_scores(spark, str(tmp_path))
    assert scored.count() == whole.count() and scored.exceptAll(whole).count() == 0


def test_streams_read_a_table_of_one_file(spark, sf, tmp_path):
    os.symlink(f"{sf}/pages.parquet", tmp_path / "pages.parquet")
    assert queries.url_stream(spark, str(tmp_path)).count() == data.url_variants(spark, sf).agg(F.count("*")).first()[0]
