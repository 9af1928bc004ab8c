"""Frames the queries run on, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlspark.session import spread
from urlspark.streaming.score import read_url_stream
from workload.templates import PHISHING_VARIANTS, TEMPLATES, WEAK_TERMS, pieces


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, url, phishing) of the pages; the label is a weak one, read off the URL."""
    return from_pages(page_urls(spark, sf_dir))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "url"))


def page_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as a stream, whether the table is one file or a folder of files: a pattern names either."""
    schema = table(spark, sf_dir, "pages").select("page_id", "url").schema
    return read_url_stream(spark, f"{sf_dir}/[p]ages.parquet", schema)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def from_pages(page_rows: DataFrame) -> DataFrame:
    return page_rows.select(
        F.col("page_id").alias("row_id"), "url", F.col("url").rlike(WEAK_TERMS).cast("int").alias("phishing")
    )


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, variant, url, phishing): every page in every shape of the templates."""
    return make_variants(page_urls(spark, sf_dir))


def make_variants(page_rows: DataFrame) -> DataFrame:
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    staged = page_rows.select("page_id", "url", rest.alias("rest")).withColumn("host", F.substring_index("rest", "/", 1))
    fields = {
        "url": F.col("url"), "rest": F.col("rest"), "host": F.col("host"),
        "tail": F.substring("rest", F.length("host") + 1, F.length("rest")),
        "id": F.col("page_id").cast("string"), "b": (F.col("page_id") % 256).cast("string"),
    }
    shapes = [
        F.lit(None).cast("string") if t is None
        else F.concat(*[fields[p] if is_field else F.lit(p) for p, is_field in pieces(t)])
        for t in TEMPLATES
    ]
    out = staged.select("page_id", F.posexplode(F.array(*shapes)).alias("variant", "url"))
    weak = F.coalesce(F.col("url").rlike(WEAK_TERMS), F.lit(False))
    return out.select(
        (F.col("page_id") * 100 + F.col("variant")).alias("row_id"), "variant", "url",
        (weak | F.col("variant").isin(PHISHING_VARIANTS)).cast("int").alias("phishing"),
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, label): documents with a quality label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return texts(spark, sf_dir).join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), "text", "label")


NUMERIC = ["quantity", "price", "discount", "tax", "line", "net", "flat"]


def numeric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, label, score, prediction, numeric columns) from lineitem.

    ``net`` is a function of two others and ``flat`` is constant, so that redundancy and
    zero deviation occur.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
    )
    score = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 120000.0
    return spread(li).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        score.alias("score"), (score >= 0.5).cast("int").alias("prediction"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_linenumber").cast("double").alias("line"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.lit(1.0).alias("flat"),
    )


def learnable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """numeric_rows with a label that the columns can explain."""
    rows = numeric_rows(spark, sf_dir)
    rule = (F.col("net") > 30000) & (F.col("quantity") > 20) | (F.col("tax") > 0.07)
    return rows.withColumn("label", rule.cast("int"))


def tree_nodes(spark: SparkSession, sf_dir: str, features: int) -> DataFrame:
    """A table in the shape of model trees: one tree per order, one node per line item."""
    li = table(spark, sf_dir, "lineitem")
    leaf = F.col("l_linenumber") == 7
    slot = F.pmod(F.col("l_partkey") * 31 + F.col("l_suppkey") * 17, F.lit(features)).cast("int")
    return li.select(
        F.col("l_orderkey").alias("tree"), F.col("l_linenumber").alias("node"),
        F.when(leaf, F.lit(-1)).otherwise(slot).alias("feature"),
    )


# A given linear model over NUMERIC: coefficients, intercept, C.
GIVEN_COEFFICIENTS = [0.01, 0.0, 2.0, -1.0, 0.0, -0.0002, 0.0]
GIVEN_INTERCEPT, GIVEN_C = -0.5, 0.00002

# Given trees: (column, threshold, left, right) or (value, rows at the leaf when it was fitted).
GIVEN_TREES = [
    ("quantity", 25.0, ("tax", 0.04, (-0.5, 300.0), (0.25, 200.0)), ("net", 40000.0, (0.1, 350.0), (0.9, 150.0))),
    ("quantity", 10.0, (-0.3, 200.0), ("quantity", 30.0, (0.05, 400.0), (0.4, 400.0))),
    ("line", 2.0, ("discount", 0.05, (0.2, 100.0), ("tax", 0.02, (-0.7, 60.0), (0.3, 240.0))), (-0.1, 600.0)),
]
GIVEN_URL_TREES = [
    ("url_length", 40.0, ("dot_count", 2.0, (-0.6, 300.0), (0.2, 200.0)), ("digit_count", 6.0, (0.1, 300.0), (0.8, 200.0))),
    ("has_port", 0.5, ("path_depth", 2.0, (-0.4, 500.0), (0.15, 300.0)), (0.7, 200.0)),
]
