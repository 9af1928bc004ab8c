"""URL decomposition, naive host split and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlspark.functions import url as U

PARTS = ["scheme", "hostname", "path", "query", "port", "feature_error"]


def parse_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, hostname (whole lower-cased network location), path, query, port, feature_error.

    Rows that cannot be decomposed keep NULL parts and say why in ``feature_error``.
    """
    raw = F.col(url)
    # Staged so that the cleaned text and the location are computed once per row.
    staged = df.withColumn("_clean", U.clean(raw))
    staged = staged.withColumns({
        "_scheme": F.lower(U.part(F.col("_clean"), 1)),
        "_netloc": U.part(F.col("_clean"), 2),
        "_path": U.part(F.col("_clean"), 3),
        "_query": U.part(F.col("_clean"), 4),
    })
    staged = staged.withColumn("_port", U.port_text(F.col("_netloc")))
    staged = staged.withColumn("feature_error", U.url_error(raw, F.col("_netloc"), F.col("_port")))

    def valid(value: Column) -> Column:
        return F.when(F.col("feature_error").isNull(), value)

    return staged.withColumns({
        "scheme": valid(F.col("_scheme")),
        "hostname": valid(F.lower(F.col("_netloc"))),
        "path": valid(U.path_without_params(F.col("_path"), F.col("_scheme"))),
        "query": valid(F.col("_query")),
        "port": valid(U.port_number(F.col("_port"))),
    }).drop("_clean", "_scheme", "_netloc", "_path", "_query", "_port")


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (usable rows, rejected rows with their reason)."""
    good = parsed.filter(F.col("feature_error").isNull()).drop("feature_error")
    bad = parsed.filter(F.col("feature_error").isNotNull())
    return good, bad


def split_host_naive(df: DataFrame, host: str = "hostname") -> DataFrame:
    """Label-position split: last label is the TLD, the one before the domain."""
    h = F.col(host)
    dots = F.length(h) - F.length(F.replace(h, F.lit("."), F.lit("")))
    last_two = F.substring_index(h, ".", -2)
    return df.withColumns({
        "naive_subdomain": F.when(dots >= 2, F.left(h, F.length(h) - F.length(last_two) - 1)).otherwise(""),
        "naive_domain": F.substring_index(last_two, ".", 1),
        "naive_tld": F.when(dots >= 1, F.substring_index(h, ".", -1)).otherwise(""),
    })
