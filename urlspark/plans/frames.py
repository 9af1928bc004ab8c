"""Feature frames: hand-written features and selected n-gram counts in one sparse-friendly vector."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlspark.operators.features import DISPLAY_NAMES, FAMILIES, FEATURES, url_features
from urlspark.operators.ngrams import gram_vectors
from urlspark.operators.suffix import SuffixRules
from urlspark.session import BROADCAST_ROWS


def extract_features(df: DataFrame, grams: DataFrame | None = None, url: str = "url", keep: tuple[str, ...] = ("row_id",),
                     rules: SuffixRules | None = None, max_rows: int = BROADCAST_ROWS,
                     read: set[str] | None = None) -> DataFrame:
    """(keep..., url, feature_error, features): one lazy plan for the 86 features plus selected grams.

    Rows whose URL cannot be decomposed have NULL features; filter on ``feature_error``. With ``read`` the other
    hand-written features are 0 and not computed, for readers that look at no other.
    """
    columns = [c for c in FEATURES if read is None or c in read]
    families = [f for f, names in FAMILIES.items() if set(columns) & set(names)]
    featured = url_features(df.select(*keep, url), url, rules, families or list(FAMILIES))
    out = featured.select(*keep, url, "feature_error", *columns)
    if grams is not None:
        size = (grams.agg(F.max("idx")).first()[0] or 0) + 1
        out = gram_vectors(out, grams, url, (*keep, url, "feature_error", *columns), size, max_rows)
        # the size is known: without the hint a job would look for it
        out = VectorSizeHint(inputCol="vector", size=size, handleInvalid="optimistic").transform(out)
    valid = [(F.coalesce(F.col(c), F.lit(0.0)) if c in columns else F.lit(0.0)).alias(c) for c in FEATURES]
    rest = [*keep, url, "feature_error"] + (["vector"] if grams is not None else [])
    inputs = list(FEATURES) + (["vector"] if grams is not None else [])
    assembled = VectorAssembler(inputCols=inputs, outputCol="features").transform(out.select(*rest, *valid))
    return assembled.select(*keep, url, "feature_error", F.when(F.col("feature_error").isNull(), F.col("features")).alias("features"))


def feature_names(grams: DataFrame | None = None) -> list[str]:
    """Display names in vector order: the 86 features, then the selected grams."""
    names = [DISPLAY_NAMES[c] for c in FEATURES]
    if grams is not None:
        names += [r.gram for r in grams.orderBy("idx").select("gram").collect()]  # the selected grams
    return names
