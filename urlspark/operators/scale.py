"""Standard scaling with population deviation, for columns and for vectors."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorSlicer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """{column: (mean, deviation)} from one aggregation; a constant column gets deviation 1."""
    aggs = [f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = train.agg(*aggs).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def fit_vector_scaler(train: DataFrame, n_rows: int, width: int, vector: str = "features",
                      out: str = "scaled") -> PipelineModel:
    """Vector form: centre, then divide by the population deviation; a constant slot is only centred, as in columns."""
    centred = StandardScaler(withMean=True, withStd=False, inputCol=vector, outputCol="_centred").fit(train)
    factor = (n_rows / (n_rows - 1)) ** 0.5 if n_rows > 1 else 1.0  # the built-in deviation is that of a sample
    scales = [factor / d if d > 0 else 1.0 for d in centred.std.toArray()]
    return PipelineModel([centred, ElementwiseProduct(scalingVec=Vectors.dense(scales), inputCol="_centred", outputCol=out)])


def pick_columns(df: DataFrame, indices: list[int], vector: str = "features", out: str = "picked") -> DataFrame:
    """Keep the vector slots ``indices``, in that order."""
    return VectorSlicer(inputCol=vector, outputCol=out, indices=list(indices)).transform(df)
