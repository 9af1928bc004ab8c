"""Classification metrics as aggregations."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_RANGES = 1000


def _share(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row (accuracy, precision, recall, f1); an empty denominator gives 0."""
    y, p = F.col(label), F.col(prediction)
    c = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("hit"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        _share(F.col("hit"), F.col("n")).alias("accuracy"), _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row (accuracy, weighted_f1): per-class F1 weighted by the class's rows.

    Works on the class-by-class count table, which is all that leaves the scan.
    """
    cells = df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).count()
    hit = F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(0)
    per_class = (
        cells.select(F.explode(F.array(
            F.struct(F.col("y").alias("c"), F.col("count").alias("actual"), F.lit(0).cast("long").alias("guessed"),
                     hit.cast("long").alias("hit")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("count").alias("guessed"),
                     F.lit(0).cast("long").alias("hit")),
        )).alias("s")).select("s.*").groupBy("c")
        .agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    )
    f1 = _share(2 * F.col("hit"), F.col("actual") + F.col("guessed"))
    return per_class.agg(
        _share(F.sum("hit"), F.sum("actual")).alias("accuracy"),
        _share(F.sum(f1 * F.col("actual")), F.sum("actual")).alias("weighted_f1"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", ranges: int = SCORE_RANGES) -> DataFrame:
    """One row (auc), exact with ties averaged; NULL when only one class occurs.

    Rows are first combined per distinct score, so a score shared by many rows is one row.
    Distinct scores are then cut into ranges at approximate quantiles (any cut is exact):
    running counts go inside a range, and the small table of range totals supplies what
    lies below it.
    """
    y = F.col(label)
    per_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    cuts = [i / ranges for i in range(1, ranges)]
    quantiles = F.percentile_approx(F.col(score).cast("double"), cuts, 10 * ranges)
    edges = df.agg(quantiles.alias("e")).first()["e"] or []
    splits = [-float("inf"), *sorted(set(edges)), float("inf")]
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="s", outputCol="r").transform(per_score)
    else:
        ranged = per_score.withColumn("r", F.lit(0.0))
    totals = ranged.groupBy("r").agg(F.sum("neg").alias("range_neg"))
    earlier = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = totals.select("r", F.coalesce(F.sum("range_neg").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    local = local.join(F.broadcast(base), "r")  # at most ``ranges`` rows
    wins = F.col("pos") * (F.col("base") + F.col("below") + F.col("neg") / 2.0)
    return local.agg(
        F.try_divide(F.sum(wins), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )
