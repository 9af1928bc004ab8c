"""Feature selection: stability, mutual information, tree gain, merged rank, redundancy pruning."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlspark import constants as K
from urlspark.operators import ngrams
from urlspark.operators.blocks import BLOCK_SCHEMA, moments, reader, row_blocks, summed, total, write_blocks
from urlspark.operators.boost import split_gains
from urlspark.operators.l1 import fit_l1
from urlspark.operators.quantiles import quantile_edges
from urlspark.operators.scale import pick_columns
from urlspark.operators.split import order_hash, subsample_cuts
from urlspark.session import remove_folder, scratch_path


def stability_selection(train: DataFrame, runs: int = K.STABILITY_RUNS, fraction: float = K.STABILITY_FRACTION,
                        c: float = K.STABILITY_C, vector: str = "features", label: str = "label",
                        key: str = "row_id", seed: int = K.SEED, max_iter: int = 100) -> np.ndarray:
    """Share of subsample fits in which each feature keeps a non-zero L1 coefficient.

    A run is a bit of each row, set from the row's hash, and all runs are fitted in the same passes over the rows.
    """
    frame = train.select(key, label, vector)  # not kept: only keys are read again, and blocks are written at once
    cuts = {r.run: r.last_hash for r in subsample_cuts(frame.select(key), runs, fraction, key, seed).collect()}  # one per run
    members = [order_hash(key, seed + run) <= cuts[run] if run in cuts else F.lit(False) for run in range(runs)]
    fit = fit_l1(frame, c, vector, label, members, max_iter=max_iter)
    return (np.abs(fit.coefficients) > K.STABILITY_MIN_COEF).mean(axis=1)


def width_bins(df: DataFrame, columns: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Equal-width inner edges per column from one min/max pass."""
    row = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns)
                   for n, f in (("lo", F.min), ("hi", F.max))]).first()
    edges = {}
    for i, c in enumerate(columns):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        edges[c] = [] if lo is None or lo == hi else [lo + (hi - lo) * b / bins for b in range(1, bins)]
    return edges


def quantile_bins(df: DataFrame, columns: list[str], bins: int = 32) -> dict[str, list[float]]:
    """Inner edges at exact quantiles, all columns in the same few passes; repeated edges are merged."""
    return quantile_edges(df, columns, bins)


def binned_mutual_information(df: DataFrame, edges: dict[str, list[float]], label: str = "label") -> DataFrame:
    """(feature, mi) between each column's bin (value >= edge moves up) and the label.

    One pass to (feature, bin, label) counts, made for whole Arrow arrays and summed up before the shuffle; everything
    after works on that table of columns x bins x classes. A null or NaN lies in the last bin.
    """
    names, cuts = list(edges), [np.array(e, float) for e in edges.values()]
    first = np.append(0, np.cumsum([len(c) + 1 for c in cuts]))

    def count(batches):
        for batch in batches:
            if not len(batch):
                continue
            labels = batch.column(0).dictionary_encode(null_encoding="encode")
            code, classes = labels.indices.to_numpy(), len(labels.dictionary)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(cuts))
            cells = np.zeros(first[-1] * classes, np.int64)
            for i, own in enumerate(cuts):
                place = (np.searchsorted(own, x[:, i], side="right") + first[i]) * classes + code
                cells += np.bincount(place, minlength=len(cells))
            at = np.flatnonzero(cells)
            feature = np.searchsorted(first, at // classes, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(names).take(pa.array(feature)), pa.array((at // classes - first[feature]).astype(np.int32)),
                 labels.dictionary.take(pa.array(at % classes)), pa.array(cells[at])], ["feature", "bin", "label", "n"])

    values = F.array(*[F.col(c).cast("double") for c in names])
    staged = df.select(F.col(label).alias("label"), values.alias("values"))
    fields = [T.StructField("feature", T.StringType()), T.StructField("bin", T.IntegerType()), staged.schema["label"],
              T.StructField("n", T.LongType())]
    cells = staged.mapInArrow(count, T.StructType(fields)).groupBy("feature", "bin", "label").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    per_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    per_class = F.sum("n").over(Window.partitionBy("feature", "label"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    terms = cells.select(
        "feature", (F.col("n") / total * F.ln(F.col("n").cast("double") * total / (per_bin * per_class))).alias("t")
    )
    return terms.groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mi"))


def tree_gain(train: DataFrame, trees: int = K.IMPORTANCE_TREES, vector: str = "features", label: str = "label",
              depth: int = 5, bins: int = 64) -> np.ndarray:
    """Mean gain of the splits on each feature in boosted trees, as shares of 1; no row leaves the executors."""
    gain = split_gains(train, trees, depth, vector, label, bins)
    return gain / (gain.sum() or 1.0)


def hybrid_score(scores: DataFrame, mi_weight: float = K.MI_WEIGHT) -> DataFrame:
    """Adds ``hybrid`` = weighted sum of mi and gain, each over its maximum."""
    return ngrams.combined_score(scores, "feature", "mi", "gain", mi_weight, "hybrid")


def merged_rank(scores: DataFrame, threshold: float = K.FREQUENCY_THRESHOLD,
                weight: float = K.FREQUENCY_WEIGHT) -> DataFrame:
    """Features with frequency >= threshold (all when none reaches it), best merged score first."""
    merged = scores.withColumn("merged", weight * F.col("frequency") + (1.0 - weight) * F.col("hybrid"))
    best = scores.agg(F.max("frequency").alias("m")).scalar()
    return merged.filter((F.col("frequency") >= threshold) | (best < threshold)).orderBy(
        F.desc("merged"), F.asc("feature")
    )


PAIR_SLOTS = 1_024  # columns on either side of one block of pairs
PRUNE_SLOTS = 256  # candidates compared with the accepted ones at once
ROWS_AT_ONCE = 1_024


class _Products:
    """Sums of products of centred slots over all rows, for some slots against others."""

    def __init__(self, df: DataFrame, vector: str, width: int):
        rows = df.select(F.lit(0).alias("y"), vector).where(F.col(vector).isNotNull())
        self.path = scratch_path(df.sparkSession, "correlation-blocks")
        write_blocks(row_blocks(rows, "y", vector, F.lit(1).cast("long"), width), self.path)
        self.blocks = df.sparkSession.read.schema(BLOCK_SCHEMA).parquet(self.path)
        self.width = width
        self.means, deviations, _ = moments(self.blocks, width, False)
        n = self.blocks.agg(F.sum("n")).first()[0] or 0
        # r = sum of products * scale * scale; constant slots correlate with nothing
        self.scales = np.divide(1.0, deviations * np.sqrt(max(n, 1)), out=np.zeros(width), where=deviations > 0)

    def _one_block(self, left: np.ndarray, right: np.ndarray):
        read, means = reader(self.width, 1), self.means

        def one_block(batch, i):
            y, _, _, _, pick = read(batch, i)
            out = np.zeros((len(left), len(right)))
            for a in range(0, len(y), ROWS_AT_ONCE):
                b = min(len(y), a + ROWS_AT_ONCE)
                out += (pick(left, a, b) - means[left]).T @ (pick(right, a, b) - means[right])
            return out

        return one_block

    def cells(self, left: np.ndarray, right: np.ndarray) -> DataFrame:
        """(cell, v) with cell = place in left x len(right) + place in right."""
        return summed(self.blocks, self._one_block(left, right), len(left) * len(right))

    def matrix(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Their correlations on the driver."""
        sums = total(self.blocks, self._one_block(left, right), (len(left), len(right)))
        return sums * self.scales[left][:, None] * self.scales[right]


def correlation_pairs(df: DataFrame, columns: list[str], block: int = PAIR_SLOTS) -> DataFrame:
    """(f1, f2, r) Pearson correlation per column pair; constants give 0, rows with a null or NaN are left out.

    Sums of products of ``block`` x ``block`` columns are one pass over the rows; none of them comes to the driver.
    """
    spark, width = df.sparkSession, len(columns)
    vectors = VectorAssembler(inputCols=columns, outputCol="_slots", handleInvalid="skip").transform(df)
    products = _Products(vectors, "_slots", width)
    slots = spark.createDataFrame(
        [(i, c, float(s)) for i, (c, s) in enumerate(zip(columns, products.scales))], "i int, f string, scale double")
    out = []
    for a in range(0, width, block):
        for b in range(a, width, block):
            left, right = (np.arange(k, min(width, k + block)) for k in (a, b))
            place = products.cells(left, right).select(
                (F.floor(F.col("cell") / len(right)) + a).cast("int").alias("i1"),
                (F.col("cell") % len(right) + b).cast("int").alias("i2"), "v")
            out.append(place.where("i1 < i2"))
    pairs = functools.reduce(DataFrame.union, out)
    for k in ("1", "2"):  # a row a column
        pairs = pairs.join(F.broadcast(slots.select(*[F.col(c).alias(c + k) for c in ("i", "f", "scale")])), f"i{k}")
    return pairs.select("f1", "f2", (F.col("v") * F.col("scale1") * F.col("scale2")).alias("r"))


def prune_correlated(df: DataFrame, width: int, threshold: float = K.CORRELATION_DEFAULT, limit: int = K.MAX_FEATURES,
                     absolute: bool = False, vector: str = "features", block: int = PRUNE_SLOTS) -> list[int]:
    """``greedy_prune`` over the slots of a vector, best first, without the matrix of all slots.

    Each block of candidates is compared in one pass with the slots kept so far and with itself, so the driver holds
    ``block`` x (``limit`` + ``block``) correlations, and passes end with the limit.
    """
    products, kept = _Products(df, vector, width), []
    for begin in range(0, width, block):
        if len(kept) >= limit:
            break
        candidates = np.arange(begin, min(width, begin + block))
        right = np.concatenate([np.array(kept, int), candidates])
        r = products.matrix(candidates, right)
        r = np.abs(r) if absolute else r
        taken = list(range(len(kept)))  # columns of r
        for i, candidate in enumerate(candidates.tolist()):
            if len(kept) < limit and (not taken or max(0.0, r[i, taken].max()) < threshold):
                taken.append(len(right) - len(candidates) + i)
                kept.append(candidate)
    remove_folder(df.sparkSession, products.path)
    return kept


def greedy_prune(matrix: np.ndarray, threshold: float = K.CORRELATION_DEFAULT, limit: int = K.MAX_FEATURES,
                 absolute: bool = False) -> list[int]:
    """Positions kept when walking best first and dropping what correlates with a kept one.

    The comparison uses the signed correlation unless ``absolute``.
    """
    r = np.abs(matrix) if absolute else matrix
    kept: list[int] = []
    for i in range(len(r)):
        if len(kept) >= limit:
            break
        if not kept or max(0.0, r[i, kept].max()) < threshold:
            kept.append(i)
    return kept


def score_table(spark, names: list[str], frequency: np.ndarray, gain: np.ndarray) -> DataFrame:
    rows = [(i, n, float(frequency[i]), float(gain[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "idx int, feature string, frequency double, gain double")


def select_features(train: DataFrame, names: list[str], mi: DataFrame, vector: str = "features",
                    label: str = "label", key: str = "row_id", runs: int = K.STABILITY_RUNS,
                    trees: int = K.IMPORTANCE_TREES, correlation_threshold: float = K.CORRELATION_THRESHOLD,
                    limit: int = K.MAX_FEATURES, max_iter: int = 100, depth: int = 5) -> list[int]:
    """Indices of the selected features, best first; all of them when selection finds none.

    ``mi`` is (feature, mi) for every name. Driver data is per feature, never per row.
    """
    frequency = stability_selection(train, runs, vector=vector, label=label, key=key, max_iter=max_iter)
    gain = tree_gain(train, trees, vector, label, depth)
    if not frequency.any() or not gain.any():
        return list(range(len(names)))
    scores = score_table(train.sparkSession, names, frequency, gain).join(mi, "feature")
    ranked = [r.idx for r in merged_rank(hybrid_score(scores)).collect()]
    if not ranked:
        return list(range(len(names)))
    kept = prune_correlated(pick_columns(train, ranked, vector, "_ranked"), len(ranked), correlation_threshold, limit,
                            vector="_ranked")
    return [ranked[i] for i in kept]
