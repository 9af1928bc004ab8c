"""Explanation tables: importances, Shapley contributions and the per-row views on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.operators.boost import Ensemble
from urlspark.operators.scale import pick_columns

NODE = np.dtype([("tree", "<i4"), ("feature", "<i4"), ("threshold", "<f8"), ("left", "<i4"), ("right", "<i4"),
                 ("value", "<f8"), ("cover", "<f8")])
SENT_BYTES = 16 << 20  # of packed trees in one broadcast
TABLE_BYTES = 64 << 20  # of values that a task keeps
ROWS_AT_ONCE = 128  # x leaves of a tree x features of a path x 8 bytes are held at once


def split_importance(tree_table: DataFrame, names: DataFrame) -> DataFrame:
    """(feature, importance): number of splits per feature; ``names`` is (idx, feature).

    Features never split on count 0; slots without a name are left out.
    """
    splits = tree_table.filter(F.col("feature") >= 0).groupBy(F.col("feature").alias("idx")).agg(
        F.count(F.lit(1)).alias("importance")
    )
    return names.join(splits, "idx", "left").select(
        "feature", F.coalesce("importance", F.lit(0)).cast("long").alias("importance")
    )


def top_handcrafted(importance: DataFrame, handcrafted: DataFrame, k: int = K.TOP_IMPORTANCE) -> DataFrame:
    """Best k features whose name is in ``handcrafted(feature)``."""
    hits = importance.join(F.broadcast(handcrafted.select("feature")), "feature", "left_semi")  # 86 names
    return hits.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def top_ngram_bands(importance: DataFrame, handcrafted: DataFrame, k: int = K.TOP_IMPORTANCE,
                    band: int = K.IMPORTANCE_BAND) -> DataFrame:
    """Best k other features in bands of ``band`` ranks: (feature, importance, rank, band)."""
    others = importance.join(F.broadcast(handcrafted.select("feature")), "feature", "left_anti")
    best = others.orderBy(F.desc("importance"), F.asc("feature")).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("importance"), F.asc("feature")))  # k rows
    return best.withColumn("rank", rank).withColumn("band", F.ceil(F.col("rank") / band).cast("int"))


def node_bytes(nodes: pd.DataFrame) -> bytes:
    """The trees as one packed record a node, by tree and node: what travels to the workers."""
    t = nodes.sort_values(["tree", "node"])
    packed = np.empty(len(t), NODE)
    for c in NODE.names:
        packed[c] = t[c].to_numpy()
    return packed.tobytes()


def _tree_groups(nodes: pd.DataFrame, limit: int = SENT_BYTES) -> list[pd.DataFrame]:
    """Whole trees in groups of at most ``limit`` packed bytes (a larger tree alone)."""
    sizes = nodes.groupby("tree", sort=True).size() * NODE.itemsize
    number, groups, total = 0, {}, 0
    for tree, size in sizes.items():
        if total and total + size > limit:
            number, total = number + 1, 0
        groups[tree], total = number, total + size
    return [g for _, g in nodes.groupby(nodes.tree.map(groups), sort=True)]


def expected_score(nodes: pd.DataFrame) -> float:
    """Sum over trees of the mean leaf value, leaves weighed by the rows that reached them."""
    leaves = nodes[nodes.left < 0]
    top = nodes[nodes.node == 0].set_index("tree").cover.clip(lower=1.0)
    return float((leaves.value * leaves.cover / leaves.tree.map(top)).sum())


def _explainer(node_type: np.dtype, chunk: int, table_bytes: int):
    """Function from packed trees and used slots to a function from rows of those slots to their Shapley values.

    On the way to a leaf each distinct feature j either lets a row through (o_j = 1) or not (0); z_j is the share of rows
    let through when it is unknown. A feature's value is the leaf's value times (o_i - z_i) times the integral over t in
    [0, 1] of the product over the others of z_j (1 - t) + o_j t: a polynomial of the path's length, which Gauss-Legendre
    points give exactly. So a leaf of m features costs m * m / 2 steps a row, and no table of outcomes is kept.

    Nested like all that goes to the workers, so that they need only numpy and pandas.
    """
    def leaf_paths(tree: np.ndarray, slot: dict):
        """(slots, lower bounds, upper bounds, shares, value) of each leaf that counts."""
        stack = [(0, {})]
        while stack:
            i, limits = stack.pop()
            n = tree[i]
            if n["left"] < 0:
                if limits and n["value"] != 0.0:
                    yield [slot[f] for f in limits], *map(list, zip(*limits.values())), float(n["value"])
                continue
            f, cut = int(n["feature"]), float(n["threshold"])
            lo, hi, share = limits.get(f, (-np.inf, np.inf, 1.0))
            for child, low, high in ((int(n["left"]), lo, min(hi, cut)), (int(n["right"]), max(lo, cut), hi)):
                part = float(tree[child]["cover"] / n["cover"]) if n["cover"] else 0.0
                stack.append((child, {**limits, f: (low, high, share * part)}))

    def unpack(packed: bytes, used: list[int]):
        nodes, slot = np.frombuffer(packed, node_type), {f: i for i, f in enumerate(used)}
        cuts = np.flatnonzero(np.diff(nodes["tree"])) + 1
        for tree in np.split(nodes, cuts):
            paths = list(leaf_paths(tree, slot))
            if not paths:
                continue
            m = max(len(p[0]) for p in paths)
            # shorter paths are filled up with features that always let rows through and so get nothing
            cols = np.array([p[0] + [0] * (m - len(p[0])) for p in paths])
            lo = np.array([p[1] + [-np.inf] * (m - len(p[1])) for p in paths])
            hi = np.array([p[2] + [np.inf] * (m - len(p[2])) for p in paths])
            z = np.array([p[3] + [1.0] * (m - len(p[3])) for p in paths])
            filler = np.arange(m) >= np.array([len(p[0]) for p in paths])[:, None]
            points, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
            order = np.argsort(cols.ravel(), kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(cols.ravel()[order]) > 0))
            split = tree[tree["left"] >= 0]
            cuts = [(slot[int(f)], np.unique(split["threshold"][split["feature"] == f])) for f in np.unique(split["feature"])]
            yield (cols, lo, hi, z, filler, np.array([p[4] for p in paths]), (points + 1) / 2, weights / 2, order, heads,
                   cols.ravel()[order][heads]), cuts

    def one_tree(rows: np.ndarray, cols, lo, hi, z, filler, value, points, weights, order, heads, slots) -> np.ndarray:
        out = np.empty((len(rows), len(slots)))
        for begin in range(0, len(rows), chunk):
            v = rows[begin:begin + chunk][:, cols]
            through = (v > lo) & (v <= hi) | filler
            whole = np.zeros(v.shape)
            for t, w in zip(points, weights):
                factor = z * (1.0 - t) + through * t
                product = w * factor.prod(axis=2, keepdims=True)
                # a factor of 0 makes the product 0, and its own difference is 0 too
                whole += product / np.where(factor == 0.0, 1.0, factor)
            whole *= (through - z) * value[:, None]
            out[begin:begin + chunk] = np.add.reduceat(whole.reshape(len(v), -1)[:, order], heads, axis=1)
        return out

    def numbered(x: np.ndarray, cuts: list) -> np.ndarray:
        """The cell of each row in a grid, numbered anew before numbers grow beyond 64 bits."""
        code, size = np.zeros(len(x), np.int64), 1
        for f, own in cuts:
            if size * (len(own) + 1) >= 1 << 62:
                different, code = np.unique(code, return_inverse=True)
                size = len(different)
            code = code * (len(own) + 1) + np.searchsorted(own, x[:, f], side="left")
            size *= len(own) + 1
        return code

    def prepare(packed: bytes, used: list[int]):
        """Rows that no threshold of a tree tells apart lie in one cell of its grid and have the same values there.

        Values are made once a cell that has rows, and kept for the task while all grids have at most ``table_bytes`` of
        them; of further trees they are made once a cell and batch.
        """
        trees, tables, held = list(unpack(packed, used)), {}, 0
        for i, (arrays, cuts) in enumerate(trees):
            size = math.prod(len(own) + 1 for _, own in cuts)
            if held + size * (len(arrays[-1]) * 8 + 1) <= table_bytes:
                held += size * (len(arrays[-1]) * 8 + 1)
                tables[i] = np.zeros(size, bool), np.zeros((size, len(arrays[-1])))

        def of_tree(x: np.ndarray, i: int) -> np.ndarray:
            arrays, cuts = trees[i]
            code = numbered(x, cuts)
            if i not in tables:
                _, first, back = np.unique(code, return_index=True, return_inverse=True)
                return one_tree(x[first], *arrays)[back]
            known, table = tables[i]
            missing = np.flatnonzero(~known[code])
            if len(missing):
                new, first = np.unique(code[missing], return_index=True)
                table[new], known[new] = one_tree(x[missing[first]], *arrays), True
            return table[code]

        def values(x: np.ndarray) -> np.ndarray:
            # as trees are walked: NaN is above and minus infinity below every threshold
            x, phi = np.nan_to_num(x, nan=np.inf, posinf=np.inf, neginf=np.finfo(float).min), np.zeros_like(x)
            for i, (arrays, _) in enumerate(trees):
                phi[:, arrays[-1]] += of_tree(x, i)
            return phi

        return values

    return prepare


def contributions(df: DataFrame, model: Ensemble, names: list[str], vector: str = "features",
                  key: str = "row_id") -> DataFrame:
    """(key, idx, feature, value, contribution, base): path-dependent Shapley values of the raw score.

    ``base`` plus a row's contributions equals its raw score. Only slots some tree splits
    on are listed; the others contribute 0. Rows are handled in Arrow batches where they are, by the
    packed trees, broadcast in groups of at most ``SENT_BYTES``; a larger model takes one narrow pass a group.
    """
    used, base = model.used_features, expected_score(model.nodes)
    named = F.array(*[F.lit(names[i]) for i in used]) if used else F.array(F.lit(""))
    zipped = F.arrays_zip(
        F.array(*[F.lit(i) for i in used] or [F.lit(-1)]).alias("idx"), named.alias("feature"),
        F.col("slots").alias("value"), F.col("phi").alias("contribution"),
    )
    return row_contributions(df, model, vector, (key,)).select(key, F.explode(zipped).alias("c")).select(
        key, F.col("c.idx").alias("idx"), F.col("c.feature").alias("feature"), F.col("c.value").alias("value"),
        F.col("c.contribution").alias("contribution"), F.lit(base).alias("base"),
    )


def row_contributions(df: DataFrame, model: Ensemble, vector: str = "features", keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keep..., slots, phi): per row the values and contributions of the used slots, in their order; narrow."""
    used = model.used_features
    prepare, context = _explainer(NODE, ROWS_AT_ONCE, TABLE_BYTES), df.sparkSession.sparkContext

    def explain_with(sent):
        def explain(batches):
            values, width = prepare(sent.value, used), max(len(used), 1)
            for batch in batches:
                if len(batch):
                    x, phi = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width) for c in batch.columns[-2:])
                    ends = pa.array(np.arange(0, (len(batch) + 1) * width, width, dtype=np.int32))
                    phi = pa.ListArray.from_arrays(ends, pa.array((phi + values(x)).ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], phi], batch.schema.names)

        return explain

    # sliced as vectors first, so that wide sparse rows are never spelled out
    slots = vector_to_array(F.col("_picked")) if used else F.array(F.lit(0.0))
    picked = pick_columns(df.select(*keep, vector), used, vector, "_picked") if used else df.select(*keep)
    per_row = picked.select(*keep, slots.alias("slots")).withColumn("phi", F.array_repeat(F.lit(0.0), max(len(used), 1)))
    for group in _tree_groups(model.nodes):
        per_row = per_row.mapInArrow(explain_with(context.broadcast(node_bytes(group))), per_row.schema)
    return per_row


def contribution_summary(contribs: DataFrame, k: int = K.SUMMARY_TOP) -> DataFrame:
    """(feature, mean_abs) of the k features with the largest mean absolute contribution."""
    return contribs.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")).orderBy(
        F.desc("mean_abs"), F.asc("feature")
    ).limit(k)


def summary_points(contribs: DataFrame, k: int = K.SUMMARY_TOP) -> DataFrame:
    """Every row's (feature, value, contribution) for the top k features."""
    top = contribution_summary(contribs, k)
    return contribs.join(F.broadcast(top), "feature")  # k rows


def row_key_at(rows: DataFrame, position: int, key: str = "row_id", fallback: int | None = None):
    """Key of the row at a 0-based position in key order; ``fallback`` position when out of range."""
    # Sorted in ranges; the ranges' sizes tell which one has the position, and only that one is looked into.
    ordered = rows.select(key).orderBy(key).withColumn("_range", F.spark_partition_id()).persist()
    try:
        sizes = sorted(ordered.groupBy("_range").count().collect())  # one row per range
        for wanted in (position, fallback):
            before = 0
            for part, size in sizes:
                if wanted is not None and before <= wanted < before + size:
                    return ordered.filter(F.col("_range") == part).orderBy(key).offset(wanted - before).first()[0]
                before += size
        return None
    finally:
        ordered.unpersist()


def decision_path(contribs: DataFrame, key: str = "row_id") -> DataFrame:
    """Adds ``step`` (smallest absolute contribution first) and the score ``cumulative`` after it.

    Meant for chosen rows; a window group is one row's features.
    """
    by_size = Window.partitionBy(key).orderBy(F.abs("contribution"), "feature")
    return contribs.withColumns({
        "step": F.row_number().over(by_size),
        "cumulative": F.col("base")
        + F.sum("contribution").over(by_size.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })


def waterfall(contribs: DataFrame, labelled: DataFrame, bars: int = K.WATERFALL_BARS,
              key: str = "row_id") -> DataFrame:
    """Per row at most ``bars`` bars, largest first; what does not fit is one bar ``other``.

    ``labelled`` has (key, prediction, label); ``base`` is the same for all features of a row. One sort by key serves the
    ranks, the sums and the join: there are no groups to keep in memory.
    """
    by_size = Window.partitionBy(key).orderBy(F.desc(F.abs("contribution")), F.asc("feature"))
    whole = Window.partitionBy(key)
    ranked = contribs.withColumn("bar", F.row_number().over(by_size)).withColumns({
        "_n": F.count(F.lit(1)).over(whole),
        "_rest": F.sum(F.when(F.col("bar") >= bars, F.col("contribution"))).over(whole),
    })
    lumped = (F.col("bar") == bars) & (F.col("_n") > bars)
    shown = ranked.filter(F.col("bar") <= bars).select(
        key, "base", "bar", F.when(lumped, "other").otherwise(F.col("feature")).alias("feature"),
        F.when(~lumped, F.col("value")).alias("value"),
        F.when(lumped, F.col("_rest")).otherwise(F.col("contribution")).alias("contribution"),
        F.when(lumped, F.col("_n") - (bars - 1)).otherwise(F.lit(1)).cast("long").alias("features"),
    )
    return shown.join(labelled.select(key, "prediction", "label"), key)


def scatter(contribs: DataFrame, feature: str, key: str = "row_id") -> DataFrame:
    """(key, value, contribution) of one feature."""
    return contribs.filter(F.col("feature") == feature).select(key, "value", "contribution")
