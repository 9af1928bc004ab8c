"""Boosted trees under focal loss: histograms of binned rows, trees grown best leaf first.

Features are binned once. Some thousand rows are kept as one block of labels, bins (sparse where most are one bin)
and running scores, which stays where it is. Every pass over the blocks adds up gradients per leaf, feature and bin. The
driver holds trees and the histograms of open leaves, of a size that does not grow with the rows. Gradients are added as
scaled integers, so a fit does not depend on the order of partitions or on tasks that ran twice.

Rows of equal label and bins have equal scores in every tree, so narrow rows are grouped first and a block has groups and
their numbers of rows. A frame of at most ALONE_BYTES is fitted by one task in one job; a larger one takes a job a pass.
"""

from __future__ import annotations

import heapq
import math
import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlspark import constants as K
from urlspark.functions import focal
from urlspark.operators.blocks import DENSE_SLOTS, block_session, write_blocks
from urlspark.session import bound_batches, cut_lineage, remove_folder, scratch_path

TREE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, leaf int, value double, cover double"
)
BLOCK_SCHEMA = (
    "n int, held long, y binary, w binary, dense_slots binary, dense binary, slots binary, ends binary, rows binary, "
    "bins binary, z binary"
)
BLOCK_ROWS = 8_192  # a row's number in a block is two bytes
MAX_BINS = 256  # a bin is one byte
CELLS_A_PASS = 8_000_000  # cells (leaf, slot, bin) counted in one job
ROWS_A_REDUCER = 500_000  # of partial sums
ENTRIES_A_BLOCK = 1 << 20  # values spelled out at once
ALONE_BYTES = 128 << 20  # of bins, scores and gradients that one task may hold
ALONE_ROWS, ALONE_ENTRIES = 1 << 16, 1 << 19  # counted at once by such a task
MIN_CHILD_CURVATURE = 1e-3
MASK_LEAVES = 64  # of a tree that is scored by masks
MASKS_HELD = 1 << 20  # in the tables of some trees
SCORED_AT_ONCE = 512

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no package of ours


@dataclass
class Ensemble:
    """Frozen trees, one pandas row per node; features are vector slots, base score 0."""

    nodes: pd.DataFrame

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, TREE_SCHEMA)

    @staticmethod
    def from_table(table: DataFrame) -> "Ensemble":
        return Ensemble(table.orderBy("tree", "node").toPandas())  # nodes of the model, not rows

    @property
    def used_features(self) -> list[int]:
        return sorted(self.nodes.loc[self.nodes.feature >= 0, "feature"].unique().tolist())


class Edges(list):
    """Per slot the thresholds between its bins; ``usual`` has each slot's most frequent bin as far as its quantiles tell."""

    usual: np.ndarray | None = None


@dataclass
class _Cut:
    feature: int
    bin: int
    gain: float
    gl: float
    hl: float
    nl: int
    g: float
    h: float
    n: int


@dataclass
class _Growing:
    """A tree while it grows; node 0 is the root, children are numbered as they are made."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    sums: list[tuple | None] = field(default_factory=lambda: [None])  # gradient, curvature, rows
    depth: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add(self, sums: tuple, depth: int) -> int:
        for column, value in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.sums, sums),
                              (self.depth, depth), (self.gain, 0.0)):
            column.append(value)
        return len(self.feature) - 1

    def split(self, node: int, cut: _Cut) -> tuple[int, int]:
        """Give ``node`` its two children; a repeated call finds them again."""
        if self.left[node] < 0:
            self.feature[node], self.bin[node], self.gain[node] = cut.feature, cut.bin, cut.gain
            self.left[node] = self.add((cut.gl, cut.hl, cut.nl), self.depth[node] + 1)
            self.right[node] = self.add((cut.g - cut.gl, cut.h - cut.hl, cut.n - cut.nl), self.depth[node] + 1)
        return self.left[node], self.right[node]

    def walker(self):
        """Function from the rows of a block (``column`` gives a slot's bins) to node numbers; it carries plain numbers only."""
        cuts = [(i, f, c, left, right) for i, (f, c, left, right) in
                enumerate(zip(self.feature, self.bin, self.left, self.right)) if left >= 0]  # parents before their children

        def walk(n: int, column) -> np.ndarray:
            node, columns = np.zeros(n, dtype=np.int32), {}
            for i, f, cut, left, right in cuts:
                here = np.flatnonzero(node == i)
                if len(here):
                    if f not in columns:
                        columns[f] = column(f)
                    node[here] = np.where(columns[f][here] <= cut, left, right)
            return node

        return walk


def feature_edges(train: DataFrame, vector: str = "features", bins: int = 64) -> Edges:
    """Per slot the thresholds between its bins, from quantiles of all rows (one aggregation; digests merge map-side).

    The largest value is no threshold, NaN is above all, and a slot of one value has none.
    """
    if not 2 <= bins <= MAX_BINS:
        raise ValueError(f"bins must be from 2 to {MAX_BINS}")
    shares = [i / bins for i in range(1, bins)]
    size = train.select(F.max(F.size(vector_to_array(F.col(vector))))).first()[0] or 0
    edges = Edges([np.array([])] * size)
    edges.usual = _zero_bins(edges)

    def settle(slot: int, quantiles: list[float], top: float) -> None:
        values, times = np.unique(quantiles, return_counts=True)
        edges[slot] = values[values < top]
        edges.usual[slot] = np.searchsorted(edges[slot], values[times.argmax()], side="left")

    if 0 < size <= DENSE_SLOTS:  # a digest a slot, no row is spelled out as one of each value
        own = train.select(vector_to_array(F.col(vector)).alias("v"))
        at = [F.when(~F.isnan(F.get("v", F.lit(i))), F.get("v", F.lit(i))) for i in range(size)]
        one = own.agg(*[F.percentile_approx(v, shares, 10_000) for v in at], *[F.max(v) for v in at]).first()
        for i in range(size):
            if one[i] is not None:
                settle(i, one[i], one[size + i])
        return edges
    slots = train.select(F.posexplode(vector_to_array(F.col(vector))).alias("slot", "value"))
    found = slots.filter(~F.isnan("value")).groupBy("slot").agg(
        F.percentile_approx("value", shares, 10_000).alias("cuts"), F.max("value").alias("top"))
    for r in found.collect():  # one row per feature
        settle(r.slot, r.cuts, r.top)
    return edges


def _bins_of_zero(edges: list[np.ndarray]) -> np.ndarray:
    return np.array([np.searchsorted(cuts, 0.0, side="left") for cuts in edges], dtype=np.uint8)


def _zero_bins(edges: list[np.ndarray]) -> np.ndarray:
    """Per slot the bin that blocks leave out: its usual one where that is known (centred slots rarely hold a zero)."""
    usual = getattr(edges, "usual", None)
    return _bins_of_zero(edges) if usual is None else usual


def _packed_bins(y: np.ndarray, bins: np.ndarray, zero: np.ndarray) -> list:
    """The arrays of a block from a matrix of slots x rows."""
    n, held = len(y), bins != zero[:, None]
    counts = held.sum(axis=1)
    full = counts * 3 >= n
    dense_slots, slots = np.flatnonzero(full), np.flatnonzero(~full & (counts > 0))
    at, row = np.nonzero(held[slots])
    return [n, y, dense_slots.astype(np.int32), bins[dense_slots], slots.astype(np.int32),
            np.append(0, np.cumsum(counts[slots])).astype(np.int32), row.astype(np.uint16), bins[slots[at], row], np.zeros(n)]


def _block(n: int, arrays: list[np.ndarray], w: np.ndarray | None = None) -> pa.RecordBatch:
    """One block; ``w`` has the rows of each group (None: one)."""
    y, *rest = (pa.array([a.tobytes()], pa.binary()) for a in arrays)
    held, w = (n, b"") if w is None else (int(w.sum()), w.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int32()), pa.array([held], pa.int64()), y, pa.array([w], pa.binary()), *rest],
        [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])


def grouped(blocks: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of the different rows of ``blocks`` with the number of each: trees tell equal labels and bins not apart."""
    width, zero, read = len(edges), _zero_bins(edges), _block_reader(edges)

    def spell(batches):
        for batch in batches:
            for i in range(len(batch)):
                n, y, *_, column = read(batch, i)
                keys = np.empty((n, width + 1), np.uint8)
                for j in range(width):
                    keys[:, j] = column(j)
                keys[:, width] = y
                ends = np.arange(n + 1, dtype=np.int32) * (width + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(keys)])], ["key"])

    def pack(batches):
        for whole in batches:
            for begin in range(0, len(whole), BLOCK_ROWS):
                batch = whole.slice(begin, BLOCK_ROWS)
                keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(len(batch), width + 1)
                n, *arrays = _packed_bins(keys[:, width].copy(), np.ascontiguousarray(keys[:, :width].T), zero)
                yield _block(n, arrays, batch.column("w").to_numpy())

    counted = blocks.mapInArrow(spell, "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("w"))
    return counted.mapInArrow(pack, BLOCK_SCHEMA)


def binned(train: DataFrame, edges: list[np.ndarray], vector: str, label: str) -> DataFrame:
    """Blocks of at most BLOCK_ROWS rows (see BLOCK_SCHEMA) with running scores 0. Bin b has the values up to threshold b.

    A slot's bins are kept in full, a byte a row, or, where that is shorter, as the rows that are not in the usual bin
    and their bins; slots whose rows all are in the usual bin take no room. Vectors of up to DENSE_SLOTS slots are handed
    to Python as plain arrays, which takes a fifth of the time; longer sparse ones are never spelled out.
    """
    width, zero = len(edges), _zero_bins(edges)
    other = np.flatnonzero(zero != _bins_of_zero(edges))  # slots where a zero must be told

    def entries(batch):
        """(row, slot, value) of all values that a vector spells out, and of the zeros it does not where they are unusual."""
        kinds, values = batch.column("x").field("type").to_numpy(zero_copy_only=False), batch.column("x").field("values")
        sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(batch)), sizes)
        slot = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        slot[np.repeat(kinds == 0, sizes)] = batch.column("x").field("indices").flatten().to_numpy(zero_copy_only=False)
        value = values.flatten().to_numpy(zero_copy_only=False)
        if len(other) and not kinds.all():
            place = np.full(width, -1)
            place[other] = np.arange(len(other))
            told = np.repeat(kinds[:, None] != 0, len(other), axis=1)
            here = place[slot] >= 0
            told[row[here], place[slot[here]]] = True
            silent, column = np.nonzero(~told)
            row, slot = np.concatenate([row, silent]), np.concatenate([slot, other[column]])
            value = np.concatenate([value, np.zeros(len(silent))])
        return row, slot, value

    def packed(y, row, slot, bin_):
        n, order = len(y), np.lexsort((row, slot))
        row, slot, bin_ = row[order].astype(np.uint16), slot[order], bin_[order]
        counts = np.bincount(slot, minlength=width) if width else np.zeros(0, np.int64)
        full = counts * 3 >= n  # an entry has two bytes of row and one of bin
        dense_slots, slots = np.flatnonzero(full), np.flatnonzero(~full & (counts > 0))
        dense = np.repeat(zero[dense_slots][:, None], n, axis=1)
        inside = full[slot] if width else np.zeros(0, bool)
        dense[np.searchsorted(dense_slots, slot[inside]), row[inside]] = bin_[inside]
        return [n, y, dense_slots.astype(np.int32), dense, slots.astype(np.int32),
                np.append(0, np.cumsum(counts[slots])).astype(np.int32), row[~inside], bin_[~inside], np.zeros(n)]

    def packed_plain(y, x):
        """The same of values as a matrix of rows x slots."""
        bins = np.empty((width, len(y)), np.uint8)
        for j, cuts in enumerate(edges):
            bins[j] = np.searchsorted(cuts, x[:, j], side="left")
        return _packed_bins(y, bins, zero)

    def at_once(batch):
        """Rows of a block: fewer where a row spells out many values."""
        values = 1 if plain or not len(batch) else len(batch.column("x").field("values").flatten()) // len(batch)
        return min(BLOCK_ROWS, max(1, ENTRIES_A_BLOCK // max(1, values)))

    def assign(batches):
        for whole in batches:
            step = at_once(whole)
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                y = (batch.column("y").to_numpy(zero_copy_only=False) == 1).astype(np.uint8)
                if plain:
                    n, *arrays = packed_plain(y, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), width))
                    yield _block(n, arrays)
                    continue
                row, slot, value = entries(batch)
                order = np.argsort(slot, kind="stable")
                cuts_at = np.searchsorted(slot[order], np.arange(width + 1))
                bin_ = np.empty(len(slot), dtype=np.uint8)
                for j, cuts in enumerate(edges):
                    at = order[cuts_at[j]:cuts_at[j + 1]]
                    bin_[at] = np.searchsorted(cuts, value[at], side="left")
                held = bin_ != zero[slot] if width else np.zeros(0, bool)
                n, *arrays = packed(y, row[held], slot[held], bin_[held])
                yield _block(n, arrays)

    plain = 0 < width <= DENSE_SLOTS
    x = vector_to_array(F.col(vector)) if plain else F.col(vector)
    return train.select(F.col(label).cast("int").alias("y"), x.alias("x")).mapInArrow(assign, BLOCK_SCHEMA)


def _block_reader(edges: list[np.ndarray]):
    """Function from a row of blocks to (n, labels, rows of the groups, scores, dense slots, their bins, sparse slots, ends,
    rows, bins, column)."""
    zero = _zero_bins(edges)

    def read(batch, i: int):
        def part(name: str, kind) -> np.ndarray:
            return np.frombuffer(batch.column(name)[i].as_buffer(), kind)

        n = batch.column("n")[i].as_py()
        y, z, rows, bins = part("y", np.uint8), part("z", np.float64), part("rows", np.uint16), part("bins", np.uint8)
        dense_slots, slots, ends = (part(c, np.int32) for c in ("dense_slots", "slots", "ends"))
        w = part("w", np.int64)
        w = w.astype(float) if len(w) else np.ones(n)
        dense = part("dense", np.uint8).reshape(len(dense_slots), n)

        def column(slot: int) -> np.ndarray:
            at = np.searchsorted(dense_slots, slot)
            if at < len(dense_slots) and dense_slots[at] == slot:
                return dense[at]
            out, at = np.full(n, zero[slot], np.uint8), np.searchsorted(slots, slot)
            if at < len(slots) and slots[at] == slot:
                out[rows[ends[at]:ends[at + 1]]] = bins[ends[at]:ends[at + 1]]
            return out

        return n, y, w, z, dense_slots, dense, slots, ends, rows, bins, column

    return read


def _terms(gamma: float, alpha: float):
    """Function from labels and scores to (gradient, curvature, loss), as ``functions.focal`` has them.

    Nested like all that goes to the workers, so that they need only numpy and pandas.
    """
    def terms(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one = y == 1
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        pt = np.clip(np.where(one, p, 1.0 - p), 1e-15, 1.0 - 1e-15)
        weight, log_pt = np.where(one, alpha, 1.0 - alpha), np.log(pt)
        h = weight * p * (1.0 - p) * (1.0 - pt) ** (gamma - 1.0)
        g = h * np.where(one, 1.0, -1.0) * (gamma * log_pt - (1.0 - pt) / pt)
        return g, h, -weight * (1.0 - pt) ** gamma * log_pt

    return terms


def _logistic_terms():
    """The same under the logistic loss."""
    def terms(y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))
        return p - y, p * (1.0 - p), -np.log(np.clip(np.where(y == 1, p, 1.0 - p), 1e-15, 1.0))

    return terms


def _mean_loss(blocks: DataFrame, terms) -> float | None:
    def add_up(batches):
        for batch in batches:
            for y, w, z, n in zip(*(batch.column(c).to_pylist() for c in ("y", "w", "z", "held"))):
                loss = terms(np.frombuffer(y, np.uint8), np.frombuffer(z))[2]
                loss = float(loss @ np.frombuffer(w, np.int64)) if w else loss.sum()
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss])], ["n", "loss"])

    return blocks.select("held", "y", "w", "z").mapInArrow(add_up, "n long, loss double").agg(F.sum("loss") / F.sum("n")).first()[0]


class _Histograms:
    """Gradient, curvature and rows per bin of every slot, for the leaves of a tree.

    Slots have as many cells as they have bins; the last cell of a leaf has its totals. Passes count what blocks hold, and
    the usual bin gets the rest of the total. Only the smaller of two siblings is counted, the other is the difference
    to their parent. The driver keeps them for open leaves only: cells are slots x bins, whatever the number of rows.
    """

    def __init__(self, blocks: DataFrame | None, edges: list[np.ndarray], terms, scale: float):
        self.blocks, self.terms, self.scale = blocks, terms, scale
        self.read = _block_reader(edges)
        sizes = np.array([len(cuts) + 1 for cuts in edges], dtype=np.int64)
        self.offsets = np.cumsum(sizes) - sizes
        self.sizes, self.cells = sizes, int(sizes.sum())
        self.zero = self.offsets + _zero_bins(edges)
        self.parts = blocks.rdd.getNumPartitions() if blocks is not None else 0
        self.held: dict[int, np.ndarray] = {}

    def count(self, tree: _Growing, families: list[tuple[int, int, int]]) -> None:
        """Histograms of both children of each (parent, left, right) (of the root: (-1, 0, 0)); the parents' are dropped."""
        small = [left if tree.sums[left] is None or tree.sums[left][2] <= tree.sums[right][2] else right
                 for _, left, right in families]
        for begin in range(0, len(small), max(1, CELLS_A_PASS // (self.cells + 1))):
            self._scan(tree, small[begin:begin + max(1, CELLS_A_PASS // (self.cells + 1))])
        for (parent, left, right), counted in zip(families, small):
            if parent >= 0:
                self.held[left + right - counted] = self.held.pop(parent) - self.held[counted]

    def _scan(self, tree: _Growing, nodes: list[int]) -> None:
        read, terms, scale, offsets, stride = self.read, self.terms, self.scale, self.offsets, self.cells + 1
        walk, slot_of = tree.walker(), np.full(len(tree.feature), -1)
        slot_of[nodes] = np.arange(len(nodes))
        ends, k = offsets + self.sizes, len(nodes)

        def add(sums, lo, hi, cell, weights):
            """Adds to the cells from lo to hi of all leaves. Weights are whole numbers, and so are their sums in a block."""
            for total, weight in zip(sums, weights):
                found = np.bincount(cell, weights=weight, minlength=k * (hi - lo))
                total[:, lo:hi] += np.rint(found).astype(np.int64).reshape(k, hi - lo)

        def add_up(batches):
            sums = np.zeros((3, k, stride), dtype=np.int64)
            for batch in batches:
                for i in range(len(batch)):
                    n, y, w, z, dense_slots, dense, slots, cuts, rows, bins, column = read(batch, i)
                    at = slot_of[walk(n, column)]
                    inside = np.flatnonzero(at >= 0)
                    if not len(inside):
                        continue
                    own = at[inside]
                    one = w[inside]
                    g, h = (np.rint(t * scale) * one for t in terms(y[inside], z[inside])[:2])
                    add(sums, stride - 1, stride, own, (g, h, one))
                    step = max(1, (1 << 19) // len(inside))
                    for b in range(0, len(dense_slots), step):
                        part = dense_slots[b:b + step]
                        lo, hi = int(offsets[part[0]]), int(ends[part[-1]])
                        cell = (own * (hi - lo) + dense[b:b + step, inside] + (offsets[part] - lo)[:, None]).ravel()
                        add(sums, lo, hi, cell, (np.tile(w, len(part)) for w in (g, h, one)))
                    if len(rows):
                        place = np.full(n, -1)
                        place[inside] = np.arange(len(inside))
                        place = place[rows]
                        there = np.flatnonzero(place >= 0)
                        place = place[there]
                        first = np.repeat(offsets[slots], np.diff(cuts))[there]
                        add(sums, 0, stride - 1, own[place] * (stride - 1) + first + bins[there], (g[place], h[place], one[place]))
            leaf, cell = np.nonzero(sums[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(cell, pa.int32()), *map(pa.array, sums[:, leaf, cell])],
                ["leaf", "cell", "g", "h", "n"])

        parts = self.blocks.mapInArrow(add_up, "leaf int, cell int, g long, h long, n long")
        if self.parts * k * stride > ROWS_A_REDUCER:
            reducers = min(self.parts, self.parts * k * stride // ROWS_A_REDUCER)
            parts = parts.repartition(reducers, "cell").groupBy("cell", "leaf").agg(*[F.expr(f"sum({c}) AS {c}") for c in "ghn"])
        found = parts.toArrow()  # at most leaves x cells, or ROWS_A_REDUCER partial sums without a second stage
        leaf, cell, *values = (found.column(c).to_numpy() for c in ("leaf", "cell", "g", "h", "n"))
        sums = np.zeros((3, k, stride), dtype=np.int64)
        for total, value in zip(sums, values):
            np.add.at(total, (leaf, cell), value)
        self._keep(nodes, sums)

    def _keep(self, nodes: list[int], sums: np.ndarray) -> None:
        for i, node in enumerate(nodes):
            own = sums[:, i]
            if self.cells:
                own[:, self.zero] += own[:, -1:] - np.add.reduceat(own[:, :-1], self.offsets, axis=1)
            self.held[node] = own

    def totals(self, node: int) -> tuple[float, float, int]:
        g, h, n = self.held[node][:, -1].tolist()
        return g / self.scale, h / self.scale, n

    def best_cut(self, node: int, min_child: int, min_curvature: float, l1: float, l2: float) -> _Cut | None:
        """The cut of the highest gain, of equals that of the lowest slot and threshold; None if none is allowed."""
        if not self.cells:
            return None
        upto = np.cumsum(self.held[node][:, :-1], axis=1)
        before = np.concatenate([np.zeros((3, 1), np.int64), upto[:, self.offsets[1:] - 1]], axis=1)
        gl, hl, nl = upto - np.repeat(before, self.sizes, axis=1)
        gl, hl = gl / self.scale, hl / self.scale
        g, h, n = self.totals(node)

        def quality(g, h):
            return np.divide(np.maximum(np.abs(g) - l1, 0.0) ** 2, h + l2, out=np.zeros(np.shape(g)), where=np.not_equal(h + l2, 0))

        gain = quality(gl, hl) + quality(g - gl, h - hl) - quality(np.array([g]), np.array([h]))
        allowed = (np.minimum(nl, n - nl) >= max(min_child, 1)) & (np.minimum(hl, h - hl) >= min_curvature)
        gain = np.where(allowed, gain, -1.0)
        at = int(gain.argmax())
        slot = int(np.searchsorted(self.offsets, at, side="right")) - 1
        return _Cut(slot, at - int(self.offsets[slot]), float(gain[at]), float(gl[at]), float(hl[at]), int(nl[at]), g, h, n)


class _Rows:
    """The blocks of a small frame in one process: bins by slot, and where most are the usual one only the others, by row and
    by slot."""

    def __init__(self, edges: list[np.ndarray], blocks: list[tuple]):
        zero, sizes = _zero_bins(edges), np.array([len(cuts) + 1 for cuts in edges], dtype=np.int64)
        self.zero, self.width, self.n = zero, len(edges), sum(b[0] for b in blocks)
        self.y, self.w, self.z = (np.concatenate([b[i] for b in blocks] or [np.zeros(0)]) for i in (1, 2, 3))
        counts = np.zeros(self.width, np.int64)
        for _, _, _, _, dense_slots, dense, slots, ends, *_ in blocks:
            counts[dense_slots] += (dense != zero[dense_slots][:, None]).sum(axis=1)
            counts[slots] += np.diff(ends)
        self.full = counts * 3 >= max(self.n, 1)
        self.dense_slots, self.place = np.flatnonzero(self.full), np.cumsum(self.full) - 1
        self.dense, found, at = np.repeat(zero[self.full][:, None], self.n, axis=1), [], 0
        for n, _, _, _, dense_slots, dense, slots, ends, rows, bins, _ in blocks:
            for slot, column in zip(dense_slots, dense):
                if self.full[slot]:
                    self.dense[self.place[slot], at:at + n] = column
                else:
                    here = np.flatnonzero(column != zero[slot])
                    found.append((here + at, np.full(len(here), slot), column[here]))
            slot = np.repeat(slots, np.diff(ends))
            here = self.full[slot] if len(slot) else np.zeros(0, bool)
            self.dense[self.place[slot[here]], at + rows[here].astype(np.int64)] = bins[here]
            found.append((rows[~here].astype(np.int64) + at, slot[~here], bins[~here]))
            at += n
        row, slot, bins = (np.concatenate([f[i] for f in found] or [np.zeros(0)]).astype(kind)
                           for i, kind in enumerate((np.int32, np.int32, np.uint8)))
        order = np.lexsort((row, slot))
        self.rows_of, self.bins_of = row[order], bins[order]
        self.slot_ends = np.append(0, np.cumsum(np.bincount(slot, minlength=self.width)))
        cell = ((np.cumsum(sizes) - sizes)[slot] + bins).astype(np.int32)
        self.cells = cell[np.argsort(row, kind="stable")]
        self.row_ends = np.append(0, np.cumsum(np.bincount(row, minlength=self.n)))

    def column(self, slot: int) -> np.ndarray:
        if self.full[slot]:
            return self.dense[self.place[slot]]
        out, a, b = np.full(self.n, self.zero[slot], np.uint8), *self.slot_ends[slot:slot + 2]
        out[self.rows_of[a:b]] = self.bins_of[a:b]
        return out


class _Alone(_Histograms):
    """Histograms of one tree over ``_Rows``; the rows of each leaf are kept apart, so that a leaf reads its own ones only."""

    def __init__(self, rows: _Rows, edges: list[np.ndarray], terms, scale: float):
        super().__init__(None, edges, terms, scale)
        self.rows, self.of, self.below = rows, {0: np.arange(rows.n, dtype=np.int32)}, {}
        self.g, self.h = (np.rint(t * scale) * rows.w for t in terms(rows.y, rows.z)[:2])

    def part(self, tree: _Growing, node: int) -> None:
        own = self.of.pop(node)
        low = self.rows.column(tree.feature[node])[own] <= tree.bin[node]
        self.of[tree.left[node]], self.of[tree.right[node]] = own[low], own[~low]
        self.below[node] = tree.left[node], tree.right[node]

    def count(self, tree: _Growing, families: list[tuple[int, int, int]]) -> None:
        for parent, *_ in families:
            if parent >= 0:
                self.part(tree, parent)
        super().count(tree, families)

    def _scan(self, tree: _Growing, nodes: list[int]) -> None:
        rows, k, stride, top = self.rows, len(nodes), self.cells + 1, int(self.sizes.max(initial=1))
        sums = np.zeros((3, k, stride))  # whole numbers below 2^53
        every = np.concatenate([self.of[node] for node in nodes])
        leaf = np.repeat(np.arange(k), [len(self.of[node]) for node in nodes])
        for begin in range(0, len(every), ALONE_ROWS):
            at, own = every[begin:begin + ALONE_ROWS], leaf[begin:begin + ALONE_ROWS]
            weights = (self.g[at], self.h[at], rows.w[at])
            for total, weight in zip(sums, weights):
                total[:, -1] += np.bincount(own, weight, k)
            base = own * top
            for slot, column in zip(rows.dense_slots, rows.dense):
                cell, lo, size = base + column[at], self.offsets[slot], self.sizes[slot]
                for total, weight in zip(sums, weights):
                    total[:, lo:lo + size] += np.bincount(cell, weight, k * top).reshape(k, top)[:, :size]
            if not len(rows.cells):
                continue
            held = rows.row_ends[at + 1] - rows.row_ends[at]
            ends = np.cumsum(held)
            cuts = np.flatnonzero(np.diff(ends // ALONE_ENTRIES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                sizes = held[a:b]
                place = np.arange(sizes.sum()) + np.repeat(rows.row_ends[at[a:b]] - (np.cumsum(sizes) - sizes), sizes)
                cell = np.repeat(own[a:b] * stride, sizes) + rows.cells[place]
                for total, weight in zip(sums, weights):
                    total += np.bincount(cell, np.repeat(weight[a:b], sizes), k * stride).reshape(k, stride)
        self._keep(nodes, sums.astype(np.int64))

    def score(self, tree: _Growing, values: np.ndarray) -> None:
        """Adds the values of the settled leaves to the rows' scores. Rows of splits that were taken back lie further down."""
        settled = {}
        for node in range(len(tree.feature)):  # parents before their children
            settled[node] = settled.get(node, node)
            if tree.left[node] >= 0:
                if node in self.of:
                    self.part(tree, node)
            else:
                for child in self.below.get(node, ()):
                    settled[child] = settled[node]
        for node, own in self.of.items():
            self.rows.z[own] += values[settled[node]]


def _grow(hist: _Histograms, max_leaves: int, min_child: int, min_curvature: float, l1: float, l2: float,
          max_depth: int | None = None) -> _Growing:
    """One tree, always splitting the leaf of the highest gain, to at most ``max_leaves`` leaves (and ``max_depth`` levels).

    The order is replayed from the known cuts. Where it reaches leaves not looked at yet, it goes on without them and
    then all of them are looked at in one job, so jobs number about the tree's depth, not its leaves.
    """
    tree, cuts, families = _Growing(), {}, [(-1, 0, 0)]
    while families:
        hist.count(tree, families)
        for parent, *children in families:
            for node in dict.fromkeys(children):
                if node not in cuts:
                    cuts[node] = hist.best_cut(node, min_child, min_curvature, l1, l2)
                if cuts[node] is None or cuts[node].gain <= 0:
                    if node:
                        hist.held.pop(node)
        if tree.sums[0] is None:
            tree.sums[0] = hist.totals(0)
        families, chosen = [], []
        queue = [(-cuts[0].gain, 0)] if cuts[0] is not None and cuts[0].gain > 0 else []
        leaves = 1
        while queue and leaves < max_leaves:
            _, node = heapq.heappop(queue)
            chosen.append(node)
            leaves += 1
            children = tree.split(node, cuts[node])
            for child in children:
                if child not in cuts and (tree.sums[child][2] < 2 * max(min_child, 1) or tree.depth[child] == max_depth):
                    cuts[child] = None
            if any(child not in cuts for child in children):
                if leaves < max_leaves:  # what comes after the last split changes nothing
                    families.append((node, *children))
            for child in children:
                if cuts.get(child) is not None and cuts[child].gain > 0:
                    heapq.heappush(queue, (-cuts[child].gain, child))
    for node in range(len(tree.feature)):  # cuts that the settled order does not take
        if tree.left[node] >= 0 and node not in chosen:
            tree.left[node] = tree.right[node] = tree.feature[node] = -1
    return tree


def _newton_step(g: float, h: float, rate: float, l1: float, l2: float) -> float:
    shrunk = math.copysign(max(abs(g) - l1, 0.0), g)
    return -rate * shrunk / (h + l2) if shrunk and h + l2 > 0 else 0.0


def _frozen(tree: _Growing, number: int, edges: list[np.ndarray], values: np.ndarray) -> list[dict]:
    """Pre-order node list; leaves are numbered left to right."""
    rows: list[dict] = []
    leaves = 0
    stack = [(0, None, None)]
    while stack:
        node, parent, side = stack.pop()
        at = len(rows)
        if parent is not None:
            rows[parent][side] = at
        row = {"tree": number, "node": at, "feature": tree.feature[node], "threshold": 0.0, "left": -1, "right": -1,
               "leaf": -1, "value": 0.0, "cover": float(tree.sums[node][2]), "gain": 0.0}
        rows.append(row)
        if tree.left[node] < 0:
            row["leaf"], row["value"] = leaves, float(values[node])
            leaves += 1
        else:
            row["threshold"], row["gain"] = float(edges[tree.feature[node]][tree.bin[node]]), tree.gain[node]
            stack += [(tree.right[node], at, "right"), (tree.left[node], at, "left")]
    return rows


def fit_focal_boost(train: DataFrame, rounds: int = K.BOOST_ROUNDS, vector: str = "features", label: str = "label",
                    gamma: float = K.FOCAL_GAMMA, alpha: float = K.FOCAL_ALPHA,
                    rate: float = K.BOOST_RATE, max_leaves: int = K.BOOST_LEAVES,
                    min_child: int = K.BOOST_MIN_CHILD, l1: float = K.BOOST_L1, l2: float = K.BOOST_L2,
                    min_curvature: float = MIN_CHILD_CURVATURE, bins: int = 64, checkpoint_every: int = 10,
                    history: list[float] | None = None) -> Ensemble:
    """Fit ``rounds`` trees of at most ``max_leaves`` leaves. ``history``, if given, receives the mean loss before each round.

    A cut's gain is T(G)^2/(H + l2) of both sides less that of the leaf, T shrinking G by ``l1``; a leaf's value is the
    Newton step -rate T(G)/(H + l2). Equal gains take the lowest slot and threshold. The frame is cached per round and
    written to the checkpoint folder at first and every few rounds, so neither the plan nor the work to rebuild a lost partition grows
    with the rounds. Rows with a NULL label or vector are left out; an empty table gives trees of one leaf of value 0.
    """
    rows, _ = _fit(train, _terms(gamma, alpha), rounds, vector, label, rate, bins, checkpoint_every, history,
                   max_leaves=max_leaves, min_child=min_child, min_curvature=min_curvature, l1=l1, l2=l2)
    return Ensemble(pd.DataFrame(rows, columns=[c.split()[0] for c in TREE_SCHEMA.split(", ")]))


def split_gains(train: DataFrame, rounds: int, depth: int, vector: str = "features", label: str = "label", bins: int = 64,
                rate: float = 0.3, l2: float = 1.0, min_curvature: float = 1.0) -> np.ndarray:
    """Mean gain of the splits on each slot in ``rounds`` trees of at most ``depth`` levels under the logistic loss.

    A tree takes as many passes as it has levels, whatever its leaves; every leaf with a cut of positive gain is split.
    """
    rows, width = _fit(train, _logistic_terms(), rounds, vector, label, rate, bins, max_leaves=2 ** depth, min_child=1,
                       min_curvature=min_curvature, l1=0.0, l2=l2, max_depth=depth)
    feature, gain = (np.array([r[c] for r in rows]) for c in ("feature", "gain"))
    inner = feature >= 0
    sums, splits = (np.bincount(feature[inner], weights=w, minlength=width) for w in (gain[inner], None))
    return sums / np.maximum(splits, 1)


def _fit(train: DataFrame, terms, rounds: int, vector: str, label: str, rate: float, bins: int, checkpoint_every: int = 10,
         history: list[float] | None = None, **limits) -> tuple[list[dict], int]:
    """(nodes of all trees, slots) of boosting under any loss; ``limits`` are those of ``_grow``."""
    usable = train.select(label, vector).filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    bound_batches(train.sparkSession)
    edges = feature_edges(usable, vector, bins)
    path = scratch_path(train.sparkSession, "boost-blocks")
    blocks = binned(usable, edges, vector, label)
    if rounds > 1 and 0 < len(edges) <= DENSE_SLOTS:  # one shuffle, which all passes gain from
        blocks = grouped(blocks, edges)
    write_blocks(blocks, path)
    own = block_session(train.sparkSession)
    frame = own.read.schema(BLOCK_SCHEMA).parquet(path)
    size = {c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in ("dense", "bins")}
    total, most, n, dense, sparse = frame.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.max("held"), F.lit(0)),
                                              F.coalesce(F.sum("n"), F.lit(0)), *size.values()).first()
    try:
        if dense + 12 * sparse + 56 * n <= ALONE_BYTES:
            rows = _fitted_alone(frame, edges, terms, rounds, rate, 51 - math.ceil(math.log2(total + 1)), history, limits)
            return rows, len(edges)
        # |gradient| < 2 and curvature < 1, so the sums of a block stay below 2^53 and those of all rows below 2^62.
        scale = float(2 ** min(38, 61 - math.ceil(math.log2(total + 1)), 51 - math.ceil(math.log2(most + 1))))
        return _fitted_by_passes(frame, edges, terms, rounds, rate, scale, checkpoint_every, history, limits), len(edges)
    finally:
        remove_folder(own, path)


def _fitted_by_passes(frame: DataFrame, edges: list[np.ndarray], terms, rounds: int, rate: float, scale: float,
                      checkpoint_every: int, history: list[float] | None, limits: dict) -> list[dict]:
    """Nodes of all trees, a job a pass."""
    rows: list[dict] = []
    retired: list[DataFrame] = []
    try:
        frame = frame.persist()
        for number in range(rounds):
            if history is not None:
                history.append(_mean_loss(frame, terms))
            tree = _grow(_Histograms(frame, edges, terms, scale), **limits)
            values = np.array([_newton_step(g, h, rate, limits["l1"], limits["l2"]) for g, h, _ in tree.sums])
            rows += _frozen(tree, number, edges, values)
            # this round's passes have filled the cache of the frame, so the one before can go
            while retired:
                retired.pop().unpersist()
            scored = frame.mapInArrow(_step(tree, values, edges), BLOCK_SCHEMA)
            retired.append(frame)
            frame = cut_lineage(scored) if (number + 1) % checkpoint_every == 0 else scored.persist()
    finally:
        for df in (*retired, frame):
            df.unpersist()
    return rows


def _fitted_alone(frame: DataFrame, edges: list[np.ndarray], terms, rounds: int, rate: float, bits: int,
                  history: list[float] | None, limits: dict) -> list[dict]:
    """The same by one task. Sums of all rows are whole numbers below 2^53, so the trees don't depend on the rows' order."""
    read, scale, losses = _block_reader(edges), float(2 ** min(38, bits)), history is not None

    def fit(batches):
        rows = _Rows(edges, [read(batch, i) for batch in batches for i in range(len(batch))])
        for number in range(rounds):
            loss = float(terms(rows.y, rows.z)[2] @ rows.w / rows.w.sum()) if losses and rows.n else None
            hist = _Alone(rows, edges, terms, scale)
            tree = _grow(hist, **limits)
            values = np.array([_newton_step(g, h, rate, limits["l1"], limits["l2"]) for g, h, _ in tree.sums])
            hist.score(tree, values)
            yield pa.RecordBatch.from_pylist([r | {"loss": loss} for r in _frozen(tree, number, edges, values)], schema)

    kinds = {"int": pa.int32(), "double": pa.float64()}
    ddl = f"{TREE_SCHEMA}, gain double, loss double"
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])
    found = frame.coalesce(1).mapInArrow(fit, ddl).toArrow()  # nodes of the model
    rows = (found if len(found) else pa.Table.from_batches(fit([]), schema)).to_pylist()
    losses = {r["tree"]: r.pop("loss") for r in rows}
    if history is not None:
        history.extend(losses.values())
    return rows


def _step(tree: _Growing, values: np.ndarray, edges: list[np.ndarray]):
    walk, read = tree.walker(), _block_reader(edges)

    def step(batches):
        for batch in batches:
            scores = []
            for i in range(len(batch)):
                n, _, _, z, *_, column = read(batch, i)
                scores.append((z + values[walk(n, column)]).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.binary())], batch.schema.names)

    return step


def _node_arrays(model: Ensemble, used: list[int]) -> list[tuple[np.ndarray, ...]]:
    """Per tree (feature, threshold, left, right, value), with feature slots renumbered to the used ones."""
    slot = {f: i for i, f in enumerate(used)}
    out = []
    for _, t in model.nodes.groupby("tree", sort=True):
        t = t.sort_values("node")
        out.append((
            np.array([slot.get(f, 0) for f in t.feature]), t.threshold.to_numpy(),
            t.left.to_numpy(), t.right.to_numpy(), t.value.to_numpy(),
        ))
    return out


def _leaf_masks(trees: list[tuple[np.ndarray, ...]], width: int):
    """(thresholds by slot, [(slots, tables, values)] of some trees at a time) for trees of at most MASK_LEAVES leaves.

    Bit i of a tree's mask is its leaf i, left to right. A table has, for each of a slot's bins and each tree, the leaves that
    no cut on the slot rules out: those left of a threshold below the value are. The row's leaf is the first that all tables leave.
    """
    cuts = [np.unique(np.concatenate([t[1][(t[0] == f) & (t[2] >= 0)] for t in trees] or [[]])) for f in range(width)]
    found, values = [], np.zeros((len(trees), MASK_LEAVES))
    for k, (feature, threshold, left, right, value) in enumerate(trees):
        inner, order, stack = {}, 0, [(0, False)]
        reach = [0] * len(left)
        while stack:  # leaves left to right
            node, done = stack.pop()
            if left[node] < 0:
                values[k, order], reach[node] = value[node], 1 << order
                order += 1
            elif done:
                reach[node] = reach[left[node]] | reach[right[node]]
                f = int(feature[node])
                table = inner.setdefault(f, np.full(len(cuts[f]) + 1, ~np.uint64(0)))
                table[np.searchsorted(cuts[f], threshold[node]) + 1:] &= ~np.uint64(reach[left[node]])
            else:
                stack += [(node, True), (right[node], False), (left[node], False)]
        found.append(inner)

    def cost(size):
        """Of a row: a look-up in each slot that some of ``size`` trees read."""
        parts = [set().union(*found[i:i + size]) for i in range(0, len(found), size)]
        room = max((sum(len(cuts[f]) + 1 for f in p) * size for p in parts), default=0)
        return (room > MASKS_HELD, sum(len(p) for p in parts) * (6 + size))

    size, groups = min((1, 8, 64, 512), key=cost), []
    for i in range(0, len(found), size):
        part = found[i:i + size]
        slots = sorted(set().union(*part))
        tables = [np.stack([t.get(f, np.full(len(cuts[f]) + 1, ~np.uint64(0))) for t in part], axis=1) for f in slots]
        groups.append((slots, tables, values[i:i + size]))
    return cuts, groups


def predict_raw(df: DataFrame, model: Ensemble, vector: str = "features", out: str = "raw") -> DataFrame:
    """Adds the raw score. The trees travel to each task once; rows are scored in Arrow batches.

    Only the slots that some tree reads are handed to Python. Trees of more than MASK_LEAVES leaves are walked node by node, the
    others by their leaf masks. The function sent to the workers holds plain arrays, so they need nothing but numpy and pandas.
    """
    used = model.used_features
    trees = _node_arrays(model, used)
    small = [len(t[2]) <= 2 * MASK_LEAVES - 1 for t in trees]
    large, (cuts, groups) = [t for t, s in zip(trees, small) if not s], _leaf_masks([t for t, s in zip(trees, small) if s], len(used))
    if not used:
        groups = [([], [], values) for _, _, values in groups]

    def part(x: np.ndarray) -> np.ndarray:
        total, at = np.zeros(len(x)), np.arange(len(x))
        bins = [np.searchsorted(own, x[:, f], side="left") for f, own in enumerate(cuts)]  # NaN is above all
        for slots, tables, values in groups:
            masks = np.full((len(x), len(values)), ~np.uint64(0))
            for f, table in zip(slots, tables):
                masks &= table.take(bins[f], axis=0)
            leaf = np.bitwise_count((masks & (~masks + np.uint64(1))) - np.uint64(1))
            total += values.ravel().take(leaf + np.arange(len(values)) * values.shape[1]).sum(axis=1)
        for feature, threshold, left, right, value in large:
            node = np.zeros(len(x), dtype=int)
            while (left[node] >= 0).any():
                goes_left = x[at, feature[node]] <= threshold[node]
                below = np.where(goes_left, left[node], right[node])
                node = np.where(left[node] >= 0, below, node)
            total += value[node]
        return total

    @F.arrow_udf("double")
    def score(slots: pa.Array) -> pa.Array:
        x = slots.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(slots), -1)
        return pa.array(np.concatenate([part(x[i:i + SCORED_AT_ONCE]) for i in range(0, len(x), SCORED_AT_ONCE)] or [np.zeros(0)]))

    staged = df.withColumn("_dense", vector_to_array(F.col(vector)))
    picked = F.array(*[F.get("_dense", F.lit(i)) for i in used]) if used else F.array(F.lit(0.0))
    return staged.withColumn(out, score(picked)).drop("_dense")


def predict(df: DataFrame, model: Ensemble, vector: str = "features") -> DataFrame:
    """Adds raw, prob_0, prob_1 and prediction (prob_1 >= 0.5)."""
    scored = predict_raw(df, model, vector)
    return add_class(scored)


def add_class(scored: DataFrame, raw: str = "raw") -> DataFrame:
    p = focal.sigmoid(F.col(raw))
    return scored.withColumns({"prob_0": 1.0 - p, "prob_1": p, "prediction": (p >= 0.5).cast("int")})
