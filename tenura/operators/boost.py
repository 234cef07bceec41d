"""Boosted regression trees of several folds, grown together: a step of all trees of all models is one scan.

The trees are those of Spark's gradient-boosted trees: squared error or log loss, leaf means of the negative gradient, variance gains over at most
``BINS`` bins of a feature, a first tree of weight 1 and later ones of weight ``RATE``. Tasks hold a part of the rows as arrays of bins with the
predictions so far, and give out sums per node, feature and bin; the driver sees these sums and the trees.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.errors import DataError
from tenura.session import checkpoint_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Bins per feature, rows of a fit that the bins are cut by (about), and the weight of a tree after the first.
BINS, BIN_ROWS, RATE = 32, 10_000, 0.1
#: Rows of a part, bytes of sums the driver adds up by itself, rounds between two cuts of the lineage, and rows scored at once.
PART_ROWS, DRIVER_BYTES, CUT, ROWS = 100_000, 32 << 20, 10, 8192


def thresholds(v: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Where a feature is cut: between all of its values, or nearest to equal counts if it has more than ``bins``."""
    values, counts = np.unique(v, return_counts=True)
    between = (values[:-1] + values[1:]) / 2
    if len(between) <= bins - 1:
        return between
    stride, seen = len(v) / bins, np.cumsum(counts)
    out, target = [], stride
    for i in range(1, len(values)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def bins_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (feature, row) of rows (row, feature): how many cuts lie below each value."""
    return np.array([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], np.uint8).reshape(len(cuts), len(x))


@dataclass
class Trees:
    """Trees of a round by model and node: feature (-1 in a leaf), bin and value. Children of node k are 2 k + 1 (up to the bin) and 2 k + 2."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def route(self, model: int, bins: np.ndarray, steps: int) -> np.ndarray:
        """Node of each row (in its bins, by feature and row) of one model's tree."""
        feature, cut = self.feature[model], self.bin[model]
        node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(steps):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[np.maximum(f, 0), rows] > cut[node]), node)
        return node


def best_cuts(sums: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Best split of each node from sums (node, feature, bin, 2) of rows and targets: gain (-1: none), feature, bin, and the sums left and right."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    score = lambda s: s[..., 1] ** 2 / np.maximum(s[..., 0], 1.0)
    ok = (left[..., 0] >= max(1, min_leaf)) & (right[..., 0] >= max(1, min_leaf))
    gain = np.where(ok, score(left) + score(right) - score(total), -1.0)[:, :, :-1]
    flat = gain.reshape(len(sums), -1)
    at, k = flat.argmax(1), np.arange(len(sums))
    f, b = np.divmod(at, gain.shape[2])
    return flat[k, at], f, b, left[k, f, b], right[k, f, b]


def targets(y: np.ndarray, t: np.ndarray, f: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the next trees fit: the negative gradients of the squared error of ``y`` and of the log loss of ``t``; the values themselves at first."""
    sign = 2 * t - 1
    if first:
        return y, sign
    with np.errstate(over="ignore"):
        return 2 * (y - f[0]), 4 * sign / (1 + np.exp(2 * sign * f[1]))


class Boost:
    """The models of all folds: for fold k, models 2 k (outcome) and 2 k + 1 (treatment), fitted on the rows of the other folds."""

    def __init__(self, p: int, folds: int, rounds: int, depth: int, min_leaf: int):
        self.p, self.folds, self.rounds, self.depth, self.min_leaf = p, folds, rounds, depth, min_leaf
        self.width = 2 ** (depth + 1) - 1
        self.cuts: list[list[np.ndarray]] = []
        self.trees: list[Trees] = []

    def place(self, rows: DataFrame, total: int, seed: int) -> None:
        """Where the features are cut, from about BIN_ROWS rows of each fit (all of them where there are fewer)."""
        share = BIN_ROWS * self.folds / max(1, (self.folds - 1) * total)
        some = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
        got = np.array([tuple(r) for r in some.select("_fold", *[f"_x{j}" for j in range(self.p)]).collect()], float).reshape(-1, self.p + 1)
        if not np.isfinite(got).all() and np.isnan(got).any():
            raise DataError("features must not be null")
        for k in range(self.folds):
            own = got[got[:, 0] != k, 1:]
            if not len(own):
                raise DataError(f"no rows to fit the models of fold {k}")
            self.cuts.append([thresholds(own[:, j], min(BINS, len(own))) for j in range(self.p)])

    def parts(self, rows: DataFrame, total: int) -> RDD:
        """The rows as arrays, one element for each part: for each fold the bins, outcome, treatment and predictions so far of the other folds' rows."""
        cores, p, folds, cuts = rows.sparkSession.sparkContext.defaultParallelism, self.p, self.folds, self.cuts
        n = max(1, min(-(-total // 2048), cores * -(-total // (PART_ROWS * cores))))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) for b in batches if b.num_rows]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(got).tobytes() if got else b""], pa.binary())], ["rows"])

        def unpack(row) -> list[tuple]:
            a = np.frombuffer(bytes(row[0])).reshape(-1, p + 3)
            if np.isnan(a).any() or not np.isin(a[:, 2], (0.0, 1.0)).all():
                raise ValueError("features and the outcome must not be null, and the treatment must be 0 or 1")
            out = []
            for k in range(folds):
                own = a[a[:, 0] != k]
                out.append((bins_of(own[:, 3:], cuts[k]), own[:, 1].copy(), own[:, 2].copy(), np.zeros((2, len(own)))))
            return out

        flat = rows.select(F.col("_fold").cast("double"), "_y", "_t", *[f"_x{j}" for j in range(p)]).repartition(n)
        return flat.mapInArrow(pack, "rows binary").rdd.map(unpack)

    def step(self, trees: Trees, active: list[tuple[int, int]], level: int, first: bool):
        """Kernel: (model, sums by node, feature and bin) of the rows of a part in the given nodes of one level."""
        p, place = self.p, np.full((2 * self.folds, self.width), -1)
        count = np.zeros(2 * self.folds, int)
        for m, k in active:
            place[m, k] = count[m]
            count[m] += 1

        def run(part: list[tuple]) -> Iterator[tuple[int, np.ndarray]]:
            for fold, (bins, y, t, f) in enumerate(part):
                for m, target in zip((2 * fold, 2 * fold + 1), targets(y, t, f, first)):
                    if not count[m] or not len(y):
                        continue
                    slot = place[m, trees.route(m, bins, level)]
                    in_use = slot >= 0
                    some, goal, at = (bins, target, slot) if in_use.all() else (bins[:, in_use], target[in_use], slot[in_use])
                    acc = np.empty((count[m], p, BINS, 2))
                    for j in range(p):
                        cell = at * BINS + some[j]
                        acc[:, j, :, 0] = np.bincount(cell, minlength=count[m] * BINS).reshape(-1, BINS)
                        acc[:, j, :, 1] = np.bincount(cell, goal, count[m] * BINS).reshape(-1, BINS)
                    yield m, acc

        return run, int(count.sum()) * p * BINS * 16

    def advance(self, trees: Trees, weight: float):
        """Kernel: a part with the predictions moved by a round's trees."""
        depth = self.depth

        def run(part: list[tuple]) -> list[tuple]:
            return [(bins, y, t, f + weight * np.array([trees.value[2 * fold + c][trees.route(2 * fold + c, bins, depth)] for c in (0, 1)]).reshape(2, -1)) for fold, (bins, y, t, f) in enumerate(part)]

        return run

    def grow(self, state: RDD, first: bool) -> Trees:
        """The trees of a round, level by level."""
        models = 2 * self.folds
        trees = Trees(np.full((models, self.width), -1, np.int64), np.zeros((models, self.width), np.int64), np.zeros((models, self.width)))
        active = [(m, 0) for m in range(models)]
        for level in range(self.depth):
            if not active:
                break
            run, size = self.step(trees, active, level, first)
            given = state.flatMap(run)
            if size * state.getNumPartitions() > DRIVER_BYTES:
                given = given.reduceByKey(np.add)
            sums: dict[int, np.ndarray] = {}
            for m, acc in given.collect():
                sums[m] = sums[m] + acc if m in sums else acc
            todo, active = active, []
            for m, acc in sums.items():
                nodes = [k for of, k in todo if of == m]
                if not level:
                    whole = acc[0, 0].sum(0)
                    trees.value[m, 0] = whole[1] / whole[0]
                for k, gain, f, b, left, right in zip(nodes, *best_cuts(acc, self.min_leaf)):
                    if gain <= 0:
                        continue
                    trees.feature[m, k], trees.bin[m, k] = f, b
                    for child, s in ((2 * k + 1, left), (2 * k + 2, right)):
                        trees.value[m, child] = s[1] / s[0]
                        if s[0] >= 2 * self.min_leaf:
                            active.append((m, child))
        return trees

    def fit(self, rows: DataFrame, total: int, seed: int) -> None:
        """``rows``: _fold, _h (a hash of the row), _y, _t and the features _x0, _x1 ..."""
        checkpoint_folder(rows.sparkSession)
        self.place(rows, total, seed)
        state = self.parts(rows, total).persist(StorageLevel.MEMORY_AND_DISK)
        held = [state]
        try:
            for i in range(self.rounds):
                if i:
                    state = state.map(self.advance(self.trees[-1], RATE if i > 1 else 1.0)).persist(StorageLevel.MEMORY_AND_DISK)
                    held.append(state)
                    if i % CUT == 0:
                        state.checkpoint()
                self.trees.append(self.grow(state, not i))
                while len(held) > 1:  # the new predictions are there
                    held.pop(0).unpersist()
        finally:
            for x in held:
                x.unpersist()

    def predicted(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """The columns ``keep`` of ``rows``, and of each row's outcome and treatment what the models of its fold leave: ``ry`` and ``rt``."""
        p, folds, depth, kinds = self.p, self.folds, self.depth, dict(rows.dtypes)
        shared = rows.sparkSession.sparkContext.broadcast((self.cuts, self.trees))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, grown = shared.value
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    col = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                    fold, x = col("_fold"), np.column_stack([col(f"_x{j}") for j in range(p)])
                    f = np.zeros((2, len(x)))
                    for k in range(folds):
                        own = np.flatnonzero(fold == k)
                        if not len(own):
                            continue
                        bins = bins_of(x[own], cuts[k])
                        for i, one in enumerate(grown):
                            for c in (0, 1):
                                f[c, own] += (RATE if i else 1.0) * one.value[2 * k + c][one.route(2 * k + c, bins, depth)]
                    with np.errstate(over="ignore"):
                        rest = col("_y") - f[0], col("_t") - 1 / (1 + np.exp(-2 * f[1]))
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *map(pa.array, rest)], [*keep, "ry", "rt"])

        needed = rows.select(*keep, "_fold", "_y", "_t", *[f"_x{j}" for j in range(p)])
        return needed.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", ry double, rt double")
