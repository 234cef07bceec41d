"""Heterogeneous treatment effects: residuals from cross-fitted models, and a forest of honest trees.

All trees grow together, level by level. A scan sums products of residuals per tree, node, feature and bin; the sums of a node meet in
one place, where its split is chosen. Splits maximise what the two sides' effects explain, sum(ty)^2 / sum(tt), so no ratio of residuals is
formed and no row is left out. The rows of a tree are divided by a hash into one half that chooses splits and another that
estimates effects. What the driver holds is the trees' shape, whose size follows from the number of trees and their depth.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.config import CausalSpec
from tenura.errors import DataError
from tenura.functions.ordered import count_percentiles
from tenura.operators.boost import PART_ROWS, Boost
from tenura.operators.causal import _uniforms, check_spec, row_hash
from tenura.operators.features import fit_percentiles, impute
from tenura.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Bins per feature, rows a task routes at once, and bytes of sums it keeps at once.
BINS, ROWS, SUMS = 32, 8192, 32 << 20


@dataclass
class Shape:
    """Splits of all trees: feature (-1 in a leaf) and bin, by tree and node. Children of node k are 2 k + 1 (up to the bin) and 2 k + 2."""

    feature: np.ndarray
    bin: np.ndarray

    def route(self, bins: np.ndarray) -> np.ndarray:
        """Node of each row (in its bins) in each tree."""
        trees = np.arange(len(self.feature))
        node = np.zeros((len(bins), len(trees)), np.int64)
        rows = np.arange(len(bins))[:, None]
        while True:
            f = self.feature[trees, node]
            go = f >= 0
            if not go.any():
                return node
            right = bins[rows, np.maximum(f, 0)] > self.bin[trees, node]
            node = np.where(go, 2 * node + 1 + right, node)

    def leaves(self) -> list[tuple[int, int]]:
        out = []
        for t in range(len(self.feature)):
            todo = [0]
            while todo:
                k = todo.pop()
                if self.feature[t, k] < 0:
                    out.append((t, k))
                else:
                    todo += [2 * k + 1, 2 * k + 2]
        return out


@dataclass
class EffectForest:
    shape: Shape
    edges: np.ndarray  # (feature, bin edge); values above an edge lie in a later bin
    features: list[str]
    fills: dict[str, float]  # what stands in for missing values
    leaves: DataFrame  # tree, leaf, effect, variance, node (the leaf, or the ancestor that was estimated in its place)
    gains: np.ndarray  # per feature
    average: float

    def placed(self, df: DataFrame, key: str = "member_id") -> DataFrame:
        """(key, leaf): each row with its leaf in every tree."""
        edges, shape, p = self.edges, self.shape, len(self.features)
        kind = dict(df.dtypes)[key]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    node = shape.route(binned(b, p, edges))
                    yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(list(node.astype(np.int32)), pa.list_(pa.int32()))], [key, "leaf"])

        filled = impute(df, self.fills).select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)])
        return filled.mapInArrow(run, f"{key} {kind}, leaf array<int>")

    def predict(self, df: DataFrame, key: str = "member_id") -> DataFrame:
        """Effect per row with a 95 % interval; every row of ``df`` is returned, rows that repeat a key once.

        The leaf table has a row for each leaf of the shape the driver holds, so tasks have it whole, and a row gives out two sums over its
        trees. Trees share the estimation rows, so the variance of their mean is bounded by the mean of the leaf variances, which is used.
        """
        table = np.full((2, *self.shape.feature.shape), np.nan)
        for r in self.leaves.select("tree", "leaf", "effect", "variance").collect():
            table[:, r["tree"], r["leaf"]] = r["effect"], r["variance"]
        shared, trees, kind = df.sparkSession.sparkContext.broadcast(table), np.arange(len(self.shape.feature)), dict(df.dtypes)[key]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    leaf = b.column("leaf").flatten().to_numpy().reshape(b.num_rows, -1)
                    effect, variance = shared.value[:, trees, leaf]
                    known = ~np.isnan(effect)
                    yield pa.RecordBatch.from_arrays([b.column(key), pa.array(known.sum(1)), *[pa.array(np.where(known, v, 0.0).sum(1)) for v in (effect, variance)]], [key, "n", "effect", "variance"])

        sums = self.placed(df, key).mapInArrow(run, f"`{key}` {kind}, n bigint, effect double, variance double")
        mean = lambda c: F.sum(c) / F.sum("n")
        means = sums.where("n > 0").groupBy(key).agg(mean("effect").alias("cate_mean"), F.sqrt(mean("variance")).alias("cate_std"))
        return means.withColumns({"cate_lower": F.col("cate_mean") - 1.96 * F.col("cate_std"), "cate_upper": F.col("cate_mean") + 1.96 * F.col("cate_std")})

    def importance(self, spark) -> DataFrame:
        total = self.gains.sum() or 1.0
        pairs = sorted(zip(self.features, self.gains / total), key=lambda p: (-p[1], p[0]))
        return spark.createDataFrame([(f, float(v), i + 1) for i, (f, v) in enumerate(pairs)], "feature string, importance double, rank bigint")


# ---- residuals -------------------------------------------------------------------------------


def residuals(df: DataFrame, key: str, treatment: str, outcome: str, features: Sequence[str], folds: int = 5, rounds: int = 100,
              depth: int = 4, min_leaf: int = 20, seed: int = 42) -> DataFrame:
    """Outcome and treatment minus cross-fitted boosted-tree predictions: key, features, ``ry``, ``rt``.

    Folds follow the key's hash, so a row is always predicted by models that never saw it. The models of all folds are grown together, a
    level of all their trees by one scan. Features must not be null; rows without treatment or outcome are left out.
    """
    rows = df.dropna(subset=[treatment, outcome])
    rows = rows.select(key, *features, F.col(outcome).cast("double").alias("_y"), F.col(treatment).cast("double").alias("_t"), row_hash(key).alias("_h"),
                       *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)])
    rows = rows.withColumn("_fold", F.pmod(F.col("_h") + F.lit(seed), F.lit(folds)).cast("int")).persist()
    try:
        models = Boost(len(features), folds, rounds, depth, min_leaf)
        models.fit(rows, rows.count(), seed)
        return checkpointed(models.predicted(rows, [key, *features]))
    finally:
        rows.unpersist()


# ---- growing ---------------------------------------------------------------------------------


def binned(b: pa.RecordBatch, p: int, edges: np.ndarray) -> np.ndarray:
    """Bin of each value (row, feature): how many edges lie below it."""
    return np.column_stack([np.searchsorted(edges[i], b.column(f"x{i}").to_numpy(zero_copy_only=False), side="left") for i in range(p)])


def bin_edges(rows: DataFrame, p: int, bins: int = BINS) -> np.ndarray:
    """(feature, bins - 1): percentiles of each feature; equal ones count once, the rest is infinite."""
    probs = {f"p{k}": k / bins for k in range(1, bins)}
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("_x")) for i in range(p)])))
    found = {r["f"]: r for r in count_percentiles(long.groupBy("f", "_x").agg(F.count("*").alias("n")), probs, ["f"]).collect()}
    out = np.full((p, bins - 1), np.inf)
    for i in range(p):
        cuts = sorted({found[i][c] for c in probs})
        out[i, : len(cuts)] = cuts
    return out


def best_splits(sums: np.ndarray, min_leaf: int) -> tuple[np.ndarray, ...]:
    """Best split of each node from sums (node, feature, bin, 3) of rows, ty and tt: gain, feature, bin, rows left and right (gain -1: none)."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :, -1:, :]
    right = total - left
    score = lambda s: np.where(s[..., 2] > 0, s[..., 1] ** 2 / np.where(s[..., 2] > 0, s[..., 2], 1.0), 0.0)
    gain = score(left) + score(right) - score(total)
    ok = (left[..., 0] >= min_leaf) & (right[..., 0] >= min_leaf) & (left[..., 2] > 0) & (right[..., 2] > 0)
    gain = np.where(ok, gain, -1.0)[:, :, :-1]
    flat = gain.reshape(len(sums), -1)
    at = flat.argmax(1)
    f, b = np.divmod(at, gain.shape[2])
    k = np.arange(len(sums))
    return flat[k, at], f, b, left[k, f, b, 0], right[k, f, b, 0]


class Grower:
    """Rows with their bins, residuals and hash, and the scans over them."""

    def __init__(self, res: DataFrame, key: str, features: Sequence[str], trees: int, fraction: float, honest: bool, seed: int):
        self.p, self.trees, self.fraction, self.honest, self.seed = len(features), trees, fraction, honest, seed
        self.rows = res.select(row_hash(key).alias("h"), "ry", "rt", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).persist()
        self.edges = bin_edges(self.rows, self.p)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # tasks get the settings, not the table

    def halves(self, h: np.ndarray, trees: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rows of a batch choose the splits of each of some trees, and which estimate its effects."""
        u = _uniforms(h, trees + 1, self.seed)
        if not self.honest:
            return u < self.fraction, u < self.fraction
        return u < self.fraction / 2, (u >= self.fraction / 2) & (u < self.fraction)

    def batches(self, batches: Iterator[pa.RecordBatch], trees: np.ndarray) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                col = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                rt, ry = col("rt"), col("ry")
                yield binned(b, self.p, self.edges), rt * ry, rt * rt, self.halves(col("h"), trees)

    def level(self, shape: Shape, nodes: dict[int, list[int]], min_leaf: int) -> list:
        """The best splits of the given nodes (tree: its nodes of one level), for as many trees at once as their sums fit a task."""
        size = self.p * BINS * 3 * 8
        chunks, room = [[]], 0
        for t in sorted(nodes):
            if chunks[-1] and room + len(nodes[t]) * size > SUMS:
                chunks.append([])
                room = 0
            chunks[-1].append(t)
            room += len(nodes[t]) * size
        return [r for chunk in chunks if chunk for r in self._level(shape, {t: nodes[t] for t in chunk}, min_leaf)]

    def _level(self, shape: Shape, nodes: dict[int, list[int]], min_leaf: int) -> list:
        p, batches = self.p, self.batches
        trees = np.array(sorted(nodes))
        slots = [(t, k) for t in trees for k in nodes[t]]
        place = np.full((len(trees), shape.feature.shape[1]), -1)
        for s, (t, k) in enumerate(slots):
            place[np.searchsorted(trees, t), k] = s
        some = Shape(shape.feature[trees], shape.bin[trees])

        def partial(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((p, 3, len(slots) * BINS))
            seen = np.zeros(len(slots), bool)
            for bins, ty, tt, (grow, _) in batches(given, trees):
                slot = place[np.arange(len(trees)), some.route(bins)]
                row, tree = np.nonzero(grow & (slot >= 0))
                s = slot[row, tree]
                seen[s] = True
                for j in range(p):
                    at = s * BINS + bins[row, j]
                    for c, v in enumerate((None, ty, tt)):
                        acc[j, c] += np.bincount(at, None if v is None else v[row], acc.shape[2])
            got = np.flatnonzero(seen)
            if len(got):
                per = acc.reshape(p, 3, len(slots), BINS)
                yield pa.RecordBatch.from_arrays([pa.array(got), pa.array([per[:, :, s].transpose(0, 2, 1).tobytes() for s in got], pa.binary())], ["slot", "sums"])

        def choose(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in given:
                for s, v in zip(b.column("slot").to_pylist(), b.column("sums").to_pylist()):
                    total[s] = total.get(s, 0) + np.frombuffer(v)
            if total:
                found = best_splits(np.array(list(total.values())).reshape(len(total), p, BINS, 3), min_leaf)
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), *[pa.array(x) for x in found]], ["slot", "gain", "feature", "bin", "left", "right"])

        parts = self.rows.mapInArrow(partial, "slot bigint, sums binary").repartition("slot")
        chosen = parts.mapInArrow(choose, "slot bigint, gain double, feature bigint, bin bigint, left double, right double")
        return [(*slots[r["slot"]], r) for r in chosen.where("gain > 0").collect()]  # at most trees times nodes of a level

    def node_sums(self, shape: Shape) -> DataFrame:
        """tree, node (a leaf), and over the rows that estimate: n, tt, ty, and the products that make the variance."""
        batches, width, count = self.batches, shape.feature.shape[1], self.trees

        def partial(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((6, count * width))
            for bins, ty, tt, (_, rest) in batches(given, np.arange(count)):
                row, tree = np.nonzero(rest)
                at = tree * width + shape.route(bins)[row, tree]
                for c, v in enumerate((np.ones(len(ty)), tt, ty, ty * ty, ty * tt, tt * tt)):
                    acc[c] += np.bincount(at, v[row], acc.shape[1])
            got = np.flatnonzero(acc[0])
            yield pa.RecordBatch.from_arrays([pa.array((got // width).astype(np.int32)), pa.array((got % width).astype(np.int32)), *[pa.array(x[got]) for x in acc]], ["tree", "node", *SUM_COLUMNS])

        parts = self.rows.mapInArrow(partial, "tree int, node int, " + ", ".join(f"{c} double" for c in SUM_COLUMNS))
        return parts.groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in SUM_COLUMNS])


SUM_COLUMNS = ("n", "tt", "ty", "yy", "yt", "t4")


def leaf_effects(sums: DataFrame, leaves: DataFrame, min_rows: int) -> DataFrame:
    """tree, leaf, effect, variance, node: the effect of each leaf from the sums of the rows that estimate it.

    A leaf with fewer than ``min_rows`` such rows, or whose treatment residuals are all zero, takes the effect of its nearest ancestor that has
    enough (the root has all rows of its tree). ``sums`` has the rows by leaf; an ancestor's are added up from its leaves'.
    """
    up = "transform(sequence(0, length(bin({0} + 1)) - 1), d -> cast(shiftright({0} + 1, d) - 1 as int))"
    nodes = sums.withColumn("anc", F.explode(F.expr(up.format("node")))).groupBy("tree", "anc").agg(*[F.sum(c).alias(c) for c in SUM_COLUMNS])
    effect = F.col("ty") / F.col("tt")
    var = F.greatest(F.col("yy") - 2 * effect * F.col("yt") + effect * effect * F.col("t4"), F.lit(0.0)) / (F.col("tt") * F.col("tt"))
    good = nodes.where((F.col("tt") > 0) & ((F.col("n") >= min_rows) | (F.col("anc") == 0))).select("tree", "anc", effect.alias("effect"), var.alias("variance"))
    paths = leaves.withColumn("anc", F.explode(F.expr(up.format("leaf"))))
    nearest = paths.join(good, ["tree", "anc"]).groupBy("tree", "leaf").agg(F.max(F.struct(F.col("anc").alias("node"), "effect", "variance")).alias("b"))
    return nearest.select("tree", "leaf", "b.effect", "b.variance", "b.node")


def fit_effect_forest(df: DataFrame, key: str, spec: CausalSpec, features: Sequence[str], trees: int = 200, depth: int = 8,
                      min_leaf: int = 50, folds: int = 5, rounds: int = 100, honest: bool = True, fraction: float = 0.5, seed: int = 42) -> EffectForest:
    """Heterogeneous effects: residualise, grow trees on one half of their rows, estimate the leaves on the other.

    Each tree draws ``fraction`` of the rows. A node splits while both sides keep ``min_leaf`` of the rows that choose, down to
    ``depth``. Leaves need half as many rows that estimate, else their nearest ancestor stands in. Missing features take the
    column's median.
    """
    check_spec(spec, df)
    df = checkpointed(df.select(*dict.fromkeys((key, spec.treatment, spec.outcome, *features))))  # read many times
    fills = {c: 0.0 if v is None else v for c, v in fit_percentiles(df, list(features), 0.5).items()}
    fills = {c: fills.get(c, 0.0) for c in features}
    res = residuals(impute(df, fills), key, spec.treatment, spec.outcome, features, folds, rounds, seed=seed)
    return grow_forest(res, key, features, trees, depth, min_leaf, honest, fraction, seed, fills)


def grow_forest(res: DataFrame, key: str, features: Sequence[str], trees: int = 200, depth: int = 8, min_leaf: int = 50, honest: bool = True,
                fraction: float = 0.5, seed: int = 42, fills: dict[str, float] | None = None) -> EffectForest:
    """The forest from given residuals ``ry`` and ``rt`` beside the key and the features."""
    total = res.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rt") * F.col("ry")).alias("ty"), F.sum(F.col("rt") * F.col("rt")).alias("tt")).first()
    if not total["tt"]:
        raise DataError("the treatment does not vary beyond the confounders")
    width = 2 ** (depth + 1) - 1
    shape = Shape(np.full((trees, width), -1, np.int64), np.zeros((trees, width), np.int64))
    cores = res.sparkSession.sparkContext.defaultParallelism
    grower = Grower(res.coalesce(cores * -(-total["n"] // (PART_ROWS * cores))), key, features, trees, fraction, honest, seed)  # a part gives out sums for every node
    try:
        gains, nodes = np.zeros(len(features)), {t: [0] for t in range(trees)}
        for _ in range(depth):
            found = grower.level(shape, nodes, min_leaf) if nodes else []
            nodes = {}
            for t, k, r in found:
                shape.feature[t, k], shape.bin[t, k] = r["feature"], r["bin"]
                gains[r["feature"]] += r["gain"]
                for child, n in ((2 * k + 1, r["left"]), (2 * k + 2, r["right"])):
                    if n >= 2 * min_leaf:
                        nodes.setdefault(t, []).append(child)
        spark = res.sparkSession
        leaves = spark.createDataFrame(shape.leaves(), "tree int, leaf int")
        table = checkpointed(leaf_effects(grower.node_sums(shape), leaves, max(1, min_leaf // 2)))
    finally:
        grower.rows.unpersist()
    return EffectForest(shape, grower.edges, list(features), dict(fills or {}), table, gains, total["ty"] / total["tt"])
