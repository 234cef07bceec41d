"""Refutation of an estimated effect, each test with the method that made the estimate.

A test asks what the same estimator finds on changed data: treatment permuted, a random covariate added, rows left out, rows drawn
again. Subsets and bootstrap draws are weights per row and replicate that follow from the key alone, so no data are copied and a
retried task draws the same. All replicates of a regression come from one scan; all propensity models take their Newton steps
together, one scan a step; matching handles the replicates as groups of one job.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.config import CausalSpec
from tenura.errors import DataError
from tenura.functions import hash_normal, hash_unit
from tenura.functions.ordered import prefix_sums
from tenura.operators.causal import Effect, _nearest, _ols, centered, check_spec, estimate_ate, gram, linear_ate, replicate_weights, row_hash
from tenura.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

METHODS = ("linear_regression", "propensity_score_weighting", "propensity_score_matching")


# ---- replicated estimators -------------------------------------------------------------------


def linear_effects(rows: DataFrame, key: str, t: str, y: str, x: Sequence[str], replicates: int, kind: str, fraction: float = 0.8, seed: int = 42) -> np.ndarray:
    """Linear-adjustment effects of all replicates, from one scan."""
    cols = list(dict.fromkeys([t, *x, y]))
    g = gram(centered(rows.dropna(subset=cols), cols), cols, key, replicates, kind, fraction, seed)
    return np.array([_ols(m, range(len(cols)), len(cols))[0][1] for m in g])


class Scores:
    """Rows as (hash, t, y, standardised covariates), and one propensity model per replicate."""

    def __init__(self, rows: DataFrame, key: str, t: str, y: str, x: Sequence[str], replicates: int, kind: str, fraction: float, seed: int):
        self.r, self.kind, self.fraction, self.seed = replicates, kind, fraction, seed
        lean = rows.select(row_hash(key).alias("_h"), F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(x)]).dropna()
        names = [f"_{i}" for i in range(len(x))]
        row = lean.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        if not row["n"]:
            raise DataError("no rows to fit")
        scale = lambda c: float(row[f"s{c}"]) or 1.0
        self.m = len(x) + 1
        self.rows = lean.select("_h", "_t", "_y", *[((F.col(c) - F.lit(float(row[f"m{c}"]))) / F.lit(scale(c))).alias(c) for c in names]).persist()

    def close(self) -> None:
        self.rows.unpersist()

    def _batch(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        z = np.column_stack([np.ones(b.num_rows)] + [col(f"_{i}") for i in range(self.m - 1)])
        return z, col("_t"), col("_y"), replicate_weights(col("_h"), self.r, self.kind, self.fraction, self.seed)

    def _sums(self, kernel, width: int) -> np.ndarray:
        """Sums over all rows of what ``kernel`` makes of a batch: an array (replicate, width); one partial array per task."""
        r, batch = self.r, self._batch

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((r, width))
            for b in batches:
                if b.num_rows:
                    acc += kernel(*batch(b))
            yield pa.RecordBatch.from_pydict({"v": [acc.ravel().tolist()]})

        parts = self.rows.mapInArrow(partial, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
        out = np.zeros(r * width)
        for row in parts.collect():  # replicates times the products of the columns
            out[row["i"]] = row["s"]
        return out.reshape(r, width)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}  # tasks get the settings, not the table

    def fit(self, ridge: float = 1e-6, max_iter: int = 40, tol: float = 1e-10) -> np.ndarray:
        """Logistic coefficients (replicate, 1 + covariates): Newton steps of all replicates, each from one scan."""
        m, up = self.m, np.triu_indices(self.m)
        beta = np.zeros((self.r, m))
        penalty = np.eye(m)
        penalty[0, 0] = 0.0
        for _ in range(max_iter):
            now = beta

            def kernel(z, t, _, w):
                p = 1 / (1 + np.exp(-np.clip(z @ now.T, -500, 500)))
                grad = (w * (t[:, None] - p)).T @ z
                hess = (w * p * (1 - p)).T @ (z[:, up[0]] * z[:, up[1]])
                return np.column_stack([w.sum(0), grad, hess])

            s = self._sums(kernel, 1 + m + len(up[0]))
            step = np.zeros_like(beta)
            for k in range(self.r):
                h = np.zeros((m, m))
                h[up] = s[k, 1 + m :]
                h = h + h.T - np.diag(np.diag(h)) + s[k, 0] * ridge * penalty
                if not s[k, 0] or not np.isfinite(h).all():
                    raise DataError("a replicate has no rows")
                step[k] = np.linalg.solve(h + 1e-12 * np.eye(m), s[k, 1 : 1 + m] - s[k, 0] * ridge * penalty @ beta[k])
            beta = beta + np.clip(step, -5.0, 5.0)
            if np.abs(step).max() < tol:
                return beta
        raise DataError(f"the propensity models did not converge in {max_iter} steps")

    def weighted_effects(self, beta: np.ndarray, clip: float = 0.01) -> np.ndarray:
        """Inverse-propensity (Hajek) differences of all replicates, from one scan."""

        def kernel(z, t, y, w):
            p = np.clip(1 / (1 + np.exp(-np.clip(z @ beta.T, -500, 500))), clip, 1 - clip)
            one, two = w * (t == 1)[:, None] / p, w * (t != 1)[:, None] / (1 - p)
            return np.column_stack([one.sum(0), (one * y[:, None]).sum(0), two.sum(0), (two * y[:, None]).sum(0)])

        s = self._sums(kernel, 4)
        if (s[:, [0, 2]] <= 0).any():
            raise DataError("one treatment arm is empty")
        return s[:, 1] / s[:, 0] - s[:, 3] / s[:, 2]

    def matched_effects(self, beta: np.ndarray, ranges: int | None = None) -> np.ndarray:
        """Nearest-neighbour effects of all replicates: rows of a replicate collapse to one per score before anything is ordered."""
        r, batch = self.r, self._batch

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                z, t, y, w = batch(b)
                at = np.zeros((len(z), r))
                for i in range(z.shape[1]):  # a matrix product adds in an order of its own for each batch size, and equal rows must have equal scores
                    at += z[:, [i]] * beta[:, i]
                p = 1 / (1 + np.exp(-np.clip(at, -500, 500)))
                for k in range(r):
                    some = w[:, k] > 0
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), k, np.int32)), pa.array(p[some, k]), pa.array(t[some]), pa.array(y[some]), pa.array(w[some, k])], ["rep", "g", "t", "y", "w"])

        rows = self.rows.mapInArrow(scored, "rep int, g double, t double, y double, w double")
        arms = (("1", F.col("t") == 1), ("0", F.col("t") != 1))
        w, wy = F.col("w"), F.col("w") * F.col("y")
        sums = rows.groupBy("rep", "g").agg(*[F.coalesce(F.sum(F.when(of, v)), F.lit(0.0)).alias(f"{n}{arm}") for arm, of in arms for n, v in (("n", w), ("s", wy))])
        points = sums.select("rep", "g", *[c for arm in "10" for c in (F.col(f"n{arm}"), F.when(F.col(f"n{arm}") > 0, F.col(f"s{arm}") / F.col(f"n{arm}")).alias(f"y{arm}"))]).persist()
        try:
            near = _nearest(points, ranges, ["rep"])
            gain = sum((F.when(F.col(f"n{arm}") > 0, F.lit(sign) * F.col(f"n{arm}") * (F.col(f"y{arm}") - F.col(f"m{other}")["y"])).otherwise(0.0) for arm, other, sign in (("1", "0", 1.0), ("0", "1", -1.0))), F.lit(0.0))
            got = {x["rep"]: x["e"] for x in near.groupBy("rep").agg((F.sum(gain) / F.sum(F.col("n1") + F.col("n0"))).alias("e")).collect()}
        finally:
            points.unpersist()
        if len(got) < r or any(e is None for e in got.values()):
            raise DataError("one treatment arm is empty")
        return np.array([got[k] for k in range(r)])


def replicate_effects(rows: DataFrame, key: str, spec: CausalSpec, method: str, replicates: int, kind: str, fraction: float = 0.8, seed: int = 42, confounders: Sequence[str] | None = None) -> np.ndarray:
    """The effect by ``method`` in each replicate: ``all`` rows, a ``subset`` of ``fraction``, or a ``bootstrap`` with Poisson weights."""
    t, y, x = spec.treatment, spec.outcome, list(confounders or spec.confounders)
    if method == "linear_regression":
        return linear_effects(rows, key, t, y, x, replicates, kind, fraction, seed)
    if method not in METHODS:
        raise DataError(f"unknown method {method!r}")
    scores = Scores(rows, key, t, y, x, replicates, kind, fraction, seed)
    try:
        beta = scores.fit()
        return scores.weighted_effects(beta) if method == "propensity_score_weighting" else scores.matched_effects(beta)
    finally:
        scores.close()


# ---- tests -----------------------------------------------------------------------------------


def permuted(df: DataFrame, key: str, col: str, seed: int = 42) -> DataFrame:
    """The table with one column permuted over all rows: the row at a rank by one hash of the key gets the value of the row at that rank by another.

    Ranks are running counts over ranges of the hash, so no task orders the whole table, and the permutation does not
    depend on how many rows there are or how they are partitioned.
    """
    one = df.withColumn("_one", F.lit(1))
    ranked = lambda rows, s: prefix_sums(rows, hash_unit(key, seed=s), ["_one"], tie=[key]).drop("_one", "total__one").withColumnRenamed("cum__one", "_r")
    left = ranked(one.drop(col), seed + 1)
    right = ranked(one.select(F.col(key), F.col(col), "_one"), seed + 2).drop(key)
    return left.join(right, "_r").drop("_r")


def refute(df: DataFrame, key: str, spec: CausalSpec, method: str = "propensity_score_weighting", placebo_limit: float = 0.01, common_cause_limit: float = 0.1,
           subset_cv_limit: float = 0.3, bootstrap_limit: float = 0.15, subsets: int = 5, replicates: int = 200, seed: int = 42,
           tests: Sequence[str] = ("placebo_treatment", "random_common_cause", "data_subset", "bootstrap")) -> DataFrame:
    """Report rows ``(test_name, passed, original_effect, refuted_effect, p_value, details)`` for the estimate by ``method``.

    The placebo test permutes the treatment, the others keep it. A test that fails to run gives a failed row with the error text.
    """
    check_spec(spec, df)
    if method not in METHODS:
        raise DataError(f"unknown method {method!r}")
    t, y, x = spec.treatment, spec.outcome, list(spec.confounders)
    used = checkpointed(df.select(key, *dict.fromkeys([t, y, *x])).dropna())  # every plan of the report starts here, not at the tables
    e0 = float(replicate_effects(used, key, spec, method, 1, "all", seed=seed)[0])
    change = lambda e: abs(e - e0) / max(abs(e0), 1e-6)

    def placebo():
        moved = checkpointed(permuted(used, key, t, seed))
        e: Effect = linear_ate(moved, t, y, x) if method == "linear_regression" else estimate_ate(moved, spec, method)
        p = None if math.isnan(e.p_value) else e.p_value
        return abs(e.effect) < placebo_limit, e.effect, p, f"placebo effect {e.effect:.4f}, limit {placebo_limit}"

    def common_cause():
        noisy = used.withColumn("_u", hash_normal(key, seed=seed))
        e = float(replicate_effects(noisy, key, spec, method, 1, "all", seed=seed, confounders=[*x, "_u"])[0])
        return change(e) < common_cause_limit, e, None, f"effect change {change(e):.2%} with a random confounder"

    def data_subset():
        es = replicate_effects(used, key, spec, method, subsets, "subset", seed=seed)
        cv = float(es.std() / max(abs(es.mean()), 1e-6))
        return cv < subset_cv_limit, float(es.mean()), None, f"variation {cv:.3f} over {subsets} subsets, limit {subset_cv_limit}"

    def bootstrap():
        es = replicate_effects(used, key, spec, method, replicates, "bootstrap", seed=seed)
        e = float(es.mean())
        return change(e) < bootstrap_limit, e, None, f"effect change {change(e):.2%}, bootstrap deviation {es.std(ddof=1):.4f}"

    known = {"placebo_treatment": placebo, "random_common_cause": common_cause, "data_subset": data_subset, "bootstrap": bootstrap}
    rows = []
    for name in (n for n in tests if n in known):
        try:
            passed, e, p, text = known[name]()
            rows.append((name, bool(passed), e0, float(e), p, text))
        except (DataError, np.linalg.LinAlgError) as error:  # the report must show the failed test; Spark's errors end it
            rows.append((name, False, e0, None, None, f"failed with {type(error).__name__}: {error}"))
    return df.sparkSession.createDataFrame(rows, "test_name string, passed boolean, original_effect double, refuted_effect double, p_value double, details string")
