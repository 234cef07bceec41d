"""Cox proportional hazards at any number of distinct times.

The time axis is cut into ranges of about equal row counts; a heavy single time is a range of its own, cut further by a hash of
the covariates. An iteration takes two passes: totals per range, whose suffix sums are the risk sets after each
range, and then, range by range, the risk sets of every time inside it. The driver sees one vector for each range and never a
time. Ties enter by Efron's formula, whose sums over tied events are differences of log-gamma, digamma and trigamma
functions: the work per time does not grow with its events.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.errors import DataError
from tenura.functions.ordered import range_edges
from tenura.functions.stats import normal_quantile, p_of_z
from tenura.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Rows of a range of times that one task holds, about, and the least number of ranges.
RANGE_ROWS, LEAST_RANGES = 250_000, 16
#: Parts of the rows of one heavy time.
SLICES = 16
#: Terms of a sum over ties that are added one by one before its expansion takes over.
HEAD = 32
#: Ranges of the cumulative hazard in which median times are looked up.
HAZARD_RANGES = 256


@dataclass
class CoxModel:
    """Coefficients of centred covariates, and ``baseline``: one row per event time with duration, events, at_risk (the risk sum),
    hazard (cumulative, Breslow, for a member at ``center``) and means (of the risk set, by Efron's formula)."""

    features: list[str]
    coef: np.ndarray
    center: np.ndarray
    baseline: DataFrame
    covariance: np.ndarray | None = None
    log_likelihood: float = math.nan
    n: int = 0
    iterations: int = 0
    trend: dict | None = None

    @property
    def aic(self) -> float:
        return 2 * len(self.features) - 2 * self.log_likelihood

    def log_hazard(self) -> Column:
        terms = [F.lit(float(b)) * (F.col(f).cast("double") - F.lit(float(c))) for f, b, c in zip(self.features, self.coef, self.center)]
        return sum(terms[1:], terms[0])

    def baseline_at(self, times: Sequence[float]) -> list[float]:
        """Baseline survival at the given times (a step function), by one aggregation."""
        row = self.baseline.agg(*[F.max(F.when(F.col("duration") <= float(t), F.col("hazard"))).alias(f"h{i}") for i, t in enumerate(times)]).first()
        return [1.0 if h is None else math.exp(-h) for h in row]


def tie_sums(d: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over l = 0 .. d - 1 of log(a - l), 1 / (a - l) and 1 / (a - l)^2, for a >= d, in time that does not grow with d.

    They are differences of log-gamma, digamma and trigamma at a + 1 and a - d + 1. The HEAD smallest arguments are added
    as they are; beyond them the asymptotic series of the difference is exact to rounding, and it is written
    with log1p so that nothing cancels when a is much larger than d.
    """
    d = np.asarray(d, np.int64)
    c = np.maximum(a - d + 1.0, 1.0)
    s, q1, q2 = (np.zeros(len(d)) for _ in range(3))
    for j in range(min(HEAD, int(d.max(initial=0)))):
        t = np.where(j < d, c + j, np.inf)
        s += np.log(np.where(j < d, t, 1.0))
        q1 += 1 / t
        q2 += 1 / t**2
    long = d > HEAD
    if long.any():
        m = (d[long] - HEAD).astype(float)
        c = c[long] + HEAD
        e = c + m
        u = np.log1p(m / c)
        s[long] += m * np.log(c) + (e - 0.5) * u - m + (1 / e - 1 / c) / 12 - (e**-3 - c**-3) / 360 + (e**-5 - c**-5) / 1260
        q1[long] += u + m / (2 * c * e) + (c**-2 - e**-2) / 12 - (c**-4 - e**-4) / 120 + (c**-6 - e**-6) / 252
        q2[long] += m / (c * e) + (c**-2 - e**-2) / 2 + (c**-3 - e**-3) / 6 - (c**-5 - e**-5) / 30 + (c**-7 - e**-7) / 42
    return s, q1, q2


@dataclass
class TimeSums:
    """Per time: events d, sums of covariates s1 over events, and sums of w, w x, w x x' over events (e) and the risk set (r)."""

    d: np.ndarray
    s1: np.ndarray
    e0: np.ndarray
    e1: np.ndarray
    e2: np.ndarray
    r0: np.ndarray
    r1: np.ndarray
    r2: np.ndarray


def efron(t: TimeSums, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information summed over times with events, and the mean covariates of each of their risk sets."""
    d = t.d
    if not len(d):
        p = len(beta)
        return 0.0, np.zeros(p), np.zeros((p, p)), np.zeros((0, p))
    a = t.r0 * d / t.e0
    s, q1, q2 = tie_sums(d, a)
    # phi_l = r0 - (l / d) e0 = (e0 / d)(a - l); sums over l of log phi, 1/phi, f/phi, 1/phi^2, f/phi^2, f^2/phi^2 with f = l / d
    log_phi = s + d * np.log(t.e0 / d)
    one, f1 = q1 * d / t.e0, (a * q1 - d) / t.e0
    w0, w1, w2 = q2 * (d / t.e0) ** 2, (a * q2 - q1) * d / t.e0**2, (a * a * q2 - 2 * a * q1 + d) / t.e0**2
    total = t.r1 * one[:, None] - t.e1 * f1[:, None]
    ll = float((t.s1 @ beta).sum() - log_phi.sum())
    info = np.einsum("t,tij->ij", one, t.r2) - np.einsum("t,tij->ij", f1, t.e2)
    cross = np.einsum("t,ti,tj->ij", w1, t.r1, t.e1)
    info -= np.einsum("t,ti,tj->ij", w0, t.r1, t.r1) - cross - cross.T + np.einsum("t,ti,tj->ij", w2, t.e1, t.e1)
    return ll, (t.s1 - total).sum(0), info, total / d[:, None]


def trend_sums(t: TimeSums, means: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of d * rank, d * rank^2, rank * residual and residual, where ``before`` events come before each time."""
    rank = before + (t.d + 1) / 2
    resid = t.s1 - t.d[:, None] * means
    return np.concatenate([[(t.d * rank).sum(), (t.d * rank * rank).sum()], rank @ resid, resid.sum(0)])


def _columns(table: pa.Table, p: int, beta: np.ndarray, center: np.ndarray):
    x = np.column_stack([table.column(f"x{i}").to_numpy() for i in range(p)]) - center
    k, e = table.column("k").to_numpy().astype(float), table.column("event").to_numpy()
    return table.column("duration").to_numpy(), k, e, x, k * np.exp(x @ beta)


def _cut(v: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    return v[0], v[1 : p + 1], v[p + 1 : p + 1 + p * p].reshape(p, p)


def _weighted(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).ravel()])


class Passes:
    """The rows of a fit, laid out by range of time, and the two passes over them."""

    def __init__(self, frame: DataFrame, features: Sequence[str], ranges: int | None = None):
        self.features, self.p = list(features), len(features)
        x = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
        rows = frame.select(F.col("duration").cast("double").alias("duration"), F.col("event").cast("int").alias("event"), *x).dropna()
        # members that are alike are one row with their number
        self.counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("k")).persist()
        xs = [f"x{i}" for i in range(self.p)]
        row = self.counted.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(F.col("k") * F.col("event")).alias("d"), *[(F.sum(F.col("k") * F.col(c)) / F.sum("k")).alias(c) for c in xs]).first()
        if not row["n"]:
            self.close()
            raise DataError("no rows to fit")
        self.n, self.events, self.center = int(row["n"]), int(row["d"]), np.array([row[c] for c in xs])
        edges = range_edges(self.counted, "duration", ranges or max(LEAST_RANGES, -(-row["rows"] // RANGE_ROWS)))
        i = F.lit(0)
        cut = self.counted
        if edges:
            cut = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="duration", outputCol="_i").transform(cut)
            i = F.col("_i").cast("int")
        single = F.coalesce(F.get(F.lit(edges or [0.0]), i - 1) == F.col("duration"), F.lit(False))
        cut = cut.withColumns({"range": 2 * i + F.when(single, 0).otherwise(1), "slice": F.when(single, F.pmod(F.xxhash64(*xs), F.lit(SLICES))).otherwise(0)}).drop("_i")
        self.rows = cut.repartition("range", "slice").persist()

    def close(self) -> None:
        for df in (getattr(self, "rows", None), self.counted):
            if df is not None:
                df.unpersist()

    def totals(self, beta: np.ndarray) -> dict[int, np.ndarray]:
        """First pass: for each range, sums over all its rows and over its events, the events and their covariates."""
        p, center = self.p, self.center

        def run(key: tuple, table: pa.Table) -> pa.Table:
            _, k, e, x, w = _columns(table, p, beta, center)
            hit = e == 1
            v = np.concatenate([_weighted(w, x), _weighted(w[hit], x[hit]), [k[hit].sum()], k[hit] @ x[hit]])
            return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})

        out: dict[int, np.ndarray] = {}
        for r in self.rows.groupBy("range", "slice").applyInArrow(run, "range int, v binary").toLocalIterator():  # one short row per range and slice
            out[r["range"]] = out.get(r["range"], 0) + np.frombuffer(r["v"])
        return out

    def around(self, totals: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
        """For each range: sums over the rows of all later ranges, and the events of all earlier ones."""
        size, out, later = 1 + self.p + self.p**2, {}, np.zeros(1 + self.p + self.p**2)
        for r in sorted(totals, reverse=True):
            out[r] = later
            later = later + totals[r][:size]
        before = 0.0
        for r in sorted(totals):
            out[r] = (out[r], before)
            before += totals[r][2 * size]
        return out

    def single(self, totals: dict[int, np.ndarray], around: dict) -> list[tuple[int, TimeSums]]:
        """The ranges of one time each, whose totals are all there is to know."""
        p, size, out = self.p, 1 + self.p + self.p**2, []
        for r, v in totals.items():
            if r % 2 == 0 and v[2 * size] > 0:
                risk, own = _cut(v[:size] + around[r][0], p), _cut(v[size : 2 * size], p)
                one = lambda y: np.array([y])
                out.append((r, TimeSums(one(v[2 * size]), one(v[2 * size + 1 :]), *map(one, own), *map(one, risk))))
        return out

    def _times(self):
        """Kernel: the sums of each time of an odd range, given what lies after and before it."""
        p, center = self.p, self.center

        def sums(table: pa.Table, beta: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, TimeSums, np.ndarray]:
            t, k, e, x, w = _columns(table.sort_by("duration"), p, beta, center)
            at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            per = lambda v: np.add.reduceat(v, at, axis=0)
            r0, r1, r2 = _cut(later, p)
            after = lambda v, rest: np.cumsum(v[::-1], axis=0)[::-1] + rest
            wx, hit = x * w[:, None], (e == 1).astype(float)
            d = per(k * hit)
            some = d > 0
            square = lambda y: per(y[:, :, None] * x[:, None, :])
            return t[at][some], TimeSums(
                d[some], per(x * (k * hit)[:, None])[some], per(w * hit)[some], per(wx * hit[:, None])[some], square(wx * hit[:, None])[some],
                after(per(w), r0)[some], after(per(wx), r1)[some], after(square(wx), r2)[some],
            ), (np.cumsum(d) - d)[some]

        return sums

    def terms(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient, information and the sums for the trend of the residuals."""
        p, totals = self.p, self.totals(beta)
        around = self.around(totals)
        known, sums = self.rows.sparkSession.sparkContext.broadcast(around), self._times()  # one vector per range

        def run(key: tuple, table: pa.Table) -> pa.Table:
            later, before = known.value[key[0].as_py()]
            _, t, first = sums(table, beta, later)
            ll, grad, info, means = efron(t, beta)
            v = np.concatenate([[ll], grad, info.ravel(), trend_sums(t, means, before + first)])
            return pa.table({"v": pa.array([v.tobytes()], pa.binary())})

        out = np.zeros(1 + p + p * p + 2 + 2 * p)
        for r in self.rows.filter("range % 2 = 1").groupBy("range", "slice").applyInArrow(run, "v binary").toLocalIterator():
            out += np.frombuffer(r["v"])
        for r, t in self.single(totals, around):
            ll, grad, info, means = efron(t, beta)
            out += np.concatenate([[ll], grad, info.ravel(), trend_sums(t, means, np.array([around[r][1]]))])
        known.unpersist()
        return out[0], out[1 : p + 1], out[p + 1 : p + 1 + p * p].reshape(p, p), out[p + 1 + p * p :]

    def baseline(self, beta: np.ndarray) -> DataFrame:
        """duration, events, at_risk, hazard (cumulative) and means of each event time, as a table of its own."""
        spark, totals = self.rows.sparkSession, self.totals(beta)
        around, kind = self.around(totals), "range int, duration double, events bigint, at_risk double, inner double, means array<double>"
        known, sums = spark.sparkContext.broadcast(around), self._times()

        def run(key: tuple, table: pa.Table) -> pa.Table:
            r = key[0].as_py()
            times, t, _ = sums(table, beta, known.value[r][0])
            means = efron(t, beta)[3]
            return pa.table({"range": pa.array(np.full(len(times), r), pa.int32()), "duration": times, "events": t.d.astype(np.int64), "at_risk": t.r0, "inner": np.cumsum(t.d / t.r0), "means": pa.array(list(means), pa.list_(pa.float64()))})

        many = self.rows.filter("range % 2 = 1").groupBy("range", "slice").applyInArrow(run, kind)
        heavy = {r: t for r, t in self.single(totals, around)}
        at = self.rows.filter("range % 2 = 0").groupBy("range").agg(F.first("duration").alias("duration"))
        rows = [(r, int(t.d[0]), float(t.r0[0]), float(t.d[0] / t.r0[0]), efron(t, beta)[3][0].tolist()) for r, t in heavy.items()]
        one = spark.createDataFrame(rows, "range int, events bigint, at_risk double, inner double, means array<double>").join(at, "range")
        table = checkpointed(many.unionByName(one.select(*many.columns)))
        ends = sorted((r["range"], r["h"]) for r in table.groupBy("range").agg(F.max("inner").alias("h")).collect())  # one number per range
        before = np.concatenate(([0.0], np.cumsum([h for _, h in ends])))[:-1]
        offsets = spark.createDataFrame([(r, float(b)) for (r, _), b in zip(ends, before)], "range int, offset double")
        return table.join(offsets, "range").select("duration", "events", "at_risk", (F.col("offset") + F.col("inner")).alias("hazard"), "means")


def cox_with_coefficients(frame: DataFrame, features: Sequence[str], coef: Sequence[float]) -> CoxModel:
    """A model with given coefficients; only the Breslow baseline is estimated."""
    beta, passes = np.asarray(coef, dtype=float), Passes(frame, features)
    try:
        return CoxModel(list(features), beta, passes.center, passes.baseline(beta), n=passes.n)
    finally:
        passes.close()


def fit_cox(frame: DataFrame, features: Sequence[str], penalizer: float = 0.01, max_iter: int = 50, tol: float = 1e-8, ranges: int | None = None) -> CoxModel:
    """Cox proportional hazards by Newton's method with Efron ties and a Breslow baseline.

    The L2 penalty is ``n * penalizer / 2 * |coef|^2`` on the columns as given, so standardise them first. Rows with a null
    are left out. Durations count as given, however many there are; ``ranges`` only sets how the work is cut.
    """
    p = len(features)
    passes = Passes(frame, features, ranges)
    try:
        if not passes.events:
            raise DataError("no events in the data")
        n, beta = passes.n, np.zeros(p)
        score = lambda l, b: l - 0.5 * n * penalizer * float(b @ b)
        ll, grad, info, trend = passes.terms(beta)
        for done in range(1, max_iter + 1):
            step = np.linalg.solve(info + n * penalizer * np.eye(p), grad - n * penalizer * beta)
            for _ in range(12):
                new = beta + step
                trial = passes.terms(new)
                if math.isfinite(trial[0]) and score(trial[0], new) >= score(ll, beta) - 1e-9 * abs(ll):
                    break
                step = step / 2
            else:
                raise DataError("the Cox fit did not improve; check for collinear or constant covariates")
            beta, (ll, grad, info, trend) = new, trial
            if np.max(np.abs(step)) < tol:
                break
        else:
            raise DataError(f"the Cox fit did not converge in {max_iter} iterations")
        cov = np.linalg.inv(info + n * penalizer * np.eye(p))
        stats = dict(events=passes.events, rank=trend[0], square=trend[1], rank_resid=trend[2 : p + 2], resid=trend[p + 2 :])
        return CoxModel(list(features), beta, passes.center, passes.baseline(beta), cov, float(ll), n, done, stats)
    finally:
        passes.close()


def cox_summary(spark, model: CoxModel, alpha: float = 0.05) -> DataFrame:
    z = normal_quantile(1 - alpha / 2)
    se = np.sqrt(np.diag(model.covariance))
    rows = [(f, float(b), float(math.exp(b)), float(s), float(b / s), p_of_z(b / s), float(b - z * s), float(b + z * s), float(model.log_likelihood), float(model.aic)) for f, b, s in zip(model.features, model.coef, se)]
    return spark.createDataFrame(rows, "covariate string, coef double, hazard_ratio double, se double, z double, p double, ci_lower double, ci_upper double, log_likelihood double, partial_aic double")


def predict_survival(model: CoxModel, df: DataFrame, times: Sequence[float], out: str = "survival") -> DataFrame:
    """Add the survival probabilities at ``times`` as an array; no shuffle."""
    base = F.lit(model.baseline_at(times))
    return df.withColumn("_hr", F.exp(model.log_hazard())).withColumn(out, F.transform(base, lambda s: F.pow(s, F.col("_hr")))).drop("_hr")


def predict_median(model: CoxModel, df: DataFrame, cap: float = 120.0, out: str = "median_survival") -> DataFrame:
    """First event time with survival at most one half, at most ``cap``; null where a covariate is null.

    A row needs the first time whose cumulative hazard reaches log 2 over its own relative hazard. Distinct needs and the steps of the
    hazard meet in ranges of the hazard, each ordered by itself; beyond the last step of a range the first of the next one counts.
    """
    steps = model.baseline.where(F.col("duration") <= cap).select(F.col("hazard").alias("h"), "duration").persist()
    try:
        edges = range_edges(steps, "h", HAZARD_RANGES)

        def ranged(rows: DataFrame) -> DataFrame:
            if not edges:
                return rows.withColumn("_r", F.lit(0))
            return Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="h", outputCol="_r", handleInvalid="keep").transform(rows).withColumn("_r", F.col("_r").cast("int"))

        steps = checkpointed(ranged(steps))
    finally:
        steps.unpersist()
    first = {r["_r"]: r["t"] for r in steps.groupBy("_r").agg(F.min("duration").alias("t")).collect()}  # one number per range
    after, best = [float(cap)] * (len(edges) + 1), float(cap)
    for r in range(len(edges), -1, -1):
        after[r] = best
        best = min(best, first.get(r, best))
    rows = df.withColumn("_need", F.lit(math.log(2.0)) / F.exp(model.log_hazard()))
    needs = ranged(rows.select(F.col("_need").alias("h")).where(F.col("h").isNotNull()).distinct()).withColumn("duration", F.lit(None).cast("double"))
    down = Window.partitionBy("_r").orderBy(F.desc("h"), F.col("duration").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = needs.unionByName(steps.select(*needs.columns)).withColumn("_t", F.min("duration").over(down)).where("duration IS NULL")
    found = met.select(F.col("h").alias("_need"), F.least(F.coalesce("_t", F.get(F.lit(after), F.col("_r"))), F.lit(float(cap))).alias("_found"))
    return rows.join(found, "_need", "left").withColumn(out, F.col("_found")).drop("_need", "_found")


def schoenfeld_residuals(model: CoxModel, frame: DataFrame) -> DataFrame:
    """Covariates of each churned member minus the risk-set mean at that time."""
    means = model.baseline.select(F.col("duration").alias("_at"), "means")
    events = frame.filter("event = 1").dropna(subset=model.features)
    out = [(F.col(f).cast("double") - F.lit(float(c)) - F.col("means")[i]).alias(f"resid_{f}") for i, (f, c) in enumerate(zip(model.features, model.center))]
    keep = [c for c in ("member_id",) if c in frame.columns]
    return events.join(means, F.col("duration").cast("double") == F.col("_at")).select(*keep, "duration", *out)


def proportional_hazards_test(spark, model: CoxModel) -> DataFrame:
    """Score test of each covariate's scaled residuals against the rank of time, from sums of the fit's last pass."""
    t, v = model.trend, model.covariance
    mean = t["rank"] / t["events"]
    u, spread = t["rank_resid"] - mean * t["resid"], t["square"] - t["events"] * mean * mean
    rows = []
    for j, f in enumerate(model.features):
        stat = float((t["events"] * (v @ u)[j]) ** 2 / (t["events"] * v[j, j] * spread)) if spread > 0 else 0.0
        rows.append((f, stat, p_of_z(math.sqrt(stat)), bool(p_of_z(math.sqrt(stat)) < 0.05)))
    return spark.createDataFrame(rows, "covariate string, test_statistic double, p_value double, violated boolean")
