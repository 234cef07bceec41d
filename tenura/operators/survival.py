"""Kaplan-Meier curves, log-rank tests, concordance and accelerated-failure-time models; the Cox model is in ``cox``.

Durations count as they are given, however many distinct ones there are. Members first collapse to sums per distinct time; running
totals over these come from ranges of time, so that no task holds all times of a stratum.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.errors import DataError
from tenura.functions import as_ts, days_between, round_dec, safe_div
from tenura.functions.ordered import prefix_sums, range_edges
from tenura.functions.stats import chi2_1_p, normal_quantile
from tenura.operators.cox import (  # noqa: F401
    CoxModel, cox_summary, cox_with_coefficients, fit_cox, predict_median, predict_survival, proportional_hazards_test, schoenfeld_residuals,
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def survival_frame(members: DataFrame, ref, month_days: float = 30.44) -> DataFrame:
    """Add ``event`` and ``duration`` (months to cancel or to ``ref``); rows without duration drop out."""
    days = days_between(F.coalesce("cancel_date", as_ts(ref)), F.col("join_date"))
    return members.withColumns({
        "event": F.col("cancel_date").isNotNull().cast("bigint"),
        "duration": round_dec(days / F.lit(month_days), 1)}).filter("duration > 0")


def time_table(frame: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Events, censored and at-risk counts per distinct time (and stratum)."""
    counts = frame.groupBy(*strata, "duration").agg(F.sum("event").alias("events"), F.count("*").alias("_n"))
    at = prefix_sums(counts, F.col("duration"), ["_n"], strata)
    return at.select(*strata, "duration", "events", (F.col("_n") - F.col("events")).alias("censored"), (F.col("total__n") - F.col("cum__n") + F.col("_n")).alias("at_risk"))


def kaplan_meier(frame: DataFrame, strata: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Survival curve per stratum with its log-log confidence band.

    Products over earlier times are sums of logarithms, added up range of times by range of times.
    """
    d, n = F.col("events"), F.col("at_risk")
    terms = time_table(frame, strata).withColumns({
        "l": F.when(d < n, F.ln(1 - d / n)).otherwise(0.0), "v": F.when(d < n, d / (n * (n - d))).otherwise(0.0), "dead": (d == n).cast("int")})
    out = prefix_sums(terms, F.col("duration"), ["l", "v", "dead"], strata)
    log_s, var, dead = F.col("cum_l"), F.col("cum_v"), F.col("cum_dead") > 0
    s = F.when(dead, 0.0).otherwise(F.exp(log_s))
    z = normal_quantile(1 - alpha / 2)
    band = lambda sign: F.when(dead, 0.0).when(log_s == 0, 1.0).otherwise(
        F.exp(-F.exp(F.ln(-log_s) + F.lit(sign * z) * F.sqrt(var) / log_s)))
    return out.select(*strata, "duration", "at_risk", "events", "censored", round_dec(s, 6).alias("survival"),
                      round_dec(band(-1.0), 6).alias("ci_lower"), round_dec(band(1.0), 6).alias("ci_upper"))


def median_survival(curves: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """First time with survival at most one half (infinite if never), with its confidence limits."""
    first = lambda c: F.coalesce(F.min(F.when(F.col(c) <= 0.5, F.col("duration"))), F.lit(float("inf")))
    aggs = [first("survival").alias("median"), first("ci_lower").alias("median_lower"), first("ci_upper").alias("median_upper")]
    return curves.groupBy(*strata).agg(*aggs) if strata else curves.agg(*aggs)


def log_rank(frame: DataFrame, in_a: Column) -> DataFrame:
    """Log-rank test of the rows where ``in_a`` holds against all others."""
    counts = frame.groupBy("duration").agg(
        F.sum("event").alias("d"), F.count("*").alias("c"),
        F.sum(F.when(in_a, F.col("event")).otherwise(0)).alias("d1"), F.count_if(in_a).alias("c1"))
    at = prefix_sums(counts, F.col("duration"), ["c", "c1"])
    later = lambda c: (F.col(f"total_{c}") - F.col(f"cum_{c}") + F.col(c)).cast("double")
    t = at.select("d", "d1", later("c").alias("n"), later("c1").alias("n1"))
    n, n1, d = F.col("n"), F.col("n1"), F.col("d")
    var = F.when(n > 1, n1 * (n - n1) * d * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    one = t.agg(F.sum("d1").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(var).alias("v"))
    x = F.try_divide(F.pow(F.col("observed") - F.col("expected"), 2), F.col("v"))
    tested = one.withColumn("_x", x).withColumn("_p", chi2_1_p(F.col("_x")))
    return tested.select("observed", round_dec(F.col("expected"), 6).alias("expected"),
                         round_dec(F.col("_x"), 6).alias("test_statistic"), round_dec(F.col("_p"), 6).alias("p_value"))


# ---- concordance -----------------------------------------------------------------------------


def _dominated(time: np.ndarray, risk: np.ndarray, n: np.ndarray, d: np.ndarray) -> float:
    """Sum over rows of d times the n of all rows with a later time and a lower risk.

    Two ranks differ first at one bit; for each bit, rows that agree above it are laid out latest first, and a
    running total of those without the bit is read at the rows with it.
    """
    order = np.argsort(-time, kind="stable")
    time, n, d = time[order], n[order].astype(float), d[order].astype(float)
    rank = np.unique(risk[order], return_inverse=True)[1].astype(np.int64)
    total = 0.0
    for bit in range(int(rank.max()).bit_length() if len(rank) else 0):
        by = np.argsort(rank >> (bit + 1), kind="stable")
        group, t, high = rank[by] >> (bit + 1), time[by], (rank[by] >> bit) & 1
        run = np.concatenate(([0.0], np.cumsum(np.where(high == 0, n[by], 0.0))))
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        new_time = new_group | np.concatenate(([True], t[1:] != t[:-1]))
        at = np.arange(len(by))
        before = run[np.maximum.accumulate(np.where(new_time, at, 0))] - run[np.maximum.accumulate(np.where(new_group, at, 0))]
        total += float((np.where(high == 1, d[by], 0.0) * before).sum())
    return total


def _dominated_in(rows: pa.Table) -> pa.Table:
    cols = [rows[c].to_numpy() for c in ("time", "risk", "n", "d")]
    return pa.table({"c": pa.array([_dominated(*cols)], pa.float64())})


def _blocks(df: DataFrame, col: str, ranges: int, out: str) -> DataFrame:
    """Number of the value's range, below 2 * ranges and increasing with the value; an edge is a range of its own, with an even number."""
    edges = range_edges(df, col, ranges)
    if not edges:
        return df.withColumn(out, F.lit(1))
    df = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=col, outputCol=out).transform(df)
    i = F.col(out).cast("int")
    return df.withColumn(out, 2 * i + F.when(F.coalesce(F.get(F.lit(edges), i - 1) == F.col(col), F.lit(False)), 0).otherwise(1))


def concordance(frame: DataFrame, risk: Column, ranges: int | None = None) -> DataFrame:
    """Concordance index, exact for any number of distinct times and risks.

    A pair counts when one member churned and the other was observed longer (or was censored at the same time); equal
    risks count one half, and ``undecided`` is their share. Members collapse to one row per time and risk. Pairs of one
    time, or of one risk, are running totals. The others lie in two ranges of time and two of risk (counted on the grid of
    ranges), or share a range: those are counted inside one task each. The number of ranges follows the square root of the rows, so
    both the ranges and the grid stay small; results do not depend on it. Rows with a null are left out; without
    a pair the index is null.
    """
    spark = frame.sparkSession
    rows = frame.select(F.col("duration").cast("double").alias("time"), "event", risk.cast("double").alias("risk")).dropna()
    cells = rows.groupBy("time", "risk").agg(F.count("*").alias("n"), F.sum("event").cast("bigint").alias("d")).persist()
    try:
        k = ranges or 1 + math.isqrt(cells.count()) // 16
        real = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        d, n, free = F.col("d").cast("double"), F.col("n"), F.col("n") - F.col("d")
        by_time = prefix_sums(cells.groupBy("time").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), F.col("time"), ["n"], ranges=k)
        pairs = by_time.agg(real(d * (F.col("total_n") - F.col("cum_n") + free))).first()[0]
        tied = prefix_sums(cells, F.col("time"), ["n"], ["risk"], ranges=k, null_keys=False).agg(
            real(d * (F.col("total_n") - F.col("cum_n") + free))).first()[0]
        good = prefix_sums(cells.withColumn("free", free), F.col("risk"), ["free"], ["time"], ranges=k, null_keys=False).agg(
            real(d * (F.col("cum_free") - F.col("free")))).first()[0]
        cut = _blocks(_blocks(cells, "time", k, "tb"), "risk", k, "rb")
        # A range of one time or one risk holds no such pair, so only ranges of about equal size reach a task.
        inside = lambda block, value: cut.filter(F.col(block) % 2 == 1).select(
            block, "time", value.cast("double").alias("risk"), "n", "d").groupBy(block).applyInArrow(
            _dominated_in, "c double").agg(real("c")).first()[0]
        good += inside("rb", F.col("risk")) + inside("tb", F.col("rb"))
        # Pairs of one range of risk were counted whole; of the grid only those of other ranges on both axes are left.
        grid = cut.groupBy("tb", "rb").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
        ranged = F.explode(F.sequence(F.lit(0), F.lit(2 * k - 1)))
        full = grid.select("tb").distinct().select("tb", ranged.alias("rb")).join(grid, ["tb", "rb"], "left").fillna(0, ["n", "d"])
        later = Window.partitionBy("rb").orderBy(F.desc("tb")).rowsBetween(Window.unboundedPreceding, -1)
        lower = Window.partitionBy("tb").orderBy("rb").rowsBetween(Window.unboundedPreceding, -1)
        good += full.withColumn("_o", F.coalesce(F.sum("n").over(later), F.lit(0))).withColumn(
            "_c", F.coalesce(F.sum("_o").over(lower), F.lit(0))).agg(real(d * F.col("_c"))).first()[0]
    finally:
        cells.unpersist()
    one = spark.createDataFrame([(good, tied, pairs)], "c double, t double, p double")
    return one.select(round_dec(safe_div(F.col("c") + F.col("t") / 2, F.col("p")), 6).alias("concordance"),
                      F.col("p").cast("bigint").alias("pairs"), round_dec(safe_div(F.col("t"), F.col("p")), 6).alias("undecided"))


# ---- accelerated failure time ----------------------------------------------------------------

AFT_FAMILIES = ("weibull", "log_normal", "log_logistic")


@dataclass
class AftModel:
    family: str
    features: list[str]
    coef: np.ndarray      # intercept first
    log_scale: float
    log_likelihood: float
    n: int

    @property
    def aic(self) -> float:
        return 2 * (len(self.coef) + 1) - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return math.log(self.n) * (len(self.coef) + 1) - 2 * self.log_likelihood

    def location(self) -> Column:
        return sum((F.lit(float(b)) * F.col(f).cast("double") for f, b in zip(self.features, self.coef[1:])), F.lit(float(self.coef[0])))


def _normal_tail(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of the upper normal tail, and the hazard."""
    safe = np.minimum(z, 30.0)
    tail = 0.5 * np.frompyfunc(math.erfc, 1, 1)(safe / math.sqrt(2)).astype(float)
    log_pdf = -0.5 * z * z - 0.5 * math.log(2 * math.pi)
    far = z > 30.0
    zz = np.where(far, z, 1.0)
    log_tail = np.where(far, log_pdf - np.log(zz), np.log(tail))
    return log_tail, np.where(far, z + 1 / zz, np.exp(log_pdf - log_tail))


def _aft_terms(family: str, z: np.ndarray, e: np.ndarray):
    """Log-likelihood of the error, and its first two derivatives, for events and censored rows."""
    if family == "weibull":
        x = np.exp(np.minimum(z, 700.0))
        return e * z - x, e - x, -x
    if family == "log_logistic":
        soft = np.logaddexp(0.0, z)
        p = np.exp(z - soft)
        return e * z - (1 + e) * soft, e - (1 + e) * p, -(1 + e) * p * (1 - p)
    log_tail, h = _normal_tail(z)
    ev = -0.5 * z * z - 0.5 * math.log(2 * math.pi)
    return np.where(e == 1, ev, log_tail), np.where(e == 1, -z, -h), np.where(e == 1, -1.0, -h * (h - z))


def _aft_sums(rows: DataFrame, features: list[str], family: str, beta: np.ndarray, log_scale: float):
    """Likelihood, gradient and Hessian sums: one partial vector per task, summed by position."""
    p, sigma = len(beta), math.exp(log_scale)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(1 + (p + 1) + (p + 1) ** 2)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([np.ones(b.num_rows)] + [b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            y = np.log(b.column("duration").to_numpy(zero_copy_only=False).astype(float))
            e = b.column("event").to_numpy(zero_copy_only=False).astype(float)
            z = (y - x @ beta) / sigma
            ll, a, c = _aft_terms(family, z, e)
            grad = np.append(-(a @ x) / sigma, (-a * z - e).sum())
            hess = np.zeros((p + 1, p + 1))
            hess[:p, :p] = (x * c[:, None]).T @ x / sigma**2
            hess[:p, p] = hess[p, :p] = (c * z + a) @ x / sigma
            hess[p, p] = (c * z * z + a * z).sum()
            acc += np.concatenate([[ll.sum() - (e * (log_scale + y)).sum()], grad, hess.ravel()])
        yield pa.RecordBatch.from_pydict({"v": [acc.tolist()]})

    parts = rows.mapInArrow(partial, "v array<double>").select(F.posexplode("v").alias("i", "x"))
    got = {r["i"]: r["s"] for r in parts.groupBy("i").agg(F.sum("x").alias("s")).collect()}
    v = np.array([got[i] for i in range(1 + (p + 1) + (p + 1) ** 2)])
    return v[0], v[1:p + 2], v[p + 2:].reshape(p + 1, p + 1)


def aft_score(frame: DataFrame, features: Sequence[str], family: str, coef: Sequence[float], log_scale: float) -> DataFrame:
    """One row: family, n, log-likelihood and its derivatives at given coefficients (intercept first) and log scale."""
    if family not in AFT_FAMILIES:
        raise DataError(f"unknown family {family!r}")
    features = list(features)
    rows = frame.select("duration", "event", *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    ll, grad, _ = _aft_sums(rows, features, family, np.asarray(coef, float), float(log_scale))
    names = ["d_intercept", *[f"d_{f}" for f in features], "d_log_scale"]
    return frame.sparkSession.createDataFrame([(family, rows.count(), float(ll), *map(float, grad))], "family string, n bigint, log_likelihood double, " + ", ".join(f"{n} double" for n in names))


def fit_aft(frame: DataFrame, features: Sequence[str], family: str, max_iter: int = 60, tol: float = 1e-7) -> AftModel:
    """Accelerated-failure-time regression by Newton's method; rows stay in the tasks. A fit that does not converge is an error."""
    if family not in AFT_FAMILIES:
        raise DataError(f"unknown family {family!r}")
    features = list(features)
    rows = frame.select("duration", "event", *[F.col(f).cast("double").alias(f) for f in features]).dropna().persist()
    try:
        start = rows.agg(F.count("*").alias("n"), F.avg(F.ln("duration")).alias("m"), F.stddev_pop(F.ln("duration")).alias("s")).first()
        if not start["n"]:
            raise DataError("no rows to fit")
        theta = np.zeros(len(features) + 2)
        theta[0], theta[-1] = start["m"], math.log(max(start["s"], 1e-3))
        ll, grad, hess = _aft_sums(rows, features, family, theta[:-1], theta[-1])
        converged = False
        for _ in range(max_iter):
            h = -hess
            low = np.linalg.eigvalsh(h)[0]
            step = np.linalg.solve(h + (max(0.0, 1e-6 - low) + (abs(low) if low < 0 else 0.0)) * np.eye(len(theta)), grad)
            if low > 0 and abs(grad @ step) <= 1e-10 * max(1.0, abs(ll)):
                converged = True  # what a full step could still gain
                break
            for _ in range(25):
                new = theta + step
                trial = _aft_sums(rows, features, family, new[:-1], new[-1])
                if math.isfinite(trial[0]) and trial[0] >= ll - 1e-9 * abs(ll):
                    break
                step = step / 2
            else:
                break
            theta, (ll, grad, hess) = new, trial
            if np.max(np.abs(step)) < tol:
                converged = True
                break
        if not converged:
            raise DataError(f"the {family} fit did not converge in {max_iter} steps")
    finally:
        rows.unpersist()
    return AftModel(family, features, theta[:-1], float(theta[-1]), float(ll), int(start["n"]))


def compare_models(frame: DataFrame, features: Sequence[str], cox: CoxModel | None = None) -> DataFrame:
    """AIC, BIC, log-likelihood and concordance of the three families and a Cox model."""
    spark, rows = frame.sparkSession, []
    for family in AFT_FAMILIES:
        m = fit_aft(frame, features, family)
        c = concordance(frame.dropna(subset=list(features)), -m.location()).first()["concordance"]
        rows.append((family, m.aic, m.bic, m.log_likelihood, c))
    best = min(rows, key=lambda r: r[1])[0]
    rows = [(*r, r[0] == best) for r in rows]
    if cox is not None:
        c = concordance(frame.dropna(subset=cox.features), cox.log_hazard()).first()["concordance"]
        rows.append(("cox", cox.aic, None, cox.log_likelihood, c, False))
    return spark.createDataFrame(rows, "model string, aic double, bic double, log_likelihood double, concordance double, best_by_aic boolean")
