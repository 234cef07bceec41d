"""Treatment effects: balance, adjusted averages, refutation, per-member effects, segments.

Linear estimators rest on one kernel: tasks reduce their rows to a matrix of sums of products,
and only the summed matrix (columns squared, times replicates) reaches the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.config import TENURE_BINS, TENURE_LABELS, CausalSpec
from tenura.errors import DataError
from tenura.functions import as_ts, days_between, flag, hash_normal, round_dec, safe_div
from tenura.functions.ordered import exact_percentiles, range_edges
from tenura.functions.stats import normal_quantile, p_of_z
from tenura.operators.features import fit_percentiles, right_closed_bin, visits_before_end

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

# ---- specification and data ------------------------------------------------------------------


def check_spec(spec: CausalSpec, df: DataFrame) -> CausalSpec:
    """The spec, or an error listing absent fields and columns."""
    if not spec.treatment or not spec.outcome:
        raise DataError("a causal spec needs a treatment and an outcome")
    if not spec.confounders:
        raise DataError("a causal spec needs at least one confounder")
    missing = [c for c in dict.fromkeys((spec.treatment, spec.outcome, *spec.confounders)) if c not in df.columns]
    if missing:
        raise DataError(f"columns missing for the causal model: {missing}")
    return spec


def for_segment(spec: CausalSpec, df: DataFrame, segment: str, column: str = "contract_source",
                action_col: str = "action_type") -> tuple[CausalSpec, DataFrame]:
    """Rows of one segment without its excluded treatments, and the spec with its extra confounders."""
    rows = df.filter(F.col(column) == segment)
    excluded = spec.excluded_treatments.get(segment, ())
    if excluded and action_col in df.columns:
        rows = rows.filter(~F.coalesce(F.col(action_col).isin(*excluded), F.lit(False)))
    extra = tuple(c for c in spec.segment_confounders.get(segment, ()) if c in df.columns)
    return replace(spec, confounders=tuple(dict.fromkeys((*spec.confounders, *extra)))), rows


def treatment_frame(members: DataFrame, visits: DataFrame, actions: DataFrame, late: DataFrame, ref, tie: str = "action_id") -> DataFrame:
    """One row per member with treatment, outcome, first action, cost and confounders."""
    info = actions.groupBy("member_id").agg(
        F.min_by("action_type", F.struct("action_date", tie)).alias("_a"), F.sum("cost").alias("_c"))
    rates = members.groupBy("location_id").agg(F.avg(flag(F.col("churned"))).alias("location_churn_rate"))
    days = days_between(F.coalesce("cancel_date", as_ts(ref)), F.col("join_date"))
    base = members.withColumns({"tenure_months": F.greatest(days / 30.0, F.lit(0.0)),
                                "enrollment_month": F.month("join_date").cast("bigint"), "plan_price": F.col("monthly_price"),
                                "churned_30d": flag(F.col("churned"))})
    out = (base.join(info, "member_id", "left").join(visits_before_end(members, visits, ref), "member_id", "left")
           .join(late.select("member_id", "payment_delay_flag"), "member_id", "left").join(rates, "location_id", "left"))
    return out.select("member_id", "location_id", "contract_source", "plan_type", "churned_30d", "visit_frequency", "tenure_months",
                      "plan_price", "location_churn_rate", "enrollment_month", F.coalesce("payment_delay_flag", F.lit(0)).alias("payment_delay_flag"),
                      flag(F.col("_a").isNotNull()).alias("retention_action_taken"), F.coalesce("_a", F.lit("none")).alias("action_type"),
                      F.coalesce("_c", F.lit(0.0)).alias("action_cost"))


def balance(df: DataFrame, treatment: str, cols: Sequence[str], limit: float = 0.1) -> DataFrame:
    """Means, deviations and standardised mean difference per covariate, from one pass."""
    t = F.col(treatment) == 1
    aggs = []
    for i, c in enumerate(cols):
        for tag, cond in (("t", t), ("c", ~t)):
            v = F.when(cond, F.col(c).cast("double"))
            aggs += [F.avg(v).alias(f"m{tag}{i}"), F.stddev_samp(v).alias(f"s{tag}{i}")]
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), *[F.col(f"{k}{i}").alias(k) for k in ("mt", "st", "mc", "sc")]) for i, c in enumerate(cols)])
    long = df.agg(*aggs).select(F.inline(rows))
    pooled = F.sqrt((F.col("st") * F.col("st") + F.col("sc") * F.col("sc")) / 2)
    smd = F.when(pooled > 0, (F.col("mt") - F.col("mc")) / pooled).otherwise(0.0)
    return long.select("variable", round_dec(F.col("mt"), 6).alias("treated_mean"), round_dec(F.col("mc"), 6).alias("control_mean"),
                       round_dec(F.col("st"), 6).alias("treated_std"), round_dec(F.col("sc"), 6).alias("control_std"),
                       round_dec(smd, 6).alias("smd"), (F.abs(smd) > limit).alias("imbalanced"))


def naive_difference(df: DataFrame, treatment: str, outcome: str) -> DataFrame:
    t, y = F.col(treatment) == 1, F.col(outcome).cast("double")
    return df.agg(round_dec(F.avg(F.when(t, y)) - F.avg(F.when(~t, y)), 8).alias("effect"))


# ---- sums of products ------------------------------------------------------------------------


def _uniforms(hashes: np.ndarray, replicates: int | np.ndarray, seed: int) -> np.ndarray:
    """Uniform values per (row, replicate) from a 64-bit row hash by an integer mixing function; some replicates may be given by number, from 1."""
    with np.errstate(over="ignore"):
        which = np.arange(1, replicates + 1, dtype=np.uint64) if isinstance(replicates, int) else replicates.astype(np.uint64)
        x = hashes.astype(np.uint64)[:, None] + (which + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def row_hash(key: str) -> Column:
    """60 bits of the MD5 of the key's text: what a row's weights in all replicates follow from."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit("row"))), 1, 15), 16, 10).cast("bigint")


def replicate_weights(hashes: np.ndarray, replicates: int, kind: str, fraction: float, seed: int) -> np.ndarray:
    """Weights (row, replicate): 1 for ``all``, 0 or 1 for a ``subset``, Poisson counts for a ``bootstrap``."""
    if kind == "all":
        return np.ones((len(hashes), replicates))
    u = _uniforms(hashes, replicates, seed)
    return (u < fraction).astype(float) if kind == "subset" else np.searchsorted(_POISSON_CDF, u, side="right").astype(float)


_POISSON_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(13)])


def gram(df: DataFrame, cols: Sequence[str], key: str | None = None, replicates: int = 1, kind: str = "all",
         fraction: float = 0.8, seed: int = 42) -> np.ndarray:
    """Weighted sums of products of ``[1, *cols]``: an array (replicate, column, column).

    ``kind`` is ``all``, ``subset`` (each row kept with the given probability) or ``bootstrap``
    (Poisson weights). Weights depend on the key's hash only, so neither partitioning nor a
    retried task changes them, and all replicates come from one scan.
    """
    m = len(cols) + 1
    up = np.triu_indices(m)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)],
                     (row_hash(key) if key else F.lit(0).cast("bigint")).alias("_h")).dropna()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((replicates, len(up[0])))
        for b in batches:
            if not b.num_rows:
                continue
            z = np.column_stack([np.ones(b.num_rows)] + [b.column(f"_{i}").to_numpy(zero_copy_only=False) for i in range(m - 1)])
            if kind == "all":
                acc[0] += (z.T @ z)[up]
                continue
            w = replicate_weights(b.column("_h").to_numpy(zero_copy_only=False), replicates, kind, fraction, seed)
            acc += w.T @ (z[:, up[0]] * z[:, up[1]])
        yield pa.RecordBatch.from_pydict({"v": [acc.ravel().tolist()]})

    sums = rows.mapInArrow(partial, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"))
    flat = np.zeros(replicates * len(up[0]))
    for r in sums.collect():
        flat[r["i"]] = r["s"]
    out = np.zeros((replicates, m, m))
    for k, part in enumerate(flat.reshape(replicates, -1)):
        out[k][up] = part
        out[k] = out[k] + out[k].T - np.diag(np.diag(out[k]))
    return out


def centered(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Only the given columns as doubles minus their means (plus keys), so sums stay well scaled."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    if any(means[c] is None for c in cols):
        raise DataError("a column has no values")
    return df.withColumns({c: F.col(c).cast("double") - F.lit(float(means[c])) for c in cols})


@dataclass(frozen=True)
class Effect:
    effect: float
    std_error: float
    n: int
    method: str

    @property
    def p_value(self) -> float:
        return p_of_z(self.effect / self.std_error) if self.std_error > 0 else float("nan")

    def bounds(self, alpha: float = 0.05) -> tuple[float, float]:
        z = normal_quantile(1 - alpha / 2)
        return self.effect - z * self.std_error, self.effect + z * self.std_error

    def to_df(self, spark) -> DataFrame:
        low, high = self.bounds()
        return spark.createDataFrame([(self.method, self.effect, self.std_error, low, high, self.p_value, self.n)],
                                     "method string, effect double, std_error double, ci_lower double, ci_upper double, p_value double, n bigint")


def _ols(g: np.ndarray, x: Sequence[int], y: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and classical covariance from sums of products; x holds column positions."""
    a, b = g[np.ix_(x, x)], g[np.ix_(x, [y])][:, 0]
    inv = np.linalg.pinv(a, hermitian=True)
    beta = inv @ b
    rss = max(g[y, y] - b @ beta, 0.0)
    dof = max(g[0, 0] - np.linalg.matrix_rank(a), 1.0)
    return beta, inv * rss / dof


def linear_ate(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str]) -> Effect:
    """Coefficient of the treatment in a linear regression on treatment and confounders."""
    cols = list(dict.fromkeys([treatment, *confounders, outcome]))
    rows = df.select(*cols).dropna().persist()
    try:
        g = gram(centered(rows, cols), cols)[0]
    finally:
        rows.unpersist()
    beta, cov = _ols(g, range(len(cols)), len(cols))
    return Effect(float(beta[1]), float(math.sqrt(cov[1, 1])), int(round(g[0, 0])), "linear_regression")


def propensity(df: DataFrame, treatment: str, confounders: Sequence[str], out: str = "propensity", ridge: float = 1e-6) -> DataFrame:
    """Add the treatment probability from a logistic regression on the confounders.

    The model's own ``transform`` would send its training summary to the tasks, and with it the session, which cannot
    travel once it has seen an ``Observation`` or a job tag. So only the coefficients are used.
    """
    rows = df.dropna(subset=[treatment, *confounders])
    x = VectorAssembler(inputCols=list(confounders), outputCol="_x").transform(rows).withColumn("_t", F.col(treatment).cast("double"))
    model = LogisticRegression(featuresCol="_x", labelCol="_t", regParam=ridge, maxIter=100, standardization=True).fit(x)
    margin = sum((F.col(c).cast("double") * float(b) for c, b in zip(confounders, model.coefficients)), F.lit(0.0)) + float(model.intercept)
    return rows.withColumn(out, 1 - 1 / (1 + F.exp(margin)))


def weighted_ate(scored: DataFrame, treatment: str, outcome: str, score: str = "propensity", clip: float = 0.01) -> Effect:
    """Inverse-propensity (Hajek) difference of means with its influence-function error, in one pass.

    The second moments of the influence function expand into sums of w, wy and wyy per arm, so the
    means need not be known beforehand.
    """
    p = F.greatest(F.least(F.col(score), F.lit(1 - clip)), F.lit(clip))
    t, y = F.col(treatment).cast("double"), F.col(outcome).cast("double")
    w = F.when(t == 1, 1 / p).otherwise(1 / (1 - p))
    aggs = [F.count(y).alias("n")]
    for tag, cond in (("1", t == 1), ("0", t == 0)):
        for name, v in (("w", w), ("wy", w * y), ("ww", w * w), ("wwy", w * w * y), ("wwyy", w * w * y * y)):
            aggs.append(F.sum(F.when(cond, v)).alias(name + tag))
    r = scored.agg(*aggs).first()
    if not r["w1"] or not r["w0"]:
        raise DataError("one treatment arm is empty")
    m = {k: r[f"wy{k}"] / r[f"w{k}"] for k in "10"}
    var = sum((r[f"wwyy{k}"] - 2 * m[k] * r[f"wwy{k}"] + m[k] ** 2 * r[f"ww{k}"]) / r[f"w{k}"] ** 2 for k in "10")
    return Effect(m["1"] - m["0"], math.sqrt(max(var, 0.0)), r["n"], "propensity_score_weighting")


def _nearest(points: DataFrame, ranges: int | None, by: Sequence[str] = ()) -> DataFrame:
    """Add for both arms the nearest score with members of it, this score included (``m1``, ``m0``) or not (``o1``, ``o0``), inside each group of ``by``.

    Only ranges of scores meet in one task; what lies beyond a range's ends is carried from the other ranges, whose
    number follows the square root of the scores.
    """
    by = list(by)
    k = ranges or 1 + math.isqrt(points.count()) // 16
    edges = range_edges(points, "g", k)
    cut = points.withColumn("_b", F.lit(0.0)) if not edges else Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol="g", outputCol="_b").transform(points)
    point = lambda arm: F.when(F.col(f"n{arm}") > 0, F.struct("g", F.col(f"y{arm}").alias("y"), F.col(f"n{arm}").alias("n")))
    ends = cut.groupBy(*by, "_b").agg(*[f(point(arm)).alias(f"_{name}{arm}") for arm in "10" for name, f in (("last", F.max), ("first", F.min))])
    whole = Window.partitionBy(*by).orderBy("_b")
    before, after = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(*by, "_b", *[F.last(f"_last{arm}", ignorenulls=True).over(before).alias(f"_below{arm}") for arm in "10"],
                          *[F.first(f"_first{arm}", ignorenulls=True).over(after).alias(f"_above{arm}") for arm in "10"])
    own = Window.partitionBy(*by, "_b").orderBy("g")
    back = Window.partitionBy(*by, "_b").orderBy(F.desc("g"))  # a frame to the end of the range would be summed anew for every row
    out = cut.join(carried if by else F.broadcast(carried), [*by, "_b"])  # at most one row per range (and group)

    def closest(arm: str, strict: int) -> Column:
        a = F.coalesce(F.last(point(arm), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -strict)), F.col(f"_below{arm}"))
        b = F.coalesce(F.last(point(arm), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -strict)), F.col(f"_above{arm}"))
        return F.when(a.isNull() | (b["g"] - F.col("g") < F.col("g") - a["g"]), b).otherwise(a)

    return out.select(*points.columns, *[closest(arm, strict).alias(f"{name}{arm}") for arm in "10" for name, strict in (("m", 0), ("o", 1))])


def matched_ate(scored: DataFrame, treatment: str, outcome: str, score: str = "propensity", ranges: int | None = None) -> DataFrame:
    """Nearest-neighbour matching with replacement on the propensity score, both directions, with its standard error.

    All members of the other arm at the nearest score are averaged, the lower score on equal distance. The error is
    Abadie and Imbens' for matching: the spread of the single effects, and the variance of each outcome (among members of its arm
    at its score, or against the nearest such score) by how often the member was used. It is null where an arm has
    only one member. Members collapse to one row per score, and ``ranges`` of scores only balance the work. Members
    without treatment, outcome or score are left out.
    """
    y, t = F.col(outcome).cast("double"), F.col(treatment).cast("double")
    rows = scored.select(F.col(score).cast("double").alias("g"), t.alias("t"), y.alias("y")).dropna()
    arms = (("1", F.col("t") == 1), ("0", F.col("t") != 1))
    points = rows.groupBy("g").agg(*[a for arm, of in arms for a in (
        F.count_if(of).alias(f"n{arm}"), F.avg(F.when(of, F.col("y"))).alias(f"y{arm}"),
        F.coalesce(F.var_pop(F.when(of, F.col("y"))), F.lit(0.0)).alias(f"v{arm}"))]).persist()
    try:
        near = _nearest(points, ranges).persist()
        used = [near.filter(f"n{other} > 0").groupBy(F.col(f"m{arm}")["g"].alias("g")).agg(F.sum(f"n{other}").alias(f"u{arm}"))
                for arm, other in ("10", "01")]
        both = near.join(used[0], "g", "left").join(used[1], "g", "left").fillna(0, ["u1", "u0"])
        aggs = []
        for arm, other, sign in (("1", "0", 1), ("0", "1", -1)):
            n, v, u, o = F.col(f"n{arm}"), F.col(f"v{arm}"), F.col(f"u{arm}"), F.col(f"o{arm}")
            gain = F.lit(sign) * (F.col(f"y{arm}") - F.col(f"m{other}")["y"])
            var = F.when(n > 1, v * n / (n - 1)).otherwise(F.pow(F.col(f"y{arm}") - o["y"], 2) * o["n"] / (o["n"] + 1))
            weight = u * u / n + 2 * u - u / n  # of the n members at the score together
            here = lambda e: F.sum(F.when(n > 0, e))
            aggs += [F.sum(n).alias(f"n{arm}"), here(n * gain).alias(f"s{arm}"), here(n * (gain * gain + v)).alias(f"ss{arm}"),
                     here(F.when(u > 0, weight * var).otherwise(0.0)).alias(f"w{arm}"), F.count_if((n > 0) & (u > 0) & var.isNull()).alias(f"x{arm}")]
        r = both.agg(*aggs).first()
        near.unpersist()
    finally:
        points.unpersist()
    if not r["n1"] or not r["n0"]:
        raise DataError("one treatment arm is empty")
    n = r["n1"] + r["n0"]
    effect = (r["s1"] + r["s0"]) / n
    var = (r["ss1"] + r["ss0"] - n * effect * effect + r["w1"] + r["w0"]) / n**2
    se = None if r["x1"] or r["x0"] else round(math.sqrt(max(var, 0.0)), 8)
    return scored.sparkSession.createDataFrame([(round(effect, 8), round(r["s1"] / r["n1"], 8), se, n)],
                                               "effect double, effect_on_treated double, std_error double, n bigint")


def estimate_ate(df: DataFrame, spec: CausalSpec, method: str = "propensity_score_weighting") -> Effect:
    check_spec(spec, df)
    args = (spec.treatment, spec.outcome)
    if method == "linear_regression":
        return linear_ate(df, *args, spec.confounders)
    df = df.select(*[c for c in df.columns if c in {"member_id", *args, *spec.confounders}]).persist()
    try:
        return _score_ate(df, spec, method)
    finally:
        df.unpersist()


def _score_ate(df: DataFrame, spec: CausalSpec, method: str) -> Effect:
    args = (spec.treatment, spec.outcome)
    scored = propensity(df, spec.treatment, spec.confounders)
    if method == "propensity_score_weighting":
        return weighted_ate(scored, *args)
    if method == "propensity_score_matching":
        r = matched_ate(scored, *args).first()
        return Effect(r["effect"], float("nan") if r["std_error"] is None else r["std_error"], r["n"], method)
    raise DataError(f"unknown method {method!r}")


# ---- sensitivity -----------------------------------------------------------------------------


def sensitivity(df: DataFrame, key: str, spec: CausalSpec, strengths: Sequence[float] = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
                seed: int = 42) -> DataFrame:
    """Effect after adjusting for a simulated confounder of growing strength; flags sign changes.

    All strengths are extra columns of one sum of products. The simulated variable is split at its
    median.
    """
    t, y, x = spec.treatment, spec.outcome, list(spec.confounders)
    rows = df.select(key, *dict.fromkeys([t, y, *x])).dropna().persist()
    noise = hash_normal(key, seed=seed)
    live = [s for s in strengths if s > 0]
    base_rows = rows
    rows = rows.withColumns({f"_u{i}": F.lit(s) * F.col(t) + F.lit(s) * F.col(y) + F.lit(1 - 2 * s) * noise for i, s in enumerate(live)})
    names = [f"_u{i}" for i in range(len(live))]
    if names:
        cuts = fit_percentiles(rows, names, 0.5)  # of all strengths, from one job
        rows = rows.withColumns({c: (F.col(c) > F.lit(float(cuts[c]))).cast("double") for c in names})
    cols = list(dict.fromkeys([t, *x, y])) + names
    g = gram(centered(rows, cols), cols)[0]
    base_rows.unpersist()
    k = len(cols) - len(names)
    base = float(_ols(g, range(k), k)[0][1])
    out = []
    for s in strengths:
        e = base if s <= 0 else float(_ols(g, [*range(k), k + 1 + live.index(s)], k)[0][1])
        out.append((float(s), e * 100, bool(e * base < 0)))
    return df.sparkSession.createDataFrame(out, "confounder_strength double, ate_adjusted_pp double, sign_flipped boolean")


def partial_correlation(df: DataFrame, x: str, y: str, covariates: Sequence[str]) -> DataFrame:
    """Correlation of x and y given the covariates, from one covariance matrix."""
    cols = [x, y, *covariates]
    g = gram(centered(df.dropna(subset=cols), cols), cols)[0]
    n = g[0, 0]
    cov = g[1:, 1:] / n - np.outer(g[0, 1:] / n, g[0, 1:] / n)
    prec = np.linalg.pinv(cov, hermitian=True)
    r = float(-prec[0, 1] / math.sqrt(prec[0, 0] * prec[1, 1]))
    t = r * math.sqrt((n - 2) / max(1 - r * r, 1e-300))
    return df.sparkSession.createDataFrame([(x, y, round(r, 6), round(t, 4), p_of_z(t), int(round(n)))],
                                           "x string, y string, partial_r double, t double, p_value double, n bigint")


# ---- effect tables ---------------------------------------------------------------------------


def tenure_group(months: Column) -> Column:
    """Right-closed groups; a tenure of 0 belongs to none."""
    return right_closed_bin(months, TENURE_BINS, TENURE_LABELS)


def effects_by_segment(effects: DataFrame, effect: str = "cate_mean") -> DataFrame:
    """Effects by contract source and tenure group; needs ``contract_source`` and ``tenure_months``."""
    g = effects.withColumn("tenure_group", tenure_group(F.col("tenure_months"))).filter("tenure_group is not null and contract_source is not null")
    return g.groupBy("contract_source", "tenure_group").agg(
        F.count(effect).alias("n_members"), round_dec(F.avg(effect), 6).alias("cate_mean"),
        round_dec(F.coalesce(F.stddev_samp(effect), F.lit(0.0)), 6).alias("cate_std")).withColumn(
        "segment", F.concat_ws("_", "contract_source", "tenure_group"))


def effects_by_group(effects: DataFrame, members: DataFrame, cols: Sequence[str], effect: str = "cate_mean") -> DataFrame:
    """Count, mean, deviation and exact quartiles of the effects by any member columns."""
    missing = [c for c in cols if c not in members.columns]
    if missing:
        raise DataError(f"group columns missing: {missing}")
    rows = effects.select("member_id", effect).join(members.select("member_id", *cols), "member_id", "left").dropna(subset=list(cols))
    stats = rows.groupBy(*cols).agg(F.count(effect).alias("n_members"), round_dec(F.avg(effect), 6).alias("cate_mean"),
                                    round_dec(F.coalesce(F.stddev_samp(effect), F.lit(0.0)), 6).alias("cate_std"))
    q = exact_percentiles(rows, effect, {"cate_median": 0.5, "cate_q25": 0.25, "cate_q75": 0.75}, cols)
    return stats.join(q, list(cols), "left").withColumns({c: round_dec(F.col(c), 6) for c in ("cate_median", "cate_q25", "cate_q75")})


def effects_by_action(effects: DataFrame, effect: str = "cate_mean") -> DataFrame:
    """Effect per action type with mean cost and effect per 100 cost units (treated members only)."""
    return effects.filter("action_type <> 'none'").groupBy("action_type").agg(
        F.count(effect).alias("n"), round_dec(F.avg(effect), 6).alias("cate_mean"), round_dec(F.stddev_samp(effect), 6).alias("cate_std"),
        round_dec(F.avg("action_cost"), 4).alias("avg_cost"),
        round_dec(F.try_divide(F.abs(F.avg(effect)), F.avg("action_cost")) * 100, 6).alias("effect_per_cost"))


def segment_pivot(segments: DataFrame) -> DataFrame:
    """Effects in percentage points, sources by tenure groups (fixed columns)."""
    pivot = segments.groupBy("contract_source").pivot("tenure_group", TENURE_LABELS).agg(F.first("cate_mean"))
    return pivot.select("contract_source", *[round_dec(F.col(f"`{g}`") * 100, 4).alias(f"t_{g.replace('-', '_').replace('+', '_plus')}") for g in TENURE_LABELS])


def extreme_segments(segments: DataFrame) -> DataFrame:
    """Strongest (most negative) and weakest effect on churn."""
    order = F.struct("cate_mean", "segment")
    return segments.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).select(
        F.col("lo.segment").alias("strongest_segment"), F.col("lo.cate_mean").alias("strongest_effect"),
        F.col("hi.segment").alias("weakest_segment"), F.col("hi.cate_mean").alias("weakest_effect"))


def effect_lookup(segments: DataFrame, z: float = 1.96) -> DataFrame:
    """Interval of each segment's mean effect and whether it excludes zero."""
    se = F.col("cate_std") / F.sqrt(F.col("n_members"))
    low, high = F.col("cate_mean") - z * se, F.col("cate_mean") + z * se
    return segments.withColumns({"ci_lower": round_dec(low, 6), "ci_upper": round_dec(high, 6), "significant": (low > 0) | (high < 0)})
