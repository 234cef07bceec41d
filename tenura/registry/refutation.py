"""Refutation tests. Their draws are MD5 and integer arithmetic, so SQL draws the same subsets, samples and permutations."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import functions as F

from tenura.functions import round_dec
from tenura.operators import causal, refute
from tenura.registry.base import R, query
from tenura.registry.effects import BASE, SPEC, X, cframe

SEED = 42
TESTS = ("placebo_treatment", "random_common_cause", "data_subset", "bootstrap")
TWO = ("visit_frequency", "tenure_months")

RF = ("rf AS (SELECT member_id, CAST(retention_action_taken AS DOUBLE) AS t, CAST(churned_30d AS DOUBLE) AS y, "
      + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in X) + " FROM cf WHERE plan_price IS NOT NULL)")


def unit(key: str, seed: int) -> str:
    return f"((CAST('0x' || substr(md5({key} || '|{seed}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496::DOUBLE)"


def normal(key: str, seed: int) -> str:
    return f"(sqrt(-2::DOUBLE * ln({unit(key, seed)})) * cos(6.283185307179586::DOUBLE * {unit(key, seed + 7919)}))"


def wrap(x: str) -> str:
    return f"CAST(({x}) % CAST('18446744073709551616' AS UHUGEINT) AS UBIGINT)"


def big(x) -> str:
    return f"CAST('{x}' AS UHUGEINT)"


def weights(replicates: int, kind: str) -> tuple[str, ...]:
    """wt: (member_id, k, w) of rows that count, by the mixing function of the operator."""
    golden, a, b = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    cdf, total = [], 0.0
    for i in range(13):
        total += math.exp(-1.0) / math.factorial(i)
        cdf.append(total)
    w = {"all": "1", "subset": "CAST(u < 0.8 AS INT)", "bootstrap": " + ".join(f"CAST(u >= {c!r}::DOUBLE AS INT)" for c in cdf)}[kind]
    return (
        f"u0 AS (SELECT member_id, k, {wrap(f'CAST(h AS UHUGEINT) + CAST(k + 1 + {SEED * 1_000_003} AS UHUGEINT) * {big(golden)}')} AS x FROM (SELECT member_id, CAST('0x' || substr(md5(member_id || '|row'), 1, 15) AS UBIGINT) AS h FROM rf), (SELECT UNNEST(range(0, {replicates})) AS k))",
        f"u1 AS (SELECT member_id, k, {wrap(f'CAST(xor(x, x >> 30) AS UHUGEINT) * {big(a)}')} AS x FROM u0)",
        f"u2 AS (SELECT member_id, k, {wrap(f'CAST(xor(x, x >> 27) AS UHUGEINT) * {big(b)}')} AS x FROM u1)",
        "u3 AS (SELECT member_id, k, CAST(xor(x, x >> 31) >> 11 AS DOUBLE) / 9007199254740992 AS u FROM u2)",
        f"wt AS (SELECT * FROM (SELECT member_id, k, {w} AS w FROM u3) WHERE w > 0)")


def linear(table: str, cols: tuple[str, ...], out: str, weighted: bool) -> tuple[str, ...]:
    """``out``: (k, e), the coefficient of t in the regression of y on t and ``cols``, by sweeping the covariates out of the covariances."""
    names, p = ("t", "y", *cols), f"{out}_"
    w = "w" if weighted else "1"
    sums = [f"SUM({w} * {c}) AS s{i}" for i, c in enumerate(names)] + [f"SUM({w} * {names[i]} * {names[j]}) AS s{i}_{j}" for i in range(len(names)) for j in range(i, len(names))]
    source = f"{table} JOIN wt USING (member_id)" if weighted else table
    key = "k" if weighted else "0 AS k"
    out_ = [f"{p}w AS (SELECT {key}, SUM({w})::DOUBLE AS s, {', '.join(sums)} FROM {source} GROUP BY 1)"]
    cells = [f"SELECT k, {i} AS i, {j} AS j, s{min(i, j)}_{max(i, j)} - s{i} * s{j} / s AS v FROM {p}w" for i in range(len(names)) for j in range(len(names))]
    out_.append(f"{p}0 AS (" + " UNION ALL ".join(cells) + ")")
    for n, c in enumerate(range(2, len(names))):
        out_.append(f"{p}{n + 1} AS (SELECT a.k, a.i, a.j, a.v - b.v * c.v / d.v AS v FROM {p}{n} a JOIN {p}{n} b ON b.k = a.k AND b.i = a.i AND b.j = {c} JOIN {p}{n} c ON c.k = a.k AND c.i = {c} AND c.j = a.j "
                    f"JOIN {p}{n} d ON d.k = a.k AND d.i = {c} AND d.j = {c} WHERE a.i <> {c} AND a.j <> {c})")
    last = f"{p}{len(names) - 2}"
    out_.append(f"{out} AS (SELECT a.k, a.v / b.v AS e FROM {last} a JOIN {last} b ON b.k = a.k AND b.i = 0 AND b.j = 0 WHERE a.i = 0 AND a.j = 1)")
    return tuple(out_)


PERMUTED = (f"pr AS (SELECT rf.* REPLACE (q.t AS t) FROM rf JOIN (SELECT member_id, ROW_NUMBER() OVER (ORDER BY {unit('member_id', SEED + 1)}, member_id) AS r FROM rf) a USING (member_id) "
            f"JOIN (SELECT t, ROW_NUMBER() OVER (ORDER BY {unit('member_id', SEED + 2)}, member_id) AS r FROM rf) q ON q.r = a.r)",)
NOISY = (f"ru AS (SELECT *, {normal('member_id', SEED)} AS u FROM rf)",)
CHANGE = "ABS(r.e - o.e) / GREATEST(ABS(o.e), 1e-6)"


def report(name: str, passed: str, refuted: str) -> str:
    return f"SELECT '{name}' AS test_name, {passed} AS passed, {R('o.e', 6)} AS original_effect, {R('r.e', 6)} AS refuted_effect FROM orig o, ({refuted}) r"


PLACEBO = report("placebo_treatment", "ABS(r.e) < 0.01", "SELECT e FROM plac")
COMMON = report("random_common_cause", f"{CHANGE} < 0.1", "SELECT e FROM comm")
SUBSET = report("data_subset", "r.s / GREATEST(ABS(r.e), 1e-6) < 0.3", "SELECT AVG(e) AS e, STDDEV_POP(e) AS s FROM subs")
BOOT = report("bootstrap", f"{CHANGE} < 0.15", "SELECT AVG(e) AS e FROM boot")
ORIG = linear("rf", X, "orig", False)


def rows(t, method: str, tests, confounders=X):
    """The report without its texts."""
    out = refute.refute(cframe(t).dropna(subset=["plan_price"]), "member_id", replace(SPEC, confounders=tuple(confounders)), method, tests=tests)
    return out.select("test_name", "passed", *[round_dec(F.col(c), 6).alias(c) for c in ("original_effect", "refuted_effect")])


@query("cau10_placebo_treatment", PLACEBO, *BASE, RF, *ORIG, *PERMUTED, *linear("pr", X, "plac", False))
def _(t):
    return rows(t, "linear_regression", ["placebo_treatment"])


@query("cau11_random_common_cause", COMMON, *BASE, RF, *ORIG, *NOISY, *linear("ru", (*X, "u"), "comm", False))
def _(t):
    return rows(t, "linear_regression", ["random_common_cause"])


@query("cau12_data_subset", SUBSET, *BASE, RF, *ORIG, *weights(5, "subset"), *linear("rf", X, "subs", True))
def _(t):
    return rows(t, "linear_regression", ["data_subset"])


@query("cau13_bootstrap", BOOT, *BASE, RF, *ORIG, *weights(200, "bootstrap"), *linear("rf", X, "boot", True))
def _(t):
    return rows(t, "linear_regression", ["bootstrap"])


# Propensity models of two covariates: Newton steps of a 3 x 3 system for each replicate.

STEPS = 9


def logistic(table: str, out: str, ridge: float = 1e-6) -> tuple[str, ...]:
    """``out``: (k, member_id, w, t, y, p) with the propensity of each row in each replicate of wt."""
    a, b = TWO
    p = f"{out}_"
    got = [f"{p}z AS (SELECT member_id, k, w, t, y, ({a} - m.ma) / m.sa AS z1, ({b} - m.mb) / m.sb AS z2 FROM {table} JOIN wt USING (member_id), "
           f"(SELECT AVG({a}) AS ma, STDDEV_POP({a}) AS sa, AVG({b}) AS mb, STDDEV_POP({b}) AS sb FROM {table}) m)",
           f"{p}b0 AS (SELECT DISTINCT k, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM wt)"]
    for n in range(STEPS):
        q = "p * (1 - p)"
        got += [f"{p}p{n} AS (SELECT z.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS p FROM {p}z z JOIN {p}b{n} USING (k))",
                f"""{p}g{n} AS (SELECT k, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, SUM(w * (t - p)) AS g0, SUM(w * (t - p) * z1) - SUM(w) * {ridge} * any_value(b1) AS g1, SUM(w * (t - p) * z2) - SUM(w) * {ridge} * any_value(b2) AS g2,
  SUM(w * {q}) AS h00, SUM(w * {q} * z1) AS h01, SUM(w * {q} * z2) AS h02, SUM(w * {q} * z1 * z1) + SUM(w) * {ridge} AS h11, SUM(w * {q} * z1 * z2) AS h12, SUM(w * {q} * z2 * z2) + SUM(w) * {ridge} AS h22 FROM {p}p{n} GROUP BY k)""",
                f"""{p}i{n} AS (SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02, h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22,
  h00 * (h11 * h22 - h12 * h12) + h01 * (h02 * h12 - h01 * h22) + h02 * (h01 * h12 - h02 * h11) AS det FROM {p}g{n})""",
                f"{p}b{n + 1} AS (SELECT k, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det AS b0, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det AS b1, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det AS b2 FROM {p}i{n})"]
    got.append(f"{out} AS (SELECT member_id, k, w, t, y, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS p FROM {p}z JOIN {p}b{STEPS} USING (k))")
    return tuple(got)


def hajek(scored: str, out: str) -> str:
    c = "GREATEST(LEAST(p, 0.99), 0.01)"
    return (f"{out} AS (SELECT k, SUM(CASE WHEN t = 1 THEN w * y / {c} END) / SUM(CASE WHEN t = 1 THEN w / {c} END) "
            f"- SUM(CASE WHEN t <> 1 THEN w * y / (1 - {c}) END) / SUM(CASE WHEN t <> 1 THEN w / (1 - {c}) END) AS e FROM {scored} GROUP BY k)")


def nearest(scored: str, out: str) -> tuple[str, ...]:
    return (f"{out}_a AS (SELECT k, t, p, SUM(w * y) / SUM(w) AS y FROM {scored} GROUP BY ALL)",
            f"{out}_m AS (SELECT x.k, x.t, x.p, ARG_MIN(a.y, (ABS(x.p - a.p), a.p)) AS y FROM {out}_a x JOIN {out}_a a ON a.k = x.k AND a.t = 1 - x.t GROUP BY ALL)",
            f"{out} AS (SELECT s.k, SUM(w * (CASE WHEN s.t = 1 THEN s.y - m.y ELSE m.y - s.y END)) / SUM(w) AS e FROM {scored} s JOIN {out}_m m ON m.k = s.k AND m.t = s.t AND m.p = s.p GROUP BY s.k)")


def renamed(ctes: tuple[str, ...], suffix: str) -> tuple[str, ...]:
    """The expressions of ``weights`` under other names, so that two sets of weights fit in one statement."""
    out = []
    for c in ctes:
        for name in ("u0", "u1", "u2", "u3", "wt"):
            c = c.replace(f"{name} AS", f"{name}{suffix} AS").replace(f"FROM {name})", f"FROM {name}{suffix})")
        out.append(c)
    return tuple(out)


def on(ctes: tuple[str, ...], suffix: str) -> tuple[str, ...]:
    return tuple(c.replace("JOIN wt ", f"JOIN wt{suffix} ").replace("FROM wt)", f"FROM wt{suffix})") for c in ctes)


ALL_ROWS, SUBSETS = renamed(weights(1, "all"), "o"), renamed(weights(5, "subset"), "s")


@query("cau12_data_subset_weighting", SUBSET, *BASE, RF, *ALL_ROWS, *on(logistic("rf", "so"), "o"), hajek("so", "orig"), *SUBSETS, *on(logistic("rf", "ss"), "s"), hajek("ss", "subs"))
def _(t):
    return rows(t, "propensity_score_weighting", ["data_subset"], TWO)


@query("cau12_data_subset_matching", SUBSET, *BASE, RF, *ALL_ROWS, *on(logistic("rf", "so"), "o"), *nearest("so", "orig"), *SUBSETS, *on(logistic("rf", "ss"), "s"), *nearest("ss", "subs"))
def _(t):
    return rows(t, "propensity_score_matching", ["data_subset"], TWO)


@query("cau13_bootstrap_weighting", BOOT, *BASE, RF, *ALL_ROWS, *on(logistic("rf", "so"), "o"), hajek("so", "orig"), *renamed(weights(200, "bootstrap"), "b"), *on(logistic("rf", "sb"), "b"), hajek("sb", "boot"))
def _(t):
    return rows(t, "propensity_score_weighting", ["bootstrap"], TWO)


@query("cau14_refutation_report", " UNION ALL ".join((PLACEBO, COMMON, SUBSET, BOOT)), *BASE, RF, *ORIG, *PERMUTED, *linear("pr", X, "plac", False), *NOISY, *linear("ru", (*X, "u"), "comm", False),
       *SUBSETS, *on(linear("rf", X, "subs", True), "s"), *renamed(weights(200, "bootstrap"), "b"), *on(linear("rf", X, "boot", True), "b"))
def _(t):
    return rows(t, "linear_regression", TESTS)


@query("cau14_refutation_report_weighting")
def _(t):
    return refute.refute(cframe(t), "member_id", SPEC, "propensity_score_weighting")


@query("cau14_refutation_report_matching")
def _(t):
    return refute.refute(cframe(t), "member_id", SPEC, "propensity_score_matching")


# ---- sensitivity ---------------------------------------------------------------------------------

STRENGTHS = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)


def confounded(i: int, s: float) -> tuple[str, ...]:
    return (f"sv{i} AS (SELECT *, {s!r}::DOUBLE * t + {s!r}::DOUBLE * y + {1 - 2 * s!r}::DOUBLE * {normal('member_id', SEED)} AS v FROM rf)",
            f"su{i} AS (SELECT *, CAST(v > (SELECT quantile_cont(v, 0.5) FROM sv{i}) AS DOUBLE) AS u FROM sv{i})", *linear(f"su{i}", (*X, "u"), f"se{i}", False))


@query("cau23_sensitivity", f"SELECT 0::DOUBLE AS confounder_strength, {R('o.e * 100', 6)} AS ate_adjusted_pp, FALSE AS sign_flipped FROM orig o UNION ALL " + " UNION ALL ".join(
    f"SELECT {s!r}::DOUBLE, {R('r.e * 100', 6)}, r.e * o.e < 0 FROM orig o, se{i} r" for i, s in enumerate(STRENGTHS)), *BASE, RF, *ORIG, *[c for i, s in enumerate(STRENGTHS) for c in confounded(i, s)])
def _(t):
    return causal.sensitivity(cframe(t), "member_id", SPEC).withColumn("ate_adjusted_pp", round_dec(F.col("ate_adjusted_pp"), 6))
