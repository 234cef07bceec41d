import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tenura.config import Action, CausalSpec, Limits
from tenura.errors import DataError, InfeasibleError
from tenura.functions.stats import p_of_z, two_sided_p
from tenura.operators import allocate, causal, churn, cox, forest, ltv, monitor, refute, survival


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 400
    x, z = rng.normal(size=n), rng.integers(0, 2, size=n)
    t = rng.exponential(12 / np.exp(0.8 * x - 0.5 * z))
    c = rng.uniform(2, 40, size=n)
    dur = np.maximum(np.round(np.minimum(t, c), 1), 0.1)
    return spark.createDataFrame([(int(i), float(d), int(a <= b), float(u), float(v)) for i, (d, a, b, u, v) in enumerate(zip(dur, t, c, x, z))],
                                 "member_id long, duration double, event long, x double, z double")


def efron(rows, beta):
    ll = 0.0
    for t in {r["duration"] for r in rows if r["event"]}:
        dead = [r for r in rows if r["event"] and r["duration"] == t]
        risk = sum(math.exp(beta @ [r["x"], r["z"]]) for r in rows if r["duration"] >= t)
        own = sum(math.exp(beta @ [r["x"], r["z"]]) for r in dead)
        ll += sum(float(beta @ [r["x"], r["z"]]) for r in dead) - sum(math.log(risk - k / len(dead) * own) for k in range(len(dead)))
    return ll


def test_cox_maximises_the_efron_likelihood(frame):
    m = survival.fit_cox(frame, ["x", "z"], penalizer=0.0)
    rows = frame.collect()
    best = efron(rows, m.coef)
    centred = float(m.coef @ m.center) * sum(r["event"] for r in rows)
    assert m.log_likelihood == pytest.approx(best, abs=1e-6) or m.log_likelihood == pytest.approx(best - centred, abs=1e-6)
    for step in ([1e-3, 0], [-1e-3, 0], [0, 1e-3], [0, -1e-3]):
        assert efron(rows, m.coef + np.array(step)) < best
    assert abs(m.coef[0] - 0.8) < 0.2 and abs(m.coef[1] + 0.5) < 0.35


def test_cox_does_not_depend_on_partitions(frame):
    a, b = survival.fit_cox(frame.coalesce(1), ["x", "z"]), survival.fit_cox(frame.repartition(7), ["x", "z"])
    assert np.allclose(a.coef, b.coef, atol=1e-9)


def test_tie_sums_match_the_plain_sums():
    cases = [(d, d * f) for d in (1, 2, 31, 32, 33, 34, 200, 2_001, 50_000) for f in (1.0, 1.0 + 1e-9, 1.5, 40.0, 1e6)] + [(7, 7.5), (1, 1e12)]
    d, a = np.array([c[0] for c in cases]), np.array([c[1] for c in cases])
    got = cox.tie_sums(d, a)
    for i, (n, x) in enumerate(cases):
        k = x - np.arange(n)
        for g, want in zip(got, (math.fsum(np.log(k)), math.fsum(1 / k), math.fsum(1 / k**2))):
            assert g[i] == pytest.approx(want, rel=1e-12, abs=1e-13)
    assert all(len(s) == 0 for s in cox.tie_sums(np.empty(0, int), np.empty(0)))


def plain_terms(t, e, x, beta):
    """Efron's likelihood, gradient and information, tie by tie."""
    p = len(beta)
    w = np.exp(x @ beta)
    ll, grad, info = 0.0, np.zeros(p), np.zeros((p, p))
    for at in np.unique(t[e == 1]):
        risk, own = t >= at, (t == at) & (e == 1)
        d = own.sum()
        ll += (x[own] @ beta).sum()
        grad += x[own].sum(0)
        for l in range(d):
            v = np.where(risk, w, 0.0) - np.where(own, w * l / d, 0.0)
            m = v @ x / v.sum()
            ll -= np.log(v.sum())
            grad -= m
            info += (x * v[:, None]).T @ x / v.sum() - np.outer(m, m)
    return ll, grad, info


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_cox_terms_match_the_plain_sums_with_heavy_ties(spark, ranges):
    """A third of all members leave at one time, so that it is a range of its own in slices; 200 ties take the expansion."""
    rng = np.random.default_rng(11)
    n = 700
    t = np.where(rng.random(n) < 0.35, 5.0, np.where(rng.random(n) < 0.5, np.round(rng.exponential(6, n), 0) + 1, rng.exponential(6, n)))
    e, x = (rng.random(n) < 0.7).astype(int), np.column_stack([rng.normal(size=n), rng.integers(0, 2, n), rng.exponential(size=n)])
    df = spark.createDataFrame([(float(a), int(b), *map(float, c)) for a, b, c in zip(t, e, x)] + [(None, 1, 0.0, 0.0, 0.0), (2.0, 1, None, 0.0, 0.0)], "duration double, event int, a double, b double, c double")
    passes = cox.Passes(df, ["a", "b", "c"], ranges)
    beta = np.array([0.3, -0.4, 0.2])
    ll, grad, info, trend = passes.terms(beta)
    want = plain_terms(t, e, x - passes.center, beta)
    assert passes.n == n and ll == pytest.approx(want[0], rel=1e-12)
    assert np.allclose(grad, want[1], rtol=1e-9, atol=1e-9) and np.allclose(info, want[2], rtol=1e-9, atol=1e-9)
    base = {r["duration"]: r for r in passes.baseline(beta).collect()}
    passes.close()
    w, hazard = np.exp((x - passes.center) @ beta), 0.0
    assert sorted(base) == sorted(set(t[e == 1]))
    for at in np.unique(t[e == 1]):
        d = ((t == at) & (e == 1)).sum()
        hazard += d / w[t >= at].sum()
        assert base[at]["events"] == d and base[at]["hazard"] == pytest.approx(hazard, rel=1e-10) and base[at]["at_risk"] == pytest.approx(w[t >= at].sum(), rel=1e-10)


def test_cox_results_do_not_depend_on_ranges(frame):
    a, b = survival.fit_cox(frame, ["x", "z"], ranges=1), survival.fit_cox(frame, ["x", "z"], ranges=37)
    assert np.allclose(a.coef, b.coef, atol=1e-10) and a.log_likelihood == pytest.approx(b.log_likelihood, abs=1e-8)
    assert all(a.trend[k] == pytest.approx(b.trend[k], rel=1e-8, abs=1e-8) for k in a.trend)
    assert a.baseline_at([1, 5, 20]) == pytest.approx(b.baseline_at([1, 5, 20]), abs=1e-10)


def test_many_distinct_times_stay_off_the_driver(spark):
    """200,000 distinct times: what reaches the driver is one vector for each range."""
    df = spark.range(200_000).select((F.lit(1.0) + F.col("id") * 1e-4).alias("duration"), (F.xxhash64("id") % 3 == 0).cast("int").alias("event"), (F.col("id") % 7 / 7.0).alias("x"))
    m = survival.fit_cox(df, ["x"], 0.0)
    assert m.n == 200_000 and m.baseline.count() == df.where("event = 1").count() and abs(m.coef[0]) < 0.1
    calls = []
    passes = cox.Passes(df, ["x"])
    calls.append(len(passes.totals(m.coef)))
    passes.close()
    assert calls[0] <= 2 * cox.LEAST_RANGES


def test_median_times_match_a_search(spark, frame):
    m = survival.fit_cox(frame, ["x", "z"], penalizer=0.0)
    steps = sorted((r["hazard"], r["duration"]) for r in m.baseline.collect())
    rows = [(i, float(v), float(i % 2), "kept") for i, v in enumerate(np.linspace(-4, 4, 200))] + [(900, None, 1.0, "kept"), (901, 0.5, 0.0, "kept"), (902, 0.5, 0.0, "kept")]
    df = spark.createDataFrame(rows, "member_id long, x double, z double, h string")
    got = {r["member_id"]: r for r in survival.predict_median(m, df, cap=30.0).collect()}
    assert len(got) == len(rows)
    for i, x, z, _ in rows:
        if x is None:
            assert got[i]["median_survival"] is None
            continue
        need = math.log(2) / math.exp(float(m.coef @ (np.array([x, z]) - m.center)))
        want = min([t for h, t in steps if h >= need] + [30.0])
        assert got[i]["median_survival"] == min(want, 30.0) and got[i]["h"] == "kept"


def test_curves_in_ranges_match_plain_products(spark):
    rng = random.Random(2)
    rows = [("ab"[rng.random() < 0.8], 7.0 if rng.random() < 0.3 else round(rng.expovariate(0.1), 2), int(rng.random() < 0.6)) for _ in range(600)]
    df = spark.createDataFrame(rows, "s string, duration double, event int")
    got = {(r["s"], r["duration"]): r for r in survival.kaplan_meier(df, ["s"]).collect()}
    for s in "ab":
        mine, surv = [r for r in rows if r[0] == s], 1.0
        for t in sorted({r[1] for r in mine}):
            n, d = sum(r[1] >= t for r in mine), sum(r[1] == t and r[2] for r in mine)
            surv *= 1 - d / n
            assert (got[s, t]["at_risk"], got[s, t]["events"]) == (n, d) and got[s, t]["survival"] == pytest.approx(surv, abs=1e-6)
    windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", survival.kaplan_meier(df, ["s"])._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("_r#" in w or "DESC" not in w and "ASC" not in w for w in windows)  # nothing is ordered but within ranges, or the ranges themselves


def test_concordance_equals_all_pairs(frame):
    rows = frame.collect()
    good = total = 0.0
    for a, b in itertools.product(rows, rows):
        if a["event"] and (b["duration"] > a["duration"] or (b["duration"] == a["duration"] and not b["event"])):
            total += 1
            good += 1.0 if a["x"] > b["x"] else 0.5 if a["x"] == b["x"] else 0.0
    for ranges in (1, 9, None):
        got = survival.concordance(frame, F.col("x"), ranges=ranges).first()
        assert got["concordance"] == pytest.approx(good / total, abs=1e-6) and got["pairs"] == total


@pytest.mark.parametrize("ranges", [1, 6, 40])
def test_concordance_with_common_times_and_risks(spark, ranges):
    rng = np.random.default_rng(5)
    n = 400
    time = np.where(rng.random(n) < 0.35, 7.25, np.round(rng.exponential(10, n), 2))
    risk = np.where(rng.random(n) < 0.35, 0.5, np.round(rng.normal(size=n), 2))
    event = (rng.random(n) < 0.5).astype(int)
    rows = [(float(t), int(e), float(x)) for t, e, x in zip(time, event, risk)] + [(None, 1, 0.1), (3.0, 1, None)]
    pair = (event[:, None] == 1) & ((time[None] > time[:, None]) | ((time[None] == time[:, None]) & (event[None] == 0)))
    good = (pair & (risk[:, None] > risk[None])).sum() + (pair & (risk[:, None] == risk[None])).sum() / 2
    got = survival.concordance(spark.createDataFrame(rows, "duration double, event int, x double"), F.col("x"), ranges=ranges).first()
    assert got["pairs"] == pair.sum() and got["concordance"] == pytest.approx(good / pair.sum(), abs=1e-6)


def test_concordance_without_pairs(spark):
    got = survival.concordance(spark.createDataFrame([], "duration double, event int, x double"), F.col("x")).first()
    assert got["pairs"] == 0 and got["concordance"] is None


@pytest.mark.parametrize("family", survival.AFT_FAMILIES)
def test_aft_stops_at_a_maximum(frame, family):
    m = survival.fit_aft(frame, ["x", "z"], family)
    ll, grad, hess = survival._aft_sums(frame, ["x", "z"], family, m.coef, m.log_scale)
    assert np.max(np.abs(grad)) < 1e-3 and np.all(np.linalg.eigvalsh(hess) < 0)
    for i in range(3):  # the analytic gradient is the numeric one
        for at, sign in ((m.coef + np.eye(3)[i] * 1e-4, 1), (m.coef - np.eye(3)[i] * 1e-4, -1)):
            assert survival._aft_sums(frame, ["x", "z"], family, at, m.log_scale)[0] <= ll
    assert m.coef[1] < 0  # risk raised by x shortens the time


def test_proportional_hazards_and_residuals(spark, frame):
    m = survival.fit_cox(frame, ["x", "z"], penalizer=0.0)
    res = survival.schoenfeld_residuals(m, frame)
    assert res.count() == frame.filter("event = 1").count()
    assert res.agg(F.sum("resid_x")).first()[0] == pytest.approx(0.0, abs=1e-4)
    assert all(0 <= r["p_value"] <= 1 for r in survival.proportional_hazards_test(spark, m).collect())


def test_median_and_all_churned_stratum(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("b", 3.0, 0), ("b", 4.0, 0)], "s string, duration double, event long")
    curve = survival.kaplan_meier(df, ["s"])
    last = curve.filter("s = 'a' and duration = 2.0").first()
    assert last["survival"] == 0.0
    assert {r["s"]: r["median"] for r in survival.median_survival(curve, ["s"]).collect()} == {"a": 1.0, "b": math.inf}


def test_ltv_bounds(spark):
    step = spark.createDataFrame([(99.0, 1.0)], "duration double, hazard double")
    flat = survival.CoxModel(["x"], np.array([0.0]), np.array([0.0]), step)
    df = spark.createDataFrame([("m", 119.9, 0.0), ("n", None, 0.0)], "member_id string, monthly_price double, x double")
    got = {r["member_id"]: r["ltv"] for r in ltv.estimate_ltv(df, flat, 0.01, 12).collect()}
    assert 0.9 * 1438.8 < got["m"] < 1438.8 and got["n"] is None
    assert ltv.estimate_ltv(df, flat, 0.01, 12, fill_price="median").filter("ltv is null").count() == 0
    with pytest.raises(DataError):
        ltv.segment_ltv(df)


def test_p_values(spark):
    zs = [0.0, 0.3, 1.0, 1.96, 3.2, 5.0, 7.9, 12.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", two_sided_p(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(p_of_z(r["z"]), abs=1e-13)


def test_tiers_and_thresholds(spark):
    df = spark.createDataFrame([(0.2,), (0.25,), (0.5,), (0.8,)], "p double")
    assert [r[0] for r in df.select(churn.fixed_tier(F.col("p"))).collect()] == ["medium", "medium", "high", "critical"]
    assert [r[0] for r in df.select(churn.fixed_tier(F.col("p"), (0.25, 0.5, 0.75), True)).collect()] == ["low", "low", "medium", "critical"]
    assert [r[0] for r in df.select(churn.relative_tier(F.col("p"), 0.5)).collect()] == ["low", "low", "high", "high"]
    assert churn.threshold_value(df, "p", "p", "something else") == 0.5
    one = spark.createDataFrame([(1, 0.5)], "y int, p double")
    with pytest.raises(DataError):
        churn.check_training_input(one, one, "y")


def test_psi_of_a_constant_and_of_itself(spark):
    const = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert monitor.psi(const, const, "v").first()["psi"] == 0.0
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    assert monitor.psi(df, df, "v").first()["psi"] == 0.0
    moved = df.select((F.col("v") + 50).alias("v"))
    r = monitor.psi(df, moved, "v").first()
    assert r["psi"] > 0.2 and r["n_out_of_range"] == 50


# ---- causal ----------------------------------------------------------------------------------

SPEC = CausalSpec("t", "y", ("x", "w"), ())


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(11)
    n = 4000
    x, w = rng.normal(size=n), rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(float)
    y = 2.0 * t + 1.5 * x - w + np.where(x > 0, 1.0, -1.0) * t + rng.normal(size=n)
    return spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(zip(x, w, t, y))], "member_id long, x double, w double, t double, y double").cache()


def test_adjusted_effects_recover_the_truth(study):
    naive = causal.naive_difference(study, "t", "y").first()["effect"]
    assert naive > 2.8
    for method in ("linear_regression", "propensity_score_weighting", "propensity_score_matching"):
        e = causal.estimate_ate(study, SPEC, method)
        assert abs(e.effect - 2.0) < 0.35, method
        low, high = e.bounds()
        assert low < e.effect < high and e.p_value < 1e-6
    with pytest.raises(DataError):
        causal.estimate_ate(study, SPEC, "other")
    with pytest.raises(DataError):
        causal.check_spec(CausalSpec("t", "y", ("nope",)), study)


def test_ols_equals_numpy(study):
    rows = study.collect()
    a = np.array([[1.0, r["t"], r["x"], r["w"]] for r in rows])
    y = np.array([r["y"] for r in rows])
    beta, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = causal.linear_ate(study, "t", "y", ["x", "w"])
    assert e.effect == pytest.approx(beta[1], abs=1e-9)
    assert e.std_error == pytest.approx(math.sqrt(rss[0] / (len(y) - 4) * np.linalg.inv(a.T @ a)[1, 1]), rel=1e-9)


@pytest.mark.parametrize("method", refute.METHODS)
def test_replicates_do_not_depend_on_partitions(study, method):
    a = refute.replicate_effects(study.coalesce(1), "member_id", SPEC, method, 20, "bootstrap")
    b = refute.replicate_effects(study.repartition(6), "member_id", SPEC, method, 20, "bootstrap")
    assert np.allclose(a, b, atol=1e-7) and a.std() > 0 and abs(a.mean() - 2.0) < 0.35


def test_permutation_keeps_counts_and_breaks_the_link(study):
    p = refute.permuted(study, "member_id", "t")
    assert p.count() == study.count()
    assert p.agg(F.sum("t")).first()[0] == study.agg(F.sum("t")).first()[0]
    assert abs(causal.linear_ate(p, "t", "y", ["x", "w"]).effect) < 0.25


@pytest.mark.parametrize("method", refute.METHODS)
def test_refutation_report(study, method):
    """Every test refutes the estimate that was made: its original effect is that method's."""
    got = {r["test_name"]: r for r in refute.refute(study, "member_id", SPEC, method, placebo_limit=0.25, replicates=20).collect()}
    assert len(got) == 4 and all(r["passed"] for r in got.values()), got
    assert {r["original_effect"] for r in got.values()} == {got["bootstrap"]["original_effect"]}
    assert got["bootstrap"]["original_effect"] == pytest.approx(causal.estimate_ate(study, SPEC, method).effect, abs=2e-3)


@pytest.fixture
def observed(spark, study):
    """The study in a session that has seen an observation, which cannot be sent to tasks any more."""
    session = spark.newSession()
    session.range(3).observe(Observation(), F.count(F.lit(1)).alias("n")).collect()
    return session.createDataFrame([tuple(r) for r in study.collect()], study.schema)


def test_weighting_in_an_observed_session(observed):
    """Scores and effect against Newton's method in NumPy."""
    a, t, y = (np.array([tuple(r) for r in observed.select(*c).collect()]) for c in (["x", "w"], ["t"], ["y"]))
    a, t, y = np.column_stack([np.ones(len(a)), a]), t[:, 0], y[:, 0]
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ beta))
        beta += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a, a.T @ (t - p))
    got = np.array([r[0] for r in causal.propensity(observed, "t", ["x", "w"]).select("propensity").collect()])
    assert np.allclose(got, p, atol=1e-4)
    q = np.clip(p, 0.01, 0.99)
    one, two = t / q, (1 - t) / (1 - q)
    assert causal.estimate_ate(observed, SPEC).effect == pytest.approx((one @ y) / one.sum() - (two @ y) / two.sum(), abs=1e-3)


def test_matching_in_an_observed_session(observed, study):
    """The scores are the same as in a session that has seen nothing, and matching on them gives what brute force gives."""
    scored = causal.propensity(observed, "t", ["x", "w"])
    rows = np.array([tuple(r) for r in scored.select("t", "y", "propensity").collect()])
    effects = []
    for t, y, p in rows:
        other = rows[rows[:, 0] != t]
        gap = np.abs(other[:, 2] - p)
        near = other[gap == gap.min()]
        near = near[near[:, 2] == near[:, 2].min()]  # the lower score on equal distance
        effects.append((1 if t else -1) * (y - near[:, 1].mean()))
    got = causal.matched_ate(scored, "t", "y").first()
    assert got["effect"] == pytest.approx(np.mean(effects), abs=1e-6) and got["n"] == len(rows)
    assert got["effect"] == pytest.approx(causal.estimate_ate(study, SPEC, "propensity_score_matching").effect, abs=1e-6)


@pytest.mark.parametrize("method", refute.METHODS[1:])
def test_refutation_report_in_an_observed_session(observed, study, method):
    """The placebo test fits a model of its own; its row is that of a session that has seen nothing."""
    a, b = (refute.refute(df, "member_id", SPEC, method, tests=["placebo_treatment"]).first() for df in (observed, study))
    assert a["refuted_effect"] == pytest.approx(b["refuted_effect"], abs=1e-6) and abs(a["refuted_effect"]) < 0.25
    assert a["p_value"] == pytest.approx(b["p_value"], abs=1e-4) and a["details"] == b["details"]


def test_replicated_fits_match_plain_ones(spark):
    """Propensity models and effects of weighted replicates against Newton's method and matching in plain NumPy."""
    rng = np.random.default_rng(4)
    n = 300
    x = rng.normal(size=(n, 2)).round(1) * [1.0, 30.0]
    t = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    y = t + x[:, 0] + rng.normal(size=n)
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(np.column_stack([x, t, y]))], "member_id long, x double, w double, t double, y double")
    for kind in ("all", "subset", "bootstrap"):
        scores = refute.Scores(df, "member_id", "t", "y", ["x", "w"], 3, kind, 0.8, 42)
        beta = scores.fit()
        hashes = np.array([r[0] for r in df.orderBy("member_id").select(causal.row_hash("member_id")).collect()])
        weight = causal.replicate_weights(hashes, 3, kind, 0.8, 42)
        z = np.column_stack([np.ones(n), (x - x.mean(0)) / x.std(0)])
        hajek, match = scores.weighted_effects(beta), scores.matched_effects(beta)
        scores.close()
        for k in range(3):
            w, b, pen = weight[:, k], np.zeros(3), np.diag([0.0, 1e-6, 1e-6]) * weight[:, k].sum()
            for _ in range(30):
                p = 1 / (1 + np.exp(-z @ b))
                b = b + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + pen, z.T @ (w * (t - p)) - pen @ b)
            assert np.allclose(beta[k], b, atol=1e-7)
            p = 1 / (1 + np.exp(-z @ beta[k]))
            c = np.clip(p, 0.01, 0.99)
            one, two = w * t / c, w * (1 - t) / (1 - c)
            assert hajek[k] == pytest.approx(one @ y / one.sum() - two @ y / two.sum(), abs=1e-9)
            q, total = p.round(12), 0.0
            for i in np.flatnonzero(w):
                other = (t != t[i]) & (w > 0)
                g = min(set(q[other]), key=lambda v: (abs(v - q[i]), v))
                at = other & (q == g)
                total += w[i] * (y[i] - (w[at] @ y[at]) / w[at].sum()) * (1 if t[i] else -1)
            assert match[k] == pytest.approx(total / w.sum(), abs=1e-9)


def test_members_with_equal_covariates_match_as_one_score(spark):
    """Members with equal covariates are averaged together, also those alone in a batch, whose matrix product sums in another order."""
    rng = np.random.default_rng(11)
    n, r = 2001, 4
    x = rng.integers(0, 2, size=(n, 6)) * [1.0, 30.0, 0.3, 7.0, 0.01, 1.0]
    t = (rng.random(n) < 1 / (1 + np.exp(x[:, 0] - 0.5))).astype(float)
    y = (rng.random(n) < 0.3 + 0.2 * x[:, 0]).astype(float)
    names = [f"x{i}" for i in range(6)]
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    df = session.createDataFrame([(i, *map(float, v)) for i, v in enumerate(np.column_stack([x, t, y]))], "member_id long, " + ", ".join(f"{c} double" for c in (*names, "t", "y")))
    hashes = np.array([v[0] for v in df.orderBy("member_id").select(causal.row_hash("member_id")).collect()])
    weight = causal.replicate_weights(hashes, r, "bootstrap", 0.8, 42)
    cells, cell = np.unique(x, axis=0, return_inverse=True)
    scores = refute.Scores(df.repartition(40), "member_id", "t", "y", names, r, "bootstrap", 0.8, 42)
    beta = scores.fit()
    got = scores.matched_effects(beta)
    scores.close()
    p = 1 / (1 + np.exp(-(np.column_stack([np.ones(len(cells)), (cells - x.mean(0)) / x.std(0)]) @ beta.T)))
    for k in range(r):
        w, total = weight[:, k], 0.0
        arm = {a: (np.bincount(cell, w * (t == a), len(cells)), np.bincount(cell, w * (t == a) * y, len(cells))) for a in (0, 1)}
        for a, sign in ((1, 1), (0, -1)):
            own, other = arm[a], arm[1 - a]
            some = np.flatnonzero(other[0])
            for c in np.flatnonzero(own[0]):
                at = some[np.abs(p[some, k] - p[c, k]).argmin()]
                total += sign * (own[1][c] - own[0][c] * other[1][at] / other[0][at])
        assert got[k] == pytest.approx(total / w.sum(), abs=1e-9)


def test_a_test_that_cannot_run_is_a_failed_row(spark):
    df = spark.createDataFrame([(i, float(i % 2), 1.0, 0.0) for i in range(10)], "member_id long, x double, t double, y double")
    with pytest.raises(DataError):
        refute.refute(df, "member_id", CausalSpec("t", "y", ("x",), ()), "other")
    ok = spark.createDataFrame([(i, float(i), float(i in (10, 30)), float(i % 3)) for i in range(40)],  # some draws have nobody treated
                               "member_id long, x double, t double, y double")
    got = refute.refute(ok, "member_id", CausalSpec("t", "y", ("x",), ()), "propensity_score_weighting", tests=["bootstrap"]).first()
    assert got["passed"] is False and got["details"].startswith("failed with")


def test_effect_forest_finds_the_split(study):
    m = forest.fit_effect_forest(study, "member_id", SPEC, ["x", "w"], trees=20, depth=4, min_leaf=30, folds=2, rounds=15)
    assert m.predict(study).count() == study.count()
    e = m.predict(study).join(study, "member_id").groupBy((F.col("x") > 0).alias("up")).agg(F.avg("cate_mean").alias("e")).collect()
    by = {r["up"]: r["e"] for r in e}
    assert by[True] - by[False] > 1.0 and abs(m.average - 2.0) < 0.5
    assert m.importance(study.sparkSession).first()["feature"] == "x"


def test_trees_are_those_of_a_plain_search(spark):
    """Splits, leaf members and leaf effects of every tree against a search in NumPy over the same bins and halves."""
    rng = np.random.default_rng(6)
    n = 900
    x = np.column_stack([rng.normal(size=n).round(2), rng.integers(0, 4, n)])
    rt = rng.normal(size=n)
    rt[:300] *= 1e-5  # treatment residuals near zero stay in
    ry = rt * np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in enumerate(np.column_stack([x, ry, rt]))], "member_id long, a double, b double, ry double, rt double").repartition(3)
    m = forest.grow_forest(df, "member_id", ["a", "b"], trees=4, depth=3, min_leaf=20, seed=5)
    h = np.array([r[0] for r in df.orderBy("member_id").select(causal.row_hash("member_id")).collect()])
    u = causal._uniforms(h, 4, 5)
    bins = np.column_stack([np.searchsorted(m.edges[j], x[:, j], side="left") for j in range(2)])
    leaves = {(r["tree"], r["leaf"]): r for r in m.leaves.collect()}
    placed = {r["member_id"]: r["leaf"] for r in m.placed(df).collect()}
    score = lambda at: (rt[at] @ ry[at]) ** 2 / (rt[at] @ rt[at]) if len(at) else 0.0
    for t in range(4):
        grow, rest = u[:, t] < 0.25, (u[:, t] >= 0.25) & (u[:, t] < 0.5)
        assert not (grow & rest).any()
        todo = [(0, np.arange(n))]
        while todo:
            k, at = todo.pop()
            mine = at[grow[at]]
            best = (0.0,)
            if k < 7 and len(mine) >= 40:
                for j in range(2):
                    for cut in range(forest.BINS - 1):
                        lo, hi = mine[bins[mine, j] <= cut], mine[bins[mine, j] > cut]
                        if min(len(lo), len(hi)) >= 20:
                            best = max(best, (score(lo) + score(hi) - score(mine), j, cut), key=lambda b: b[0])
            if len(best) > 1:
                assert m.shape.feature[t, k] >= 0
                j, cut = m.shape.feature[t, k], m.shape.bin[t, k]
                lo, hi = mine[bins[mine, j] <= cut], mine[bins[mine, j] > cut]
                assert score(lo) + score(hi) - score(mine) == pytest.approx(best[0], rel=1e-9)
                todo += [(2 * k + 1, at[bins[at, j] <= cut]), (2 * k + 2, at[bins[at, j] > cut])]
                continue
            assert m.shape.feature[t, k] < 0 and all(placed[int(i)][t] == k for i in at)
            node = k
            inside = lambda node: np.array([i for i in range(n) if rest[i] and (lambda q: any(((q + 1) >> d) - 1 == node for d in range(5)))(placed[i][t])], int)  # noqa: B023, E731
            while node and len(inside(node)) < 10:
                node = (node - 1) // 2
            rows = inside(node)
            effect = (rt[rows] @ ry[rows]) / (rt[rows] @ rt[rows])
            assert leaves[t, k]["node"] == node and leaves[t, k]["effect"] == pytest.approx(effect, rel=1e-9)
    got = {r["member_id"]: r["cate_mean"] for r in m.predict(df).collect()}
    assert len(got) == n and all(got[i] == pytest.approx(np.mean([leaves[t, placed[i][t]]["effect"] for t in range(4)]), rel=1e-9) for i in range(0, n, 37))


def test_forest_results_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    df = spark.range(600).select(F.col("id").alias("member_id"), (F.col("id") % 13 / 13.0).alias("a"), F.sin(F.col("id")).alias("rt"), (F.sin(F.col("id")) * F.when(F.col("id") % 13 > 6, 2.0).otherwise(0.5)).alias("ry"))
    one = forest.grow_forest(df.coalesce(1), "member_id", ["a"], trees=6, depth=3, min_leaf=15)
    monkeypatch.setattr(forest, "SUMS", 2000)
    two = forest.grow_forest(df.repartition(5), "member_id", ["a"], trees=6, depth=3, min_leaf=15)
    assert (one.shape.feature == two.shape.feature).all() and (one.shape.bin == two.shape.bin).all()


def test_missing_features_keep_their_members(spark, study):
    holes = study.withColumn("x", F.when(F.col("member_id") % 10 != 0, F.col("x")))
    m = forest.fit_effect_forest(holes, "member_id", SPEC, ["x", "w"], trees=3, depth=2, min_leaf=30, folds=2, rounds=3)
    assert m.predict(holes).where("cate_mean is not null").count() == study.count()
    with pytest.raises(DataError):
        forest.grow_forest(study.select("member_id", "x", F.lit(0.0).alias("rt"), F.col("y").alias("ry")), "member_id", ["x"], trees=2)


def test_cross_fitted_trees_are_sparks_and_grow_together(spark, study):
    """Residuals equal those of Spark's boosted trees fold by fold, and all folds share a job per level (before: some jobs per level and model)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    df = study.withColumn("t", F.col("t").cast("double")).cache()
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    got = {r["member_id"]: r for r in forest.residuals(df, "member_id", "t", "y", ["x", "w"], folds=3, rounds=4, depth=3, min_leaf=10, seed=1).collect()}
    assert jobs() - before <= 4 * 3 + 12  # rounds times levels
    rows = VectorAssembler(inputCols=["x", "w"], outputCol="v").transform(df).withColumn("fold", F.pmod(causal.row_hash("member_id") + F.lit(1), F.lit(3)))
    shared = dict(featuresCol="v", maxIter=4, maxDepth=3, minInstancesPerNode=10, seed=1)
    for k in range(3):
        given = rows.where(F.col("fold") != k)
        y, t = GBTRegressor(labelCol="y", predictionCol="py", **shared).fit(given), GBTClassifier(labelCol="t", predictionCol="c", **shared).fit(given).setProbabilityCol("pt").setRawPredictionCol("raw")
        for r in t.transform(y.transform(rows.where(F.col("fold") == k))).select("member_id", (F.col("y") - F.col("py")).alias("ry"), (F.col("t") - vector_to_array("pt")[1]).alias("rt")).collect():
            assert got[r["member_id"]]["ry"] == pytest.approx(r["ry"], abs=1e-9) and got[r["member_id"]]["rt"] == pytest.approx(r["rt"], abs=1e-9)
    assert len(got) == df.count()


def test_a_forest_predicts_a_repeated_or_null_key_once(spark, study):
    m = forest.fit_effect_forest(study, "member_id", SPEC, ["x", "w"], trees=3, depth=2, min_leaf=30, folds=2, rounds=3)
    odd = study.unionByName(study.where("member_id < 5")).unionByName(study.where("member_id < 2").withColumn("member_id", F.lit(None).cast("long")))
    got = m.predict(odd)
    assert got.count() == study.count() + 1 and got.where("cate_mean is null or cate_std is null").count() == 0


def test_tenure_zero_belongs_to_no_group(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (3.1,), (24.0,), (25.0,)], "m double")
    assert [r[0] for r in df.select(causal.tenure_group(F.col("m"))).collect()] == [None, "0-3m", "3-6m", "12-24m", "24m+"]


# ---- allocation ------------------------------------------------------------------------------

ACTS = (Action("a", 1.0, 1.0), Action("b", 3.0, 5.0, ("regular",)))


def market(spark, n, seed, locations=2):
    rng = random.Random(seed)
    members = spark.createDataFrame([(i, f"l{i % locations}", rng.choice(["regular", "aggregator"]), float(rng.randrange(10, 100))) for i in range(n)],
                                    "member_id long, location_id string, contract_source string, ltv double")
    cate = spark.createDataFrame([(i, a, round(rng.random(), 3), 0.05) for i in range(n) for a in ("a", "b")],
                                 "member_id long, action string, cate_mean double, cate_std double")
    return members, cate


def brute_force(cands, limits):
    per = {}
    for r in cands:
        per.setdefault((r["member_id"], r["location_id"]), [None]).append(r)
    best = 0.0
    for pick in itertools.product(*per.values()):
        chosen = [p for p in pick if p is not None]
        if sum(c["cost"] for c in chosen) > limits.total_budget:
            continue
        locs = {c["location_id"] for c in chosen}
        if all(sum(c["cost"] for c in chosen if c["location_id"] == k) <= limits.max_per_location and
               sum(c["minutes"] for c in chosen if c["location_id"] == k) <= limits.staff_hours * 60 for k in locs):
            best = max(best, sum(c["value"] for c in chosen))
    return best


def feasible(rows, limits):
    assert len({r["member_id"] for r in rows}) == len(rows)
    assert sum(r["cost"] for r in rows) <= limits.total_budget + 1e-9
    for k in {r["location_id"] for r in rows}:
        mine = [r for r in rows if r["location_id"] == k]
        assert sum(r["cost"] for r in mine) <= limits.max_per_location + 1e-9
        assert sum(r["minutes"] for r in mine) <= limits.staff_hours * 60 + 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_allocation_against_brute_force(spark, seed):
    members, cate = market(spark, 8, seed)
    limits = Limits(total_budget=9.0, min_per_location=0.0, max_per_location=6.0, staff_hours=9 / 60)
    cands = allocate.candidates(members, cate, ACTS)
    s = allocate.solve(cands, limits)
    feasible(s.allocation.collect(), limits)
    best = brute_force(cands.collect(), limits)
    assert s.value <= best + 1e-9 <= s.bound + 1e-6
    assert s.value >= 0.8 * best


def test_large_allocation_is_nearly_optimal_and_keeps_the_floor(spark):
    members, cate = market(spark, 300, 5, 3)
    limits = Limits(total_budget=150.0, min_per_location=20.0, max_per_location=80.0, staff_hours=2.0)
    s = allocate.solve(allocate.candidates(members, cate, ACTS), limits, use_floor=True)
    rows = s.allocation.collect()
    feasible(rows, limits)
    assert s.gap < 0.05
    for k in range(3):
        assert sum(r["cost"] for r in rows if r["location_id"] == f"l{k}") >= 20.0
    base = allocate.uniform_baseline(allocate.candidates(members, cate, ACTS), 150.0).agg(F.sum("value")).first()[0]
    assert s.value >= base


def test_aggregator_members_get_no_restricted_action(spark):
    members, cate = market(spark, 40, 3)
    got = allocate.candidates(members, cate, ACTS).filter("contract_source = 'aggregator' and action = 'b'")
    assert got.count() == 0


def test_infeasible_limits(spark):
    members, cate = market(spark, 4, 1)
    cands = allocate.candidates(members, cate, ACTS)
    for bad in (Limits(5.0, 50.0, 100.0, 1.0), Limits(500.0, 50.0, 20.0, 1.0), Limits(500.0, 50.0, 100.0, 1.0)):
        with pytest.raises(InfeasibleError):
            allocate.solve(cands, bad, use_floor=True)


def test_scenarios(spark):
    _, cate = market(spark, 20, 4)
    a = allocate.sample_scenarios(cate, 5, 1)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(a) == rows(allocate.sample_scenarios(cate.repartition(5), 5, 1))
    assert rows(a) != rows(allocate.sample_scenarios(cate, 5, 2))
    assert a.count() == 5 * cate.count()
    r = a.agg(F.min("cate_realized"), F.max("cate_realized")).first()
    assert 0.0 <= r[0] and r[1] <= 1.0
    arrays = allocate.scenario_arrays(cate, 5, 1).select("member_id", "action", F.posexplode("draws").alias("scenario", "d"))
    assert arrays.join(a, ["member_id", "action", "scenario"]).filter("abs(d - cate_realized) > 1e-12").count() == 0


def test_hashes_of_many_keys_are_those_of_the_column(spark):
    """Also across block borders and for texts beyond one block; before, no code made the draws of a task at once."""
    from tenura.functions import hash_normal
    from tenura.functions.md5 import normals, units

    texts = ["", "7|x", "\u00e9|\u00fc", *["b" * k for k in range(44, 72)], *[f"{i}|call" for i in range(90, 111)]]
    u = units(texts, ["|3|42", "|49|7961"])
    assert all(u[i, j] == (int(hashlib.md5((t + e).encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i, t in enumerate(texts) for j, e in enumerate(["|3|42", "|49|7961"]))
    keys = spark.range(95, 105).select("id", F.lit("call").alias("a"), *[hash_normal("id", F.lit("call"), F.lit(s), seed=5).alias(f"s{s}") for s in range(3)])
    for r in keys.collect():
        assert list(normals([f"{r['id']}|call"], range(3), 5)[0]) == pytest.approx([r["s0"], r["s1"], r["s2"]], abs=1e-12)


def test_scenario_values_of_odd_members(spark):
    """Values are draws times ltv: 0 for an effect that is not known, null without an ltv; a repeated member keeps its rows. No draw has an expression of its own."""
    members = spark.createDataFrame([(1, 1, "regular", 10.0), (1, 1, "regular", 10.0), (2, 1, "regular", None), (3, 2, "regular", 5.0)], "member_id long, location_id long, contract_source string, ltv double")
    cate = spark.createDataFrame([(1, "low", 0.5, 0.1), (2, "low", 0.5, 0.1), (1, "mid", None, 0.1), (1, "high", 0.5, None)], "member_id long, action string, cate_mean double, cate_std double")
    acts = (Action("low", 1.0, 1.0, ("regular",)), Action("mid", 1.0, 1.0, ("regular",)), Action("high", 1.0, 1.0, ("regular",)))
    rows = allocate.stochastic_rows(members, cate, 4, 3, acts)
    got = {(r["member_id"], o["action"]): (o["values"], sum(x["action"] == o["action"] for x in r["options"])) for r in rows.collect() for o in r["options"]}
    draws = {(r["member_id"], r["action"], r["scenario"]): r["cate_realized"] for r in allocate.sample_scenarios(cate, 4, 3).collect()}
    for action in ("low", "mid", "high"):
        assert got[1, action][0] == pytest.approx([10.0 * draws[1, action, s] for s in range(4)], abs=1e-9) and got[1, action][1] == 4
    assert got[2, "low"][0] == [None] * 4 and got[3, "low"][0] == [0.0] * 4
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # before, as few as the rows that moved allowed


def test_stochastic_values_are_consistent(spark):
    members, cate = market(spark, 60, 9)
    limits = Limits(total_budget=40.0, min_per_location=2.0, max_per_location=30.0, staff_hours=1.0)
    rows = allocate.stochastic_rows(members, cate, 6, 3, ACTS)
    s = allocate.solve_stochastic(rows, 6, 0.5, limits, rounds=2)
    feasible(s.allocation.collect(), limits)
    assert s.objective <= s.bound + 1e-6
    got = allocate.evaluate_scenarios(s.allocation, allocate.sample_scenarios(cate, 6, 3), members).first()
    assert got["expected_mrr"] == pytest.approx(sum(s.scenario_values) / 6, abs=1e-3)
    assert got["robust_gap"] == pytest.approx(s.robust_gap, abs=1e-3)


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_matching_equals_brute_force(spark, ranges):
    rng = np.random.default_rng(11)
    n = 120
    p = np.where(rng.random(n) < 0.3, 0.375, rng.random(n).round(2))
    t, y = (rng.random(n) < p).astype(int), rng.normal(size=n)
    nearest = lambda i, arm: (lambda c: p == c)(min(set(p[t == arm]), key=lambda v: (abs(v - p[i]), v))) & (t == arm)
    gain, k, k2, var = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        m = nearest(i, 1 - t[i])
        gain[i] = (y[i] - y[m].mean()) * (1 if t[i] else -1)
        k += m / m.sum()
        k2 += m / m.sum() ** 2
        same = (t == t[i]) & (p == p[i])
        if same.sum() > 1:
            var[i] = y[same].var(ddof=1)
        else:
            other = (t == t[i]) & (p != p[i])
            c = (t == t[i]) & (p == min(set(p[other]), key=lambda v: (abs(v - p[i]), v)))
            var[i] = (y[i] - y[c].mean()) ** 2 * c.sum() / (c.sum() + 1)
    se = math.sqrt(((gain - gain.mean()) ** 2).sum() + ((k**2 + 2 * k - k2) * var).sum()) / n
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(t, y, p)], "t int, y double, propensity double")
    got = causal.matched_ate(df, "t", "y", ranges=ranges).first()
    assert got["n"] == n and got["effect"] == pytest.approx(gain.mean(), abs=1e-7)
    assert got["effect_on_treated"] == pytest.approx(gain[t == 1].mean(), abs=1e-7) and got["std_error"] == pytest.approx(se, abs=1e-7)
