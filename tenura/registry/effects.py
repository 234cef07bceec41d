"""Causal effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.config import TENURE_LABELS, CausalSpec
from tenura.functions import round_dec
from tenura.operators import causal, features
from tenura.operators.forest import fit_effect_forest, leaf_effects
from tenura.registry.base import ACT, R, TREF, VIS, once, query, silver_actions, silver_visits
from tenura.registry.views import REF

X = ("visit_frequency", "tenure_months", "plan_price", "location_churn_rate", "enrollment_month", "payment_delay_flag")
SPEC = CausalSpec(outcome="churned_30d", confounders=X, modifiers=("tenure_months", "contract_source", "plan_type"))


def cframe(t):
    late = features.financial_features(t.members, t.transactions, REF, late_days=365)
    return causal.treatment_frame(t.members, silver_visits(t), silver_actions(t), late, REF)


CF = f"""cf AS (SELECT m.member_id, m.location_id, contract_source, plan_type, CAST(churned AS BIGINT) AS churned_30d, COALESCE(vf.n, 0) AS visit_frequency,
  GREATEST(date_diff('day', join_date, COALESCE(cancel_date, {TREF})) / 30.0::DOUBLE, 0) AS tenure_months, monthly_price AS plan_price, lc.r AS location_churn_rate,
  month(join_date) AS enrollment_month, COALESCE(late.f, 0) AS payment_delay_flag, CAST(a.at IS NOT NULL AS BIGINT) AS retention_action_taken,
  COALESCE(a.at, 'none') AS action_type, COALESCE(a.c, 0) AS action_cost FROM members m
  LEFT JOIN (SELECT member_id, ARG_MIN(action_type, (action_date, action_id)) AS at, SUM(cost) AS c FROM act GROUP BY 1) a USING (member_id)
  LEFT JOIN (SELECT member_id, COUNT(*) AS n FROM vis JOIN members USING (member_id) WHERE date_diff('day', visit_date, COALESCE(cancel_date, {TREF})) BETWEEN 0 AND 30 GROUP BY 1) vf USING (member_id)
  LEFT JOIN (SELECT member_id, MAX(CAST(is_late AND txn_date >= {TREF} - INTERVAL 365 DAY AS BIGINT)) AS f FROM transactions WHERE txn_date < {TREF} GROUP BY 1) late USING (member_id)
  LEFT JOIN (SELECT location_id, AVG(CAST(churned AS DOUBLE)) AS r FROM members GROUP BY 1) lc ON lc.location_id = m.location_id)"""
BASE = (VIS, ACT, CF)


def rounded(df, cols, digits=6):
    return df.withColumns({c: round_dec(F.col(c), digits) for c in cols})


@query("cau1_checked_frame", "SELECT member_id, retention_action_taken, churned_30d, " + ", ".join(R(c, 6) + f" AS {c}" for c in X) + " FROM cf", *BASE)
def _(t):
    df = cframe(t)
    spec = causal.check_spec(SPEC, df)
    return rounded(df.select("member_id", spec.treatment, spec.outcome, *spec.confounders), X)


@query("cau2_segment_effect", """SELECT contract_source, COUNT(*) AS n, COUNT(*) FILTER (WHERE retention_action_taken = 1) AS treated FROM cf
WHERE contract_source = 'aggregator' AND action_type NOT IN ('discount_offer', 'plan_upgrade') GROUP BY 1""", *BASE)
def _(t):
    _, rows = causal.for_segment(SPEC, cframe(t), "aggregator")
    return rows.groupBy("contract_source").agg(F.count("*").alias("n"), F.count_if(F.col("retention_action_taken") == 1).alias("treated"))


@query("cau3_treatment_frame", "SELECT * REPLACE (" + ", ".join(f"{R(c, 6)} AS {c}" for c in ("tenure_months", "location_churn_rate")) + ") FROM cf", *BASE)
def _(t):
    return rounded(cframe(t), ["tenure_months", "location_churn_rate"])


def smd_sql(c: str) -> str:
    return f"""SELECT '{c}' AS variable, {R("mt", 6)} AS treated_mean, {R("mc", 6)} AS control_mean, {R("st", 6)} AS treated_std, {R("sc", 6)} AS control_std,
{R("(mt - mc) / sqrt((st * st + sc * sc) / 2)", 6)} AS smd, ABS((mt - mc) / sqrt((st * st + sc * sc) / 2)) > 0.1 AS imbalanced FROM (SELECT AVG({c}) FILTER (WHERE retention_action_taken = 1) AS mt,
AVG({c}) FILTER (WHERE retention_action_taken = 0) AS mc, STDDEV_SAMP({c}) FILTER (WHERE retention_action_taken = 1) AS st, STDDEV_SAMP({c}) FILTER (WHERE retention_action_taken = 0) AS sc FROM cf)"""


@query("cau4_balance", " UNION ALL ".join(smd_sql(c) for c in X), *BASE)
def _(t):
    return causal.balance(cframe(t), "retention_action_taken", X)


@query("cau5_naive_difference", f"SELECT {R('AVG(churned_30d) FILTER (WHERE retention_action_taken = 1) - AVG(churned_30d) FILTER (WHERE retention_action_taken = 0)', 8)} AS effect FROM cf", *BASE)
def _(t):
    return causal.naive_difference(cframe(t), "retention_action_taken", "churned_30d")


def cov(a: str, b: str) -> str:
    return f"covar_pop({a}, {b})"


# Regression on the treatment and two confounders by determinants of the covariances.
OLS3 = (f"""cv AS (SELECT {cov('a', 'a')} AS aa, {cov('a', 'b')} AS ab, {cov('a', 'c')} AS ac, {cov('b', 'b')} AS bb, {cov('b', 'c')} AS bc, {cov('c', 'c')} AS cc,
  {cov('a', 'y')} AS ay, {cov('b', 'y')} AS yb, {cov('c', 'y')} AS cy, {cov('y', 'y')} AS yy, COUNT(*) AS n FROM
  (SELECT CAST(retention_action_taken AS DOUBLE) AS a, CAST(visit_frequency AS DOUBLE) AS b, tenure_months AS c, CAST(churned_30d AS DOUBLE) AS y FROM cf))""",
        """dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS d FROM cv)""",
        """bt AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / d AS t1,
  (aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / d AS t2,
  (aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / d AS t3 FROM dt)""",
        """et AS (SELECT t1 AS effect, sqrt((yy - t1 * ay - t2 * yb - t3 * cy) * n / (n - 4) * (bb * cc - bc * bc) / d / n) AS se, n FROM bt)""")


@query("cau6_linear_ate", f"SELECT {R('effect', 6)} AS effect, {R('se', 6)} AS std_error, n FROM et", *BASE, *OLS3)
def _(t):
    e = causal.linear_ate(cframe(t), "retention_action_taken", "churned_30d", ["visit_frequency", "tenure_months"])
    return rounded(e.to_df(t.spark).select("effect", "std_error", "n"), ["effect", "std_error"])


@query("cau7_weighted_ate")
def _(t):
    return causal.estimate_ate(cframe(t), SPEC).to_df(t.spark)


# With a given score the weighting and the matching can be stated in SQL.
GIVEN = "gp AS (SELECT member_id, churned_30d AS y, retention_action_taken AS t, 0.05::DOUBLE + 0.9::DOUBLE * ((member_id * 7919) % 1000) / 1000.0::DOUBLE AS p FROM cf)"


def given(t):
    return cframe(t).withColumn("propensity", F.lit(0.05) + F.lit(0.9) * ((F.col("member_id") * 7919) % 1000) / 1000.0)


@query("cau7_weighted_ate_given_scores", f"""SELECT {R("m1 - m0", 6)} AS effect, {R("sqrt(v1 + v0)", 6)} AS std_error FROM (SELECT m1, m0, SUM(CASE WHEN t = 1 THEN (y - m1) * (y - m1) / (p * p) END) / (w1 * w1) AS v1,
SUM(CASE WHEN t = 0 THEN (y - m0) * (y - m0) / ((1 - p) * (1 - p)) END) / (w0 * w0) AS v0 FROM gp, (SELECT SUM(CASE WHEN t = 1 THEN y / p END) / SUM(CASE WHEN t = 1 THEN 1 / p END) AS m1,
SUM(CASE WHEN t = 0 THEN y / (1 - p) END) / SUM(CASE WHEN t = 0 THEN 1 / (1 - p) END) AS m0, SUM(CASE WHEN t = 1 THEN 1 / p END) AS w1, SUM(CASE WHEN t = 0 THEN 1 / (1 - p) END) AS w0 FROM gp) GROUP BY m1, m0, w1, w0)""", *BASE, GIVEN)
def _(t):
    e = causal.weighted_ate(given(t), "retention_action_taken", "churned_30d")
    return rounded(e.to_df(t.spark).select("effect", "std_error"), ["effect", "std_error"])


@query("cau8_matched_ate_given_scores", f"""SELECT {R("SUM(CASE WHEN a.t = 1 THEN a.y - b.y ELSE b.y - a.y END) / COUNT(*)", 6)} AS effect, {R("SUM(CASE WHEN a.t = 1 THEN a.y - b.y END) / COUNT(*) FILTER (WHERE a.t = 1)", 6)} AS effect_on_treated, COUNT(*) AS n
FROM (SELECT x.member_id, x.t, CAST(x.y AS DOUBLE) AS y, ARG_MIN(g.t2y, (ABS(x.p - g.p), g.p)) AS my FROM gp x JOIN gavg g ON g.t = 1 - x.t GROUP BY ALL) a JOIN (SELECT 1) ON TRUE JOIN LATERAL (SELECT a.my AS y) b ON TRUE""",
       *BASE, GIVEN, "gavg AS (SELECT t, p, AVG(CAST(y AS DOUBLE)) AS t2y FROM gp GROUP BY 1, 2)")
def _(t):
    return rounded(causal.matched_ate(given(t), "retention_action_taken", "churned_30d").drop("std_error"), ["effect", "effect_on_treated"])


@query("cau8_matched_ate")
def _(t):
    scored = causal.propensity(cframe(t), SPEC.treatment, list(X))
    return causal.matched_ate(scored, SPEC.treatment, SPEC.outcome)


@query("cau9_interval", f"SELECT {R('effect', 6)} AS effect, {R('effect - 1.959963984540054 * se', 6)} AS ci_lower, {R('effect + 1.959963984540054 * se', 6)} AS ci_upper FROM et", *BASE, *OLS3)
def _(t):
    e = causal.linear_ate(cframe(t), "retention_action_taken", "churned_30d", ["visit_frequency", "tenure_months"])
    return rounded(e.to_df(t.spark).select("effect", "ci_lower", "ci_upper"), ["effect", "ci_lower", "ci_upper"])


FOREST = ["visit_frequency", "tenure_months", "plan_price", "location_churn_rate", "enrollment_month", "payment_delay_flag",
          "contract_source_code", "plan_type_code"]


def forest(t):
    """The forest at its default settings."""
    df = features.category_codes(cframe(t), ["contract_source", "plan_type"])
    return df, once(t, "forest", lambda: fit_effect_forest(df, "member_id", SPEC, FOREST))


@query("cau15_effect_forest")
def _(t):
    _, m = forest(t)
    return t.spark.createDataFrame([(m.average, len(m.shape.feature), len(m.features), m.leaves.count())], "average_effect double, trees bigint, features bigint, leaves bigint")


# Leaf effects from given residuals in two given trees: a root split by source and then by tenure, and one by plan and price.
LEAF_ROWS = 150
GIVEN_NODES = """gn AS (SELECT churned_30d - 0.3::DOUBLE AS ry, retention_action_taken - (CASE WHEN contract_source = 'regular' THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END) AS rt, 0 AS tree,
  CASE WHEN contract_source = 'regular' THEN CASE WHEN tenure_months <= 30 THEN 3 ELSE 4 END ELSE CASE WHEN tenure_months <= 50 THEN 5 ELSE 6 END END AS node FROM cf
UNION ALL SELECT churned_30d - 0.3::DOUBLE, retention_action_taken - (CASE WHEN contract_source = 'regular' THEN 0.25::DOUBLE ELSE 0.15::DOUBLE END), 1,
  CASE WHEN plan_type = 'standard' THEN 1 ELSE CASE WHEN COALESCE(plan_price, 0) <= 60 THEN 5 ELSE 6 END END FROM cf),
gl AS (SELECT tree, node, COUNT(*) AS n, SUM(rt * rt) AS tt, SUM(rt * ry) AS ty, SUM(rt * ry * rt * ry) AS yy, SUM(rt * ry * rt * rt) AS yt, SUM(rt * rt * rt * rt) AS t4 FROM gn GROUP BY 1, 2),
ga AS (SELECT l.tree, l.node AS leaf, a.anc FROM (SELECT * FROM (VALUES (0, 3), (0, 4), (0, 5), (0, 6), (1, 1), (1, 5), (1, 6)) v(tree, node)) l JOIN (VALUES (0, 0), (1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (3, 1), (3, 3),
  (4, 0), (4, 1), (4, 4), (5, 0), (5, 2), (5, 5), (6, 0), (6, 2), (6, 6)) a(node, anc) ON a.node = l.node),
gs AS (SELECT ga.tree, anc, SUM(n) AS n, SUM(tt) AS tt, SUM(ty) AS ty, SUM(yy) AS yy, SUM(yt) AS yt, SUM(t4) AS t4 FROM ga JOIN gl ON gl.tree = ga.tree AND gl.node = ga.leaf GROUP BY 1, 2),
gf AS (SELECT ga.tree, ga.leaf, gs.*EXCLUDE (tree), ROW_NUMBER() OVER (PARTITION BY ga.tree, ga.leaf ORDER BY gs.anc DESC) AS rn FROM ga JOIN gs ON gs.tree = ga.tree AND gs.anc = ga.anc WHERE tt > 0 AND (n >= 150 OR gs.anc = 0))"""


@query("cau15_leaf_effects", f"SELECT tree, leaf, anc AS node, {R('ty / tt', 6)} AS effect, {R('(yy - 2 * ty / tt * yt + ty / tt * ty / tt * t4) / (tt * tt)', 6)} AS variance FROM gf WHERE rn = 1", *BASE, GIVEN_NODES)
def _(t):
    source, months = F.col("contract_source"), F.col("tenure_months")
    rt = F.col("retention_action_taken") - F.when(source == "regular", 0.25).otherwise(0.15)
    first = F.when(source == "regular", F.when(months <= 30, 3).otherwise(4)).otherwise(F.when(months <= 50, 5).otherwise(6))
    second = F.when(F.col("plan_type") == "standard", 1).otherwise(F.when(F.coalesce("plan_price", F.lit(0.0)) <= 60, 5).otherwise(6))
    rows = cframe(t).select((F.col("churned_30d") - F.lit(0.3)).alias("ry"), rt.alias("rt"), F.posexplode(F.array(first, second)).alias("tree", "node"))
    ty, tt = F.col("rt") * F.col("ry"), F.col("rt") * F.col("rt")
    sums = rows.groupBy("tree", "node").agg(F.count("*").alias("n"), F.sum(tt).alias("tt"), F.sum(ty).alias("ty"), F.sum(ty * ty).alias("yy"), F.sum(ty * tt).alias("yt"), F.sum(tt * tt).alias("t4"))
    leaves = t.spark.createDataFrame([(0, 3), (0, 4), (0, 5), (0, 6), (1, 1), (1, 5), (1, 6)], "tree int, leaf int")
    return rounded(leaf_effects(sums, leaves, LEAF_ROWS), ["effect", "variance"])


@query("cau16_member_effects")
def _(t):
    df, m = forest(t)
    return m.predict(df)


@query("cau16_effect_properties", "SELECT member_id, TRUE AS has_effect, TRUE AS inside_interval, TRUE AS std_from_interval FROM cf", *BASE)
def _(t):
    df, m = forest(t)
    e, width = F.col("cate_mean"), F.col("cate_upper") - F.col("cate_lower")
    return m.predict(df).select("member_id", e.isNotNull().alias("has_effect"), e.between(F.col("cate_lower"), F.col("cate_upper")).alias("inside_interval"), (F.abs(width / 3.92 - F.col("cate_std")) < 1e-9).alias("std_from_interval"))


@query("cau17_effect_importance")
def _(t):
    return forest(t)[1].importance(t.spark)


@query("cau17_importance_properties", f"SELECT {len(FOREST)}::BIGINT AS features, TRUE AS shares_add_up, TRUE AS ranked FROM cf LIMIT 1", *BASE)
def _(t):
    rows = forest(t)[1].importance(t.spark)
    ranked = F.max(F.struct((-F.col("rank")).alias("o"), "importance"))["importance"] == F.max("importance")
    total = F.round(F.sum("importance"), 6)  # 0 if no tree has a split
    return rows.agg(F.count("*").alias("features"), total.isin(0.0, 1.0).alias("shares_add_up"), ranked.alias("ranked"))


# Effect tables from given per-member effects: one action's column, negated to an effect on churn.
GE = f"""ge AS (SELECT cf.*, -cate_mean AS effect FROM cf JOIN cate USING (member_id) WHERE action = 'phone_call'),
gt AS (SELECT *, CASE WHEN tenure_months > 0 AND tenure_months <= 3 THEN '0-3m' WHEN tenure_months > 3 AND tenure_months <= 6 THEN '3-6m' WHEN tenure_months > 6 AND tenure_months <= 12 THEN '6-12m'
  WHEN tenure_months > 12 AND tenure_months <= 24 THEN '12-24m' WHEN tenure_months > 24 THEN '24m+' END AS tenure_group FROM ge),
gs AS (SELECT contract_source, tenure_group, COUNT(effect) AS n_members, {R("AVG(effect)", 6)} AS cate_mean, {R("COALESCE(STDDEV_SAMP(effect), 0)", 6)} AS cate_std,
  contract_source || '_' || tenure_group AS segment FROM gt WHERE tenure_group IS NOT NULL GROUP BY 1, 2)"""


def given_effects(t):
    e = t.cate.filter("action = 'phone_call'").select("member_id", (-F.col("cate_mean")).alias("cate_mean"))
    return cframe(t).join(e, "member_id")


def segments(t):
    return causal.effects_by_segment(given_effects(t))


@query("cau18_effects_by_segment", "SELECT * FROM gs", *BASE, GE)
def _(t):
    return segments(t)


@query("cau19_effects_by_group", f"""SELECT contract_source, plan_type, COUNT(effect) AS n_members, {R("AVG(effect)", 6)} AS cate_mean, {R("COALESCE(STDDEV_SAMP(effect), 0)", 6)} AS cate_std,
{R("quantile_cont(effect, 0.5)", 6)} AS cate_median, {R("quantile_cont(effect, 0.25)", 6)} AS cate_q25, {R("quantile_cont(effect, 0.75)", 6)} AS cate_q75 FROM ge GROUP BY 1, 2""", *BASE, GE)
def _(t):
    return causal.effects_by_group(given_effects(t), t.members, ["contract_source", "plan_type"])


@query("cau20_effects_by_action", f"""SELECT action_type, COUNT(effect) AS n, {R("AVG(effect)", 6)} AS cate_mean, {R("STDDEV_SAMP(effect)", 6)} AS cate_std, {R("AVG(action_cost)", 4)} AS avg_cost,
{R("ABS(AVG(effect)) / AVG(action_cost) * 100", 6)} AS effect_per_cost FROM ge WHERE action_type <> 'none' GROUP BY 1""", *BASE, GE)
def _(t):
    return causal.effects_by_action(given_effects(t))


def group_col(g: str) -> str:
    return "t_" + g.replace("-", "_").replace("+", "_plus")


@query("cau21_segment_pivot", "SELECT contract_source, " + ", ".join(f"{R(f'MAX(CASE WHEN tenure_group = {chr(39)}{g}{chr(39)} THEN cate_mean END) * 100', 4)} AS {group_col(g)}" for g in TENURE_LABELS) + " FROM gs GROUP BY 1", *BASE, GE)
def _(t):
    return causal.segment_pivot(segments(t))


@query("cau21_extreme_segments", """SELECT (SELECT segment FROM gs ORDER BY cate_mean, segment LIMIT 1) AS strongest_segment, (SELECT MIN(cate_mean) FROM gs) AS strongest_effect,
(SELECT segment FROM gs ORDER BY cate_mean DESC, segment DESC LIMIT 1) AS weakest_segment, (SELECT MAX(cate_mean) FROM gs) AS weakest_effect""", *BASE, GE)
def _(t):
    return causal.extreme_segments(segments(t))


@query("cau22_partial_correlation", f"""SELECT 'enrollment_month' AS x, 'retention_action_taken' AS y, {R("(r_xy - r_xw * r_yw) / sqrt((1 - r_xw * r_xw) * (1 - r_yw * r_yw))", 6)} AS partial_r, n FROM
(SELECT n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS r_xy, (xw - xz * wz) / sqrt((1 - xz * xz) * (1 - wz * wz)) AS r_xw, (yw - yz * wz) / sqrt((1 - yz * yz) * (1 - wz * wz)) AS r_yw FROM
(SELECT COUNT(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz, corr(x, w) AS xw, corr(y, w) AS yw, corr(w, z) AS wz FROM
(SELECT enrollment_month AS x, retention_action_taken AS y, visit_frequency AS z, tenure_months AS w FROM cf)))""", *BASE)
def _(t):
    return causal.partial_correlation(cframe(t), "enrollment_month", "retention_action_taken", ["visit_frequency", "tenure_months"]).select("x", "y", "partial_r", "n")


@query("cau24_effect_lookup", f"""SELECT *, {R("cate_mean - 1.96 * cate_std / sqrt(n_members)", 6)} AS ci_lower, {R("cate_mean + 1.96 * cate_std / sqrt(n_members)", 6)} AS ci_upper,
cate_mean - 1.96 * cate_std / sqrt(n_members) > 0 OR cate_mean + 1.96 * cate_std / sqrt(n_members) < 0 AS significant FROM gs""", *BASE, GE)
def _(t):
    return causal.effect_lookup(segments(t))
