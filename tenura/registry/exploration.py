"""Exploratory summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.functions import round_dec
from tenura.operators import eda
from tenura.registry.base import ACT, R, TREF, VIS, query, silver_actions, silver_visits
from tenura.registry.views import REF

CH = "CAST(churned AS DOUBLE)"
TEN = f"""mt AS (SELECT *, date_diff('day', join_date, COALESCE(cancel_date, {TREF})) AS tenure_days,
  date_diff('day', join_date, COALESCE(cancel_date, {TREF})) / 30.44::DOUBLE AS tenure_months FROM members)"""
VPM = """vpm AS (SELECT mt.*, COALESCE(n, 0) AS total_visits, CASE WHEN tenure_days > 0 THEN COALESCE(n, 0) / tenure_months ELSE 0 END AS visits_per_month
  FROM mt LEFT JOIN (SELECT member_id, COUNT(*) AS n FROM vis GROUP BY 1) USING (member_id))"""
LOC = f"lc AS (SELECT l.*, x.member_count, x.churn_rate FROM (SELECT location_id, COUNT(*) AS member_count, AVG({CH}) AS churn_rate FROM members GROUP BY 1) x LEFT JOIN locations l USING (location_id))"
LEAD = "lead AS (SELECT date_diff('day', action_date, cancel_date) AS d FROM act JOIN members USING (member_id) WHERE churned)"


@query("eda1_network_summary", f"""SELECT 'total_locations' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM locations
UNION ALL SELECT 'total_members', COUNT(*) FROM members UNION ALL SELECT 'active_members', COUNT(*) FROM members WHERE NOT churned
UNION ALL SELECT 'churned_members', COUNT(*) FROM members WHERE churned UNION ALL SELECT 'churn_rate', {R(f"AVG({CH})", 6)} FROM members
UNION ALL SELECT 'median_tenure_months', {R("quantile_cont(CAST(tenure_days AS DOUBLE), 0.5) / 30.44::DOUBLE", 4)} FROM mt
UNION ALL SELECT 'mean_monthly_price', {R("AVG(monthly_price)", 4)} FROM members UNION ALL SELECT 'total_visits', COUNT(*) FROM vis
UNION ALL SELECT 'total_actions', COUNT(*) FROM act UNION ALL SELECT 'members_with_action', COUNT(DISTINCT member_id) FROM act""", VIS, ACT, TEN)
def _(t):
    return eda.network_summary(t.locations, t.members, silver_visits(t), silver_actions(t), REF)


@query("eda2_enrolments_by_month", "SELECT date_trunc('month', join_date)::TIMESTAMP AS join_month, COUNT(*) AS enrollments FROM members GROUP BY 1")
def _(t):
    return eda.enrolments_by_month(t.members)


@query("eda2_churn_by_month_of_year", f"SELECT month(join_date) AS month_of_year, {R(f'AVG({CH})', 6)} AS churn_rate, COUNT(*) AS n FROM members GROUP BY 1")
def _(t):
    return eda.churn_by_month_of_year(t.members)


@query("eda2_january_effect", f"SELECT {R('j', 6)} AS january_churn, {R('r', 6)} AS other_churn, {R('j / r - 1', 6)} AS relative_difference FROM "
       f"(SELECT AVG({CH}) FILTER (WHERE month(join_date) = 1) AS j, AVG({CH}) FILTER (WHERE month(join_date) <> 1) AS r FROM members)")
def _(t):
    return eda.january_effect(t.members)


@query("eda3_visits_per_month", f"SELECT member_id, total_visits, {R('visits_per_month', 6)} AS visits_per_month FROM vpm", VIS, TEN, VPM)
def _(t):
    return eda.visits_per_month(t.members, silver_visits(t), REF).select(
        "member_id", "total_visits", round_dec(F.col("visits_per_month"), 6).alias("visits_per_month"))


@query("eda4_segment_stats", f"""SELECT contract_source, COUNT(*) AS count, {R(f"AVG({CH})", 2)} AS churn_rate, {R("AVG(tenure_months)", 2)} AS avg_tenure_months,
{R("quantile_cont(CAST(tenure_days AS DOUBLE), 0.5) / 30.44::DOUBLE", 2)} AS median_tenure_months, {R("AVG(monthly_price)", 2)} AS avg_monthly_price,
{R("AVG(visits_per_month)", 2)} AS avg_visits_per_month FROM vpm GROUP BY 1""", VIS, TEN, VPM)
def _(t):
    return eda.segment_stats(t.members, silver_visits(t), REF)


@query("eda5_platform_breakdown", f"""SELECT aggregator_platform, COUNT(*) AS count, {R(f"AVG({CH})", 6)} AS churn_rate, {R("AVG(tenure_months)", 4)} AS avg_tenure
FROM mt WHERE contract_source = 'aggregator' AND aggregator_platform IS NOT NULL GROUP BY 1""", TEN)
def _(t):
    return eda.platform_breakdown(t.members, REF)


@query("eda6_location_churn", f"SELECT location_id, member_count, {R('churn_rate', 6)} AS churn_rate, region, is_urban, capacity FROM lc", LOC)
def _(t):
    return eda.location_churn(t.members, t.locations).withColumn("churn_rate", round_dec(F.col("churn_rate"), 6))


@query("eda6_region_churn", f"SELECT region, {R('AVG(churn_rate)', 6)} AS mean_churn, COUNT(*) AS n_locations FROM lc GROUP BY 1", LOC)
def _(t):
    return eda.churn_by(eda.location_churn(t.members, t.locations), "region")


@query("eda6_urban_churn", f"SELECT is_urban, {R('AVG(churn_rate)', 6)} AS mean_churn, COUNT(*) AS n_locations FROM lc GROUP BY 1", LOC)
def _(t):
    return eda.churn_by(eda.location_churn(t.members, t.locations), "is_urban")


def qc(p: float) -> str:
    return R(f"quantile_cont(churn_rate, {p})", 6)


@query("eda6_location_spread", f"""SELECT {qc(0.0)} AS "min", {qc(0.25)} AS q1, {qc(0.5)} AS median, {qc(0.75)} AS q3, {qc(1.0)} AS "max",
{R("quantile_cont(churn_rate, 0.75) - quantile_cont(churn_rate, 0.25)", 6)} AS iqr, {R("corr(capacity, churn_rate)", 6)} AS capacity_corr FROM lc""", LOC)
def _(t):
    return eda.location_churn_spread(eda.location_churn(t.members, t.locations))


@query("eda7_visit_decay", f"""SELECT contract_source, churned, b AS tenure_bucket, {R("AVG(n)", 6)} AS avg_visits FROM (SELECT member_id, contract_source, churned,
CAST(LEAST(FLOOR(GREATEST(date_diff('day', join_date, visit_date) / 30.44::DOUBLE, 0)), 24) AS BIGINT) AS b, COUNT(*) AS n FROM vis JOIN members USING (member_id) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""", VIS)
def _(t):
    return eda.visit_decay(t.members, silver_visits(t))


@query("eda8_recency_to_end", f"""SELECT churned, COUNT(*) AS n, quantile_cont(CAST(g AS DOUBLE), 0.5) AS median_days FROM (SELECT churned,
GREATEST(date_diff('day', last, CASE WHEN churned THEN cancel_date ELSE {TREF} END), 0) AS g FROM members JOIN (SELECT member_id, MAX(visit_date) AS last FROM vis GROUP BY 1) USING (member_id)) GROUP BY 1""", VIS)
def _(t):
    return eda.recency_to_end(t.members, silver_visits(t), REF)


@query("eda9_weekday_month", "SELECT (isodow(visit_date) - 1) AS day_of_week, " + ", ".join(
    f"COUNT(*) FILTER (WHERE month(visit_date) = {i}) AS m{i}" for i in range(1, 13)) + " FROM vis GROUP BY 1", VIS)
def _(t):
    return eda.weekday_month_pivot(silver_visits(t))


@query("eda10_naive_treatment_gap", f"""SELECT member_id IN (SELECT member_id FROM act) AS received_action, COUNT(*) AS count, {R(f"AVG({CH})", 6)} AS churn_rate,
{R("AVG(tenure_months)", 4)} AS avg_tenure_months FROM mt GROUP BY 1""", ACT, TEN)
def _(t):
    return eda.naive_treatment_gap(t.members, silver_actions(t), REF)


@query("eda11_action_counts", "SELECT action_type, COUNT(*) AS n FROM act GROUP BY 1", ACT)
def _(t):
    return eda.action_type_counts(silver_actions(t))


@query("eda11_action_lead_time", f"""SELECT COUNT(d) AS n, quantile_cont(CAST(d AS DOUBLE), 0.5) AS median_days, quantile_cont(CAST(GREATEST(LEAST(d, 180), -30) AS DOUBLE), 0.5) AS median_days_clipped,
COUNT(*) FILTER (WHERE d < 0) AS after_churn, {R("AVG(CAST(d < 0 AS DOUBLE))", 6)} AS share_after_churn FROM lead""", ACT, LEAD)
def _(t):
    return eda.action_lead_time(t.members, silver_actions(t))


@query("eda12_pre_action_rate", """SELECT member_id, COUNT(*) AS visits_before, COUNT(*) / 2.0::DOUBLE AS visits_per_month_pre FROM vis JOIN (SELECT member_id, MIN(action_date) AS f FROM act GROUP BY 1) USING (member_id)
WHERE visit_date >= f - INTERVAL 60 DAY AND visit_date < f GROUP BY 1""", VIS, ACT)
def _(t):
    return eda.pre_action_rate(silver_actions(t), silver_visits(t))


@query("eda13_tenure_histogram", f"""SELECT g.churned, g.b AS bin, {R("lo + g.b * ((hi - lo) / 30)", 6)} AS lower, COALESCE(n, 0) AS n, {R("COALESCE(n, 0) / (tot * ((hi - lo) / 30))", 8)} AS density
FROM (SELECT churned, tot, b FROM (SELECT churned, COUNT(*) AS tot FROM mt GROUP BY 1), (SELECT UNNEST(range(0, 30)) AS b)) g
JOIN (SELECT CAST(MIN(tenure_days) AS DOUBLE) AS lo, CAST(MAX(tenure_days) AS DOUBLE) AS hi FROM mt) r ON TRUE
LEFT JOIN (SELECT churned, CAST(LEAST(FLOOR((tenure_days - lo) / (hi - lo) * 30), 29) AS BIGINT) AS b, COUNT(*) AS n FROM mt,
  (SELECT CAST(MIN(tenure_days) AS DOUBLE) AS lo, CAST(MAX(tenure_days) AS DOUBLE) AS hi FROM mt) GROUP BY 1, 2) c ON c.churned = g.churned AND c.b = g.b""", TEN)
def _(t):
    h = eda.histogram(eda.with_tenure(t.members, REF), "tenure_days", 30, ["churned"])
    return h.withColumns({"lower": round_dec(F.col("lower"), 6), "density": round_dec(F.col("density"), 8)})


@query("eda14_arm_distribution", " UNION ALL ".join(
    f"SELECT treated, '{c}' AS covariate, v AS value, n, {R('CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY treated)', 6)} AS share FROM "
    f"(SELECT member_id IN (SELECT member_id FROM act) AS treated, CAST({e} AS VARCHAR) AS v, COUNT(*) AS n FROM members GROUP BY 1, 2)"
    for c, e in (("enrollment_month", "month(join_date)"), ("plan_type", "plan_type"))), ACT)
def _(t):
    acted = silver_actions(t).select("member_id").distinct().withColumn("treated", F.lit(True))
    df = t.members.join(acted, "member_id", "left").withColumns(
        {"treated": F.coalesce("treated", F.lit(False)), "enrollment_month": F.month("join_date")})
    return eda.arm_distribution(df, "treated", ["enrollment_month", "plan_type"])
