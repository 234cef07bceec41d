"""The member view, KPIs, cohorts and location reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import features, gold
from tenura.registry.base import (ACT, GOLD, KPI, M360, R, TREF, VIS, WINDOWS, location_kpis, member_360, normal_p, query,
                                  silver_actions, silver_visits)
from tenura.registry.views import REF


@query("gld1_visit_windows", f"""SELECT member_id, {", ".join(f"COUNT(*) FILTER (WHERE visit_date >= {TREF} - INTERVAL {n} DAY) AS visit_count_{n}d" for n in WINDOWS)},
date_diff('day', MAX(visit_date), {TREF}) AS days_since_last_visit FROM vis GROUP BY 1""", VIS)
def _(t):
    return gold.visit_windows(silver_visits(t), REF)


@query("gld2_action_summary", "SELECT member_id, COUNT(*) AS retention_action_count, ARG_MAX(action_type, (action_date, action_id)) AS last_action_type FROM act GROUP BY 1", ACT)
def _(t):
    return gold.action_summary(silver_actions(t))


@query("gld3_member_360", "SELECT * FROM m360", VIS, ACT, M360)
def _(t):
    return member_360(t)


@query("gld4_location_kpis", "SELECT * FROM kpi", *GOLD)
def _(t):
    return location_kpis(t)


def cohort_sql(minimum: int) -> str:
    return f"""SELECT strftime(c, '%Y-%m') AS cohort_month, p AS period, size AS cohort_size, retained, {R("CAST(retained AS DOUBLE) / size", 4)} AS retention_rate FROM (
SELECT s.c, s.size, g.p, COUNT(*) FILTER (WHERE m.cancel_date IS NULL OR m.cancel_date >= s.c + to_months(CAST(g.p AS INT))) AS retained
FROM (SELECT date_trunc('month', join_date) AS c, COUNT(*) AS size FROM members GROUP BY 1 HAVING COUNT(*) >= {minimum}) s
JOIN (SELECT UNNEST(range(0, 400)) AS p) g ON g.p <= GREATEST(1, date_diff('month', s.c, {TREF}))
JOIN members m ON date_trunc('month', m.join_date) = s.c GROUP BY 1, 2, 3)"""


@query("gld5_cohort_retention", cohort_sql(50))
def _(t):
    return gold.cohort_retention(t.members, REF)


@query("gld5_cohort_retention_all_sizes", cohort_sql(1))
def _(t):
    return gold.cohort_retention(t.members, REF, min_size=1)


@query("gld6_location_activity", " UNION ALL ".join(
    f"SELECT '{g}' AS grain, location_id, date_trunc('{p}', visit_date)::TIMESTAMP AS period_start, COUNT(*) AS visits, COUNT(DISTINCT member_id) AS visiting_members, "
    f"SUM(visit_duration_minutes)::BIGINT AS total_minutes FROM vis GROUP BY 2, 3" for g, p in gold.GRAINS.items()), VIS)
def _(t):
    return gold.location_activity(silver_visits(t))


METRICS = f"""metrics AS (SELECT k.location_id, 'last_90d' AS period, active_members, churned_members, churn_rate, mrr,
  {R("CAST(COALESCE(p.n, 0) AS DOUBLE) / total_members", 2)} AS avg_visits_per_member, r.at_risk_members, aggregator_pct
  FROM kpi k LEFT JOIN (SELECT location_id, COUNT(*) AS n FROM vis WHERE visit_date >= {TREF} - INTERVAL 90 DAY AND visit_date < {TREF} GROUP BY 1) p USING (location_id)
  LEFT JOIN (SELECT location_id, COUNT(*) FILTER (WHERE churn_probability > 0.5) AS at_risk_members FROM members JOIN scored USING (member_id) GROUP BY 1) r USING (location_id))"""


def metrics(t):
    return gold.location_metrics(member_360(t), t.scored, silver_visits(t), REF, last_days=90)


@query("gld7_location_metrics", "SELECT * FROM metrics", *GOLD, METRICS)
def _(t):
    return metrics(t)


ALLOC = """alloc AS (SELECT a.member_id, location_id, action_type AS action, cost, cost * 3 + monthly_price / 8 AS value
  FROM act a JOIN (SELECT member_id, monthly_price FROM members) USING (member_id))"""


def past_allocation(t):
    """Actions as an allocation, to roll up."""
    price = t.members.select("member_id", "monthly_price")
    return silver_actions(t).join(price, "member_id").select(
        "member_id", "location_id", F.col("action_type").alias("action"), "cost", (F.col("cost") * 3 + F.col("monthly_price") / 8).alias("value"))


@query("gld8_allocation_rollup", f"""SELECT location_id, SUM(n)::BIGINT AS members_targeted, {R("SUM(c)", 2)} AS budget_used,
string_agg(action || '=' || n, ',' ORDER BY action) AS actions, {R("SUM(v) / SUM(c)", 2)} AS roi FROM
(SELECT location_id, action, COUNT(*) AS n, SUM(cost) AS c, SUM(value) AS v FROM alloc GROUP BY 1, 2) GROUP BY 1""", ACT, ALLOC)
def _(t):
    out = gold.allocation_rollup(past_allocation(t))
    text = F.array_join(F.transform(F.map_entries("actions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("actions", text)


COHORT_COLS = ("churned", "tenure_days", "visit_count_90d", "monthly_price")


@query("gld9_compare_cohorts", " UNION ALL ".join(
    f"""SELECT metric, na AS n_members_a, nb AS n_members_b, {R("ma", 4)} AS mean_a, {R("mb", 4)} AS mean_b, {R("ma - mb", 4)} AS difference,
{R("(ma - mb) / sqrt(va / na + vb / nb)", 4)} AS z, {R(normal_p("ABS((ma - mb) / sqrt(va / na + vb / nb))"), 6)} AS p_value, ABS((ma - mb) / sqrt(va / na + vb / nb)) > 1.959963984540054 AS significant FROM (SELECT '{c}' AS metric,
COUNT(x) FILTER (WHERE s = 'regular') AS na, AVG(x) FILTER (WHERE s = 'regular') AS ma, VAR_SAMP(x) FILTER (WHERE s = 'regular') AS va,
COUNT(x) FILTER (WHERE s = 'aggregator') AS nb, AVG(x) FILTER (WHERE s = 'aggregator') AS mb, VAR_SAMP(x) FILTER (WHERE s = 'aggregator') AS vb
FROM (SELECT contract_source AS s, CAST({c} AS DOUBLE) AS x FROM m360))""" for c in COHORT_COLS), VIS, ACT, M360)
def _(t):
    src = F.col("contract_source")
    return gold.compare_cohorts(member_360(t), src == "regular", src == "aggregator", {c: F.col(c) for c in COHORT_COLS})


@query("gld10_best_action", """SELECT location_id, action, cate_mean FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY cate_mean DESC, action) AS rn
FROM (SELECT location_id, action, CAST(MAX(cate_mean) AS DOUBLE) AS cate_mean FROM cate JOIN members USING (member_id) GROUP BY 1, 2)) WHERE rn = 1""")
def _(t):
    effects = t.cate.join(t.members.select("member_id", "location_id"), "member_id").groupBy("location_id", "action").agg(
        F.max("cate_mean").alias("cate_mean"))
    return gold.best_action(effects, "location_id")


FLAGS = f"""drv AS (SELECT location_id, AVG(CAST(visit_count_90d < 2 AS DOUBLE)) AS a, AVG(CAST(late AS DOUBLE)) AS b, AVG(CAST(month(join_date) = 1 AS DOUBLE)) AS c
  FROM m360 JOIN (SELECT m.member_id, COALESCE(MAX(CAST(is_late AND txn_date >= {TREF} - INTERVAL 365 DAY AS BIGINT)), 0) AS late
       FROM members m LEFT JOIN transactions USING (member_id) GROUP BY 1) USING (member_id) WHERE churned GROUP BY 1),
top AS (SELECT location_id, string_agg(reason || '=' || printf('%.4f', s), ',' ORDER BY s DESC, reason) AS top_churn_reasons FROM (
  SELECT location_id, 'low_visit_frequency' AS reason, {R("a", 4)} AS s FROM drv UNION ALL SELECT location_id, 'payment_delay', {R("b", 4)} FROM drv
  UNION ALL SELECT location_id, 'seasonal_dropout', {R("c", 4)} FROM drv) GROUP BY 1)"""


@query("gld11_location_card", f"""SELECT metrics.*, COALESCE(s.n, 0) AS retention_actions_this_period, {R("COALESCE(s.c, 0)", 2)} AS budget_spent,
{R("2000.0 - COALESCE(s.c, 0)", 2)} AS budget_remaining, top.top_churn_reasons FROM metrics LEFT JOIN (SELECT location_id, COUNT(*) AS n, SUM(cost) AS c FROM act
WHERE action_date >= {TREF} - INTERVAL 365 DAY AND action_date < {TREF} GROUP BY 1) s USING (location_id) LEFT JOIN top USING (location_id)""", *GOLD, METRICS, FLAGS)
def _(t):
    late = features.financial_features(t.members, t.transactions, REF, late_days=365).select("member_id", "payment_delay_flag")
    drivers = member_360(t).join(late, "member_id").select(
        "location_id", "churned", (F.col("visit_count_90d") < 2).alias("driver_low_visit_frequency"),
        (F.col("payment_delay_flag") == 1).alias("driver_payment_delay"), (F.month("join_date") == 1).alias("driver_seasonal_dropout"))
    return gold.location_card(metrics(t), silver_actions(t), drivers, REF, last_days=365)


@query("gld12_period_change", f"""SELECT location_id, COALESCE(visits, 0) AS visits, COALESCE(visits_before, 0) AS visits_before,
COALESCE(visiting_members, 0) AS visiting_members, COALESCE(visiting_members_before, 0) AS visiting_members_before,
COALESCE(spend, 0.0) AS spend, COALESCE(spend_before, 0.0) AS spend_before, COALESCE(visits, 0) - COALESCE(visits_before, 0) AS visits_change,
{R("CAST(visits - visits_before AS DOUBLE) / NULLIF(visits_before, 0)", 4)} AS visits_change_pct FROM
(SELECT location_id, COUNT(*) FILTER (WHERE cur) AS visits, COUNT(*) FILTER (WHERE NOT cur) AS visits_before,
  COUNT(DISTINCT member_id) FILTER (WHERE cur) AS visiting_members, COUNT(DISTINCT member_id) FILTER (WHERE NOT cur) AS visiting_members_before
  FROM (SELECT *, visit_date >= {TREF} - INTERVAL 90 DAY AS cur FROM vis WHERE visit_date >= {TREF} - INTERVAL 180 DAY AND visit_date < {TREF}) GROUP BY 1)
FULL JOIN (SELECT location_id, SUM(CASE WHEN cur THEN cost ELSE 0 END) AS spend, SUM(CASE WHEN cur THEN 0 ELSE cost END) AS spend_before
  FROM (SELECT *, action_date >= {TREF} - INTERVAL 90 DAY AS cur FROM act WHERE action_date >= {TREF} - INTERVAL 180 DAY AND action_date < {TREF}) GROUP BY 1) USING (location_id)""", VIS, ACT)
def _(t):
    return gold.period_change(silver_visits(t), silver_actions(t), REF, days=90)
