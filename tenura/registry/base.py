"""Registration of queries with their SQL, and SQL fragments several checks share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenura.operators import clean, gold
from tenura.registry.views import REF, Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register ``fn(tables) -> DataFrame`` with the SQL body that must give the same rows."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, *ctes)
        return fn

    return add


def R(expr: str, digits: int) -> str:
    """The rounding rule of the operators, in SQL."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def normal_p(z: str) -> str:
    """Two-sided p-value by Simpson's rule on the density, unlike the series of the operator."""
    return (f"GREATEST(0, 1 - 2 * list_sum(list_transform(range(0, 2001), lambda k: (CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) "
            f"* exp(-0.5::DOUBLE * ({z} * k / 2000) * ({z} * k / 2000)))) * {z} / 6000 / sqrt(2 * pi()))")


def T(text: str) -> str:
    return f"TIMESTAMP '{text}'"


TREF = T(REF)
WINDOWS = (7, 14, 30, 60, 90)

# Silver tables, the member view and the location KPIs in SQL.
VIS = """vis AS (SELECT DISTINCT * FROM visits
  WHERE visit_duration_minutes BETWEEN 5 AND 300 AND visit_date IS NOT NULL)"""
ACT = """act AS (SELECT DISTINCT * FROM actions
  WHERE action_type IN ('sms_reengagement','phone_call','discount_offer','pt_session') AND action_date IS NOT NULL)"""
M360 = f"""m360 AS (SELECT m.*, date_diff('day', m.join_date, COALESCE(m.cancel_date, {TREF})) AS tenure_days,
  {", ".join(f"COALESCE(v.visit_count_{n}d, 0) AS visit_count_{n}d" for n in WINDOWS)},
  COALESCE(v.days_since_last_visit, -1) AS days_since_last_visit,
  COALESCE(a.retention_action_count, 0) AS retention_action_count, a.last_action_type
  FROM members m
  LEFT JOIN (SELECT member_id, {", ".join(f"COUNT(*) FILTER (WHERE visit_date >= {TREF} - INTERVAL {n} DAY) AS visit_count_{n}d" for n in WINDOWS)},
             date_diff('day', MAX(visit_date), {TREF}) AS days_since_last_visit FROM vis GROUP BY 1) v USING (member_id)
  LEFT JOIN (SELECT member_id, COUNT(*) AS retention_action_count,
             ARG_MAX(action_type, (action_date, action_id)) AS last_action_type FROM act GROUP BY 1) a USING (member_id))"""
KPI = f"""kpi AS (SELECT location_id, COUNT(member_id) AS total_members, COUNT(*) FILTER (WHERE NOT churned) AS active_members,
  COUNT(*) FILTER (WHERE churned) AS churned_members, {R("AVG(visit_count_30d)", 2)} AS avg_visits_30d,
  {R("AVG(tenure_days)", 1)} AS avg_tenure_days, {R("COALESCE(SUM(monthly_price) FILTER (WHERE NOT churned), 0)", 2)} AS mrr,
  {R("CAST(COUNT(*) FILTER (WHERE churned) AS DOUBLE) / COUNT(member_id)", 4)} AS churn_rate,
  {R("CAST(COUNT(*) FILTER (WHERE contract_source = 'aggregator') AS DOUBLE) / COUNT(member_id)", 4)} AS aggregator_pct
  FROM m360 GROUP BY 1)"""
GOLD = (VIS, ACT, M360, KPI)


def silver_visits(t: Tables) -> DataFrame:
    return clean.clean_visits(t.visits)


def silver_actions(t: Tables) -> DataFrame:
    return clean.clean_actions(t.actions)


def member_360(t: Tables) -> DataFrame:
    return gold.member_360(t.members, silver_visits(t), silver_actions(t), REF)


def location_kpis(t: Tables) -> DataFrame:
    return gold.location_kpis(member_360(t))


_ONCE: dict = {}


def once(t: Tables, name: str, make):
    """What ``make`` gives, made once for each application and folder: for results of a long fit that several queries report on."""
    at = (t.spark.sparkContext.applicationId, t.dir, name)
    if at not in _ONCE:
        _ONCE[at] = make()
    return _ONCE[at]
