"""Feature engineering and temporal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import features
from tenura.registry.base import ACT, M360, R, TREF, VIS, member_360, query, silver_visits
from tenura.registry.tables import FEAT_VIS, FIN, TENURE
from tenura.session import checkpointed
from tenura.registry.views import REF


@query("fea1_visit_counts", "SELECT member_id, visit_count_7d, visit_count_14d, visit_count_30d, visit_count_60d, visit_count_90d FROM fv", VIS, FEAT_VIS)
def _(t):
    return features.visit_features(silver_visits(t), REF).select("member_id", *[f"visit_count_{n}d" for n in (7, 14, 30, 60, 90)])


@query("fea2_avg_duration_30d", "SELECT member_id, avg_visit_duration_30d FROM fv", VIS, FEAT_VIS)
def _(t):
    return features.visit_features(silver_visits(t), REF).select("member_id", "avg_visit_duration_30d")


@query("fea3_recency", "SELECT member_id, days_since_last_visit FROM fv", VIS, FEAT_VIS)
def _(t):
    return features.visit_features(silver_visits(t), REF).select("member_id", "days_since_last_visit")


@query("fea4_frequency_trend", "SELECT member_id, visit_frequency_trend FROM fv", VIS, FEAT_VIS)
def _(t):
    return features.visit_features(silver_visits(t), REF).select("member_id", "visit_frequency_trend")


@query("fea5_tenure", "SELECT * FROM ten", TENURE)
def _(t):
    return features.tenure_features(t.members, REF)


def hot(col: str, values) -> str:
    return ", ".join(f"CAST(COALESCE({col} = '{v}', FALSE) AS BIGINT) AS {col}_{v}" for v in values)


@query("fea6_contract_one_hot", f"SELECT member_id, {hot('contract_source', ('regular', 'aggregator'))}, "
       f"{hot('plan_type', ('basic', 'standard', 'premium', 'aggregator_standard'))} FROM members")
def _(t):
    return features.contract_features(t.members)


@query("fea7_demographics", f"SELECT member_id, {hot('aggregator_platform', ('gympass', 'totalpass', 'wellhub', 'none'))}, {hot('gender', ('F', 'M'))}, "
       "CASE WHEN age > 0 AND age <= 25 THEN '18-24' WHEN age <= 35 THEN '25-34' WHEN age <= 45 THEN '35-44' WHEN age <= 55 THEN '45-54' WHEN age <= 100 THEN '55+' END AS age_group "
       "FROM (SELECT * REPLACE (COALESCE(aggregator_platform, 'none') AS aggregator_platform) FROM members)")
def _(t):
    return features.demographic_features(t.members)


@query("fea8_financial", "SELECT * FROM fin", FIN)
def _(t):
    return features.financial_features(t.members, t.transactions, REF)


MID = "TIMESTAMP '2000-08-02 00:00:00'"


@query("fea9_location_context", f"""SELECT m.member_id, m.location_id, x.* EXCLUDE (location_id) FROM members m LEFT JOIN (
SELECT a.location_id, {R("COALESCE(CAST(lost AS DOUBLE) / NULLIF(st, 0), 0)", 4)} AS location_churn_rate_30d, act_n AS location_active_members,
CAST(is_urban AS BIGINT) AS location_is_urban, {R("CAST(act_n AS DOUBLE) / capacity", 4)} AS location_capacity_utilization FROM
(SELECT location_id, COUNT(*) FILTER (WHERE s AND cancel_date < {MID}) AS lost, COUNT(*) FILTER (WHERE s) AS st,
 COUNT(*) FILTER (WHERE join_date <= {MID} AND (cancel_date IS NULL OR cancel_date > {MID})) AS act_n FROM
 (SELECT *, join_date < {MID} - INTERVAL 30 DAY AND (cancel_date IS NULL OR cancel_date >= {MID} - INTERVAL 30 DAY) AS s FROM members) GROUP BY 1) a
JOIN locations USING (location_id)) x ON m.location_id = x.location_id""")
def _(t):
    return features.location_context(t.members, t.locations, "2000-08-02 00:00:00")


@query("fea10_seasonal", f"SELECT member_id, month(join_date) AS enrollment_month, CAST(month(join_date) = 1 AS BIGINT) AS enrollment_is_january, month({TREF}) AS current_month, CAST(0 AS BIGINT) AS is_summer FROM members")
def _(t):
    return features.seasonal_features(t.members, REF)


@query("fea11_feature_matrix", "SELECT monthly_price, age, tenure_days, visit_count_7d, visit_count_14d, visit_count_30d, visit_count_60d, visit_count_90d, days_since_last_visit, "
       "retention_action_count FROM m360", VIS, ACT, M360)
def _(t):
    return features.feature_matrix(member_360(t))


@query("fea12_temporal_split", """SELECT o_orderkey, CASE WHEN d < a THEN 'train' WHEN d < b THEN 'val' ELSE 'test' END AS split FROM
(SELECT o_orderkey, o_orderdate AS d, lo + INTERVAL 36 MONTH AS a, lo + INTERVAL 48 MONTH AS b, lo + INTERVAL 60 MONTH AS c FROM orders, (SELECT MIN(o_orderdate) AS lo FROM orders)) WHERE d < c""")
def _(t):
    return features.temporal_split(t.base("orders"), "o_orderdate", 36, 12, 12).select("o_orderkey", "split")


@query("fea13_expanding_folds", """SELECT o_orderkey, i AS fold, CASE WHEN d < a THEN 'train' ELSE 'val' END AS role FROM
(SELECT o_orderkey, o_orderdate AS d, i, lo + to_months(CAST(36 + 6 * i AS INT)) AS a, lo + to_months(CAST(48 + 6 * i AS INT)) AS b, hi
 FROM orders, (SELECT MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders), (SELECT UNNEST(range(0, 60)) AS i)) WHERE a <= hi AND d < b""")
def _(t):
    return features.expanding_folds(t.base("orders"), "o_orderdate", 36, 12, 6).select("o_orderkey", "fold", "role")


# Feature rows are error and purchase events, entity rows all other events of the same user.
@query("fea14_point_in_time_join", """SELECT e.event_id, e.user_id, e.ts AS event_timestamp,
CASE WHEN epoch_us(e.ts) - epoch_us(f.ts) <= 86400000000 THEN f.ts END AS feature_timestamp,
CASE WHEN epoch_us(e.ts) - epoch_us(f.ts) <= 86400000000 THEN f.value END AS value
FROM (SELECT * FROM events WHERE event_type <> 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') f ON e.user_id = f.user_id AND e.ts >= f.ts""")
def _(t):
    ev = t.base("events").withColumnRenamed("ts", "event_timestamp")
    feats = ev.filter("event_type = 'error'").select("user_id", "event_timestamp", "value")
    return features.point_in_time_join(ev.filter("event_type <> 'error'").select("event_id", "user_id", "event_timestamp"), feats, "user_id")


@query("fea15_visits_before_end", f"""SELECT m.member_id, COALESCE(n, 0) AS visit_frequency FROM members m LEFT JOIN (SELECT member_id, COUNT(*) AS n FROM vis
JOIN members USING (member_id) WHERE date_diff('day', visit_date, COALESCE(cancel_date, {TREF})) BETWEEN 0 AND 30 GROUP BY 1) USING (member_id)""", VIS)
def _(t):
    return features.visits_before_end(t.members, silver_visits(t), REF)


@query("fea16_category_codes", """SELECT member_id, COALESCE(a.c, -1) AS aggregator_platform_code, b.c AS plan_type_code FROM members
LEFT JOIN (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT aggregator_platform AS v FROM members WHERE aggregator_platform IS NOT NULL)) a ON aggregator_platform = a.v
LEFT JOIN (SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS c FROM (SELECT DISTINCT plan_type AS v FROM members)) b ON plan_type = b.v""")
def _(t):
    return features.category_codes(t.members, ["aggregator_platform", "plan_type"]).select("member_id", "aggregator_platform_code", "plan_type_code")


@query("fea17_median_impute", """SELECT member_id, COALESCE(monthly_price, (SELECT quantile_cont(monthly_price, 0.5) FROM members WHERE join_date < TIMESTAMP '1995-01-01')) AS monthly_price FROM members""")
def _(t):
    fills = features.fit_percentiles(t.members.filter("join_date < timestamp_ntz'1995-01-01'"), ["monthly_price"], 0.5)
    return features.impute(t.members, fills).select("member_id", "monthly_price")


WINS = """w AS (SELECT member_id, LEAST(a, qa) AS a, LEAST(b, qb) AS b FROM (SELECT member_id, CAST(days_since_last_visit AS DOUBLE) AS a, CAST(tenure_days AS DOUBLE) AS b FROM m360),
  (SELECT quantile_cont(CAST(days_since_last_visit AS DOUBLE), 0.99) AS qa, quantile_cont(CAST(tenure_days AS DOUBLE), 0.99) AS qb FROM m360))"""


@query("fea18_winsorise_standardise", f"""SELECT member_id, {R("(a - ma) / sa", 6)} AS days_since_last_visit, {R("(b - mb) / sb", 6)} AS tenure_days FROM w,
(SELECT AVG(a) AS ma, STDDEV_POP(a) AS sa, AVG(b) AS mb, STDDEV_POP(b) AS sb FROM w)""", VIS, ACT, M360, WINS)
def _(t):
    from tenura.functions import round_dec
    cols = ["days_since_last_visit", "tenure_days"]
    df = checkpointed(member_360(t).select("member_id", *cols))  # three columns, read by each statistic
    out = features.standardise(features.winsorise(df, features.fit_percentiles(df, cols, 0.99)), cols)
    return out.select("member_id", *[round_dec(F.col(c), 6).alias(c) for c in cols])
