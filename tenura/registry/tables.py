"""Sources, cleaning and data quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.config import NULL_LIMITS, SCHEMAS
from tenura.operators import clean, features, quality
from tenura.registry.base import (ACT, GOLD, KPI, M360, R, TREF, VIS, location_kpis, member_360, query, silver_actions,
                                  silver_visits)
from tenura.registry.views import REF, VIEWS, Tables
from tenura.session import scratch_folder
from tenura.sources import catalog, feature_store

# Raw rows with text dates, unknown categories and several loads per member.
VIEWS["member_log"] = """
SELECT o.o_custkey AS member_id, c.c_nationkey AS location_id,
       CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW' THEN 'not a date'
            ELSE CAST(o.o_orderdate AS STRING) END AS join_date,
       CASE WHEN o.o_orderstatus <> 'O' THEN CAST(o.o_orderdate + INTERVAL '60' DAY AS STRING) END AS cancel_date,
       (o.o_orderstatus <> 'O') AS churned,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'partner' WHEN '3-MEDIUM' THEN 'aggregator'
            ELSE 'regular' END AS contract_source,
       CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'aggregator_standard' WHEN 'BUILDING' THEN NULL
            WHEN 'FURNITURE' THEN 'premium' ELSE 'legacy' END AS plan_type,
       CASE WHEN c.c_acctbal >= -950 THEN 30 + CAST(FLOOR(ABS(c.c_acctbal)) AS DOUBLE) / 64 END AS monthly_price,
       o.o_orderdate AS loaded_at, o.o_orderkey AS load_id
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


def log(t: Tables) -> DataFrame:
    return t.view("member_log")


# ---- sources ---------------------------------------------------------------------------------

def paths(t: Tables) -> dict[str, str]:
    return {n: f"{t.dir}/{n}.parquet" for n in ("nation", "customer", "orders", "lineitem", "events")}


@query("src1_load_raw_table", "SELECT * FROM customer")
def _(t):
    return catalog.load_raw(t.spark, "customer", paths(t))


@query("src2_validate_schema", "SELECT member_id, churned, contract_source, monthly_price, age FROM members")
def _(t):
    declared = {c: k for c, k in SCHEMAS["members"].items() if c in ("churned", "contract_source", "monthly_price", "age")}
    return catalog.validate_schema(t.members, declared).select("member_id", *declared)


# The raw tables with every declared column, as they would arrive: text ids and dates.
VIEWS["raw_locations"] = f"""
SELECT 'L' || CAST(location_id AS STRING) AS location_id, region, is_urban, CAST(capacity AS BIGINT) AS capacity, CAST(capacity * 90 AS BIGINT) AS monthly_operating_cost,
       CAST(20 AS BIGINT) AS staff_retention_hours FROM ({VIEWS["locations"]}) x"""
VIEWS["raw_members"] = f"""
SELECT 'M' || CAST(member_id AS STRING) AS member_id, 'L' || CAST(location_id AS STRING) AS location_id, CAST(join_date AS STRING) AS join_date, CAST(cancel_date AS STRING) AS cancel_date,
       churned, contract_source, COALESCE(aggregator_platform, 'none') AS aggregator_platform, plan_type, monthly_price, CAST(age AS BIGINT) AS age, gender, name,
       'm' || CAST(member_id AS STRING) || '@example.org' AS email, '000.000.000-' || CAST(member_id % 100 AS STRING) AS cpf FROM ({VIEWS["members"]}) x"""
VIEWS["raw_visits"] = f"""
SELECT 'M' || CAST(member_id AS STRING) AS member_id, 'L' || CAST(location_id AS STRING) AS location_id, CAST(visit_date AS STRING) AS visit_date, CAST(visit_duration_minutes AS BIGINT) AS visit_duration_minutes FROM ({VIEWS["visits"]}) x"""
VIEWS["raw_retention_actions"] = f"""
SELECT 'M' || CAST(member_id AS STRING) AS member_id, 'L' || CAST(location_id AS STRING) AS location_id, CAST(action_date AS STRING) AS action_date, action_type, cost FROM ({VIEWS["actions"]}) x"""
RAW_KEYS = {"locations": ("location_id", "region", "capacity", "monthly_operating_cost"), "members": ("member_id", "location_id", "join_date", "contract_source", "aggregator_platform", "age", "email", "cpf"),
            "visits": ("member_id", "location_id", "visit_date", "visit_duration_minutes"), "retention_actions": ("member_id", "location_id", "action_date", "action_type")}


@query("src3_bronze_tables", " UNION ALL ".join(f"SELECT '{n}' AS tbl, concat_ws('|', {', '.join(cols)}) AS row_text, {len(SCHEMAS[n])}::BIGINT AS declared_columns FROM raw_{n}" for n, cols in RAW_KEYS.items()))
def _(t):
    root = scratch_folder(t.spark, "bronze")
    where = {n: f"{root}/{n}" for n in RAW_KEYS}
    for n, path in where.items():
        catalog.write_layer(t.view(f"raw_{n}"), path, append=True)
    parts = [catalog.load_bronze(t.spark, n, where).select(F.lit(n).alias("tbl"), F.concat_ws("|", *cols).alias("row_text"), F.lit(len(SCHEMAS[n])).cast("bigint").alias("declared_columns")) for n, cols in RAW_KEYS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("src4_first_existing_folder", """SELECT event_type, COUNT(*) AS n, SUM(CAST(event_id AS BIGINT))::BIGINT AS ids FROM events GROUP BY 1""")
def _(t):
    df = catalog.first_existing(t.spark, "events", [f"{t.dir}/gold", f"{t.dir}/silver", t.dir])
    return df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("src5_keyed_lookup", "SELECT member_id, location_id, tenure_days, visit_count_30d, last_action_type FROM m360 "
       "WHERE member_id IN (SELECT member_id FROM act)", VIS, ACT, M360)
def _(t):
    return catalog.lookup_many(member_360(t), silver_actions(t), "member_id").select(
        "member_id", "location_id", "tenure_days", "visit_count_30d", "last_action_type")


@query("src6_layer_table", "SELECT * FROM kpi", *GOLD)
def _(t):
    path = scratch_folder(t.spark, "gold")
    catalog.write_layer(location_kpis(t), path)
    return t.spark.read.parquet(path)


def tenure_view(t: Tables) -> DataFrame:
    """Two snapshots of the tenure features, so that the newest must win."""
    parts = [features.tenure_features(t.members, ref).withColumn("event_timestamp", F.lit(ref).cast("timestamp_ntz"))
             for ref in ("2001-07-01 00:00:00", REF)]
    return reduce(DataFrame.unionByName, parts)


TENURE = f"""ten AS (SELECT member_id, date_diff('day', join_date, {TREF}) AS tenure_days,
  {R(f"date_diff('day', join_date, {TREF}) / 30.0::DOUBLE", 2)} AS tenure_months,
  CAST(date_diff('day', join_date, {TREF}) <= 90 AS BIGINT) AS is_first_90_days FROM members)"""
FEAT_VIS = f"""fv AS (SELECT member_id, {", ".join(f"COUNT(*) FILTER (WHERE visit_date >= {TREF} - INTERVAL {n} DAY) AS visit_count_{n}d" for n in (7, 14, 30, 60, 90))},
  AVG(visit_duration_minutes) FILTER (WHERE visit_date >= {TREF} - INTERVAL 30 DAY) AS avg_visit_duration_30d,
  date_diff('day', MAX(visit_date), {TREF}) AS days_since_last_visit,
  CAST(COUNT(*) FILTER (WHERE visit_date >= {TREF} - INTERVAL 14 DAY) AS DOUBLE)
    / GREATEST(COUNT(*) FILTER (WHERE visit_date >= {TREF} - INTERVAL 28 DAY AND visit_date < {TREF} - INTERVAL 14 DAY), 1) AS visit_frequency_trend
  FROM vis WHERE visit_date < {TREF} GROUP BY 1)"""
FIN = f"""fin AS (SELECT m.member_id, m.monthly_price, {R("COALESCE(x.rev, 0)", 2)} AS total_revenue, COALESCE(x.late, 0) AS payment_delay_flag
  FROM members m LEFT JOIN (SELECT member_id, SUM(amount) AS rev,
       MAX(CAST(is_late AND txn_date >= {TREF} - INTERVAL 90 DAY AS BIGINT)) AS late
       FROM transactions WHERE txn_date < {TREF} GROUP BY 1) x USING (member_id))"""


@query("src7_publish_features", f"SELECT member_id, {TREF} AS event_timestamp, tenure_days, tenure_months, is_first_90_days FROM ten "
       "UNION ALL SELECT member_id, TIMESTAMP '2001-07-01 00:00:00', date_diff('day', join_date, TIMESTAMP '2001-07-01'), "
       + R("date_diff('day', join_date, TIMESTAMP '2001-07-01') / 30.0::DOUBLE", 2)
       + ", CAST(date_diff('day', join_date, TIMESTAMP '2001-07-01') <= 90 AS BIGINT) FROM members", TENURE)
def _(t):
    root = scratch_folder(t.spark, "features")
    feature_store.publish(tenure_view(t), "tenure", root)
    return feature_store.read_view(t.spark, "tenure", root)


def feature_views(t: Tables) -> dict[str, DataFrame]:
    now = F.lit(REF).cast("timestamp_ntz")
    return {"tenure": feature_store.conform(tenure_view(t), "tenure"),
            "visit_behavior": feature_store.conform(
                features.visit_features(silver_visits(t), REF).withColumn("event_timestamp", now), "visit_behavior"),
            "financial": feature_store.conform(
                features.financial_features(t.members, t.transactions, REF).withColumn("event_timestamp", now), "financial")}


@query("src8_online_features", "SELECT DISTINCT a.member_id, t.tenure_days, t.is_first_90_days, f.visit_count_30d FROM act a "
       "LEFT JOIN ten t USING (member_id) LEFT JOIN fv f USING (member_id)", VIS, ACT, TENURE, FEAT_VIS)
def _(t):
    return feature_store.online_features(silver_actions(t), ["tenure:tenure_days", "tenure:is_first_90_days",
                                                             "visit_behavior:visit_count_30d"], feature_views(t))


@query("src9_feature_service", "SELECT m.member_id, ten.* EXCLUDE (member_id), fv.* EXCLUDE (member_id), fin.* EXCLUDE (member_id) "
       "FROM members m LEFT JOIN ten USING (member_id) LEFT JOIN fv USING (member_id) LEFT JOIN fin USING (member_id)",
       VIS, TENURE, FEAT_VIS, FIN)
def _(t):
    return feature_store.feature_service(t.members, feature_views(t))


@query("src10_csv_export", "SELECT location_id, total_members, churn_rate, mrr FROM kpi", *GOLD)
def _(t):
    path = scratch_folder(t.spark, "export")
    df = location_kpis(t).select("location_id", "total_members", "churn_rate", "mrr")
    catalog.export_csv(df, path)
    return t.spark.read.schema(df.schema).option("header", True).csv(path)


# ---- cleaning --------------------------------------------------------------------------------

PARSED = """parsed AS (SELECT * REPLACE (TRY_CAST(join_date AS TIMESTAMP) AS join_date, TRY_CAST(cancel_date AS TIMESTAMP) AS cancel_date) FROM member_log)"""
LAST = """lastrow AS (SELECT * EXCLUDE rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY loaded_at DESC, load_id DESC) AS rn
  FROM parsed) WHERE rn = 1)"""
REPAIRED = """repaired AS (SELECT * REPLACE (CASE WHEN contract_source IN ('regular','aggregator') THEN contract_source ELSE 'regular' END AS contract_source,
  CASE WHEN plan_type IS NOT NULL AND plan_type NOT IN ('basic','standard','premium','aggregator_standard') THEN 'basic' ELSE plan_type END AS plan_type) FROM lastrow)"""
SPELLS = f"""daily AS (SELECT member_id, o_orderdate AS join_date, CASE WHEN NOT BOOL_OR(o_orderstatus = 'O') THEN MAX(o_orderdate + to_days(CAST(5 + load_id % 400 AS INT))) END AS cancel_date,
  ARG_MIN(load_id, load_id) AS load_id FROM (SELECT o_custkey AS member_id, o_orderdate, o_orderstatus, o_orderkey AS load_id FROM orders) GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM daily e WHERE e.member_id = d.member_id AND e.join_date < d.join_date AND e.cancel_date >= d.join_date - INTERVAL 30 DAY)
    OR (SELECT ARG_MAX(e.cancel_date IS NULL, e.join_date) FROM daily e WHERE e.member_id = d.member_id AND e.join_date < d.join_date) THEN 1 ELSE 0 END AS st FROM daily d),
isl AS (SELECT *, SUM(st) OVER (PARTITION BY member_id ORDER BY join_date) AS island FROM marked)"""


@query("cln1_parse_dates", "SELECT load_id, join_date, cancel_date FROM parsed", PARSED)
def _(t):
    return clean.parse_dates(log(t), ["join_date", "cancel_date"]).select("load_id", "join_date", "cancel_date")


@query("cln2_keep_last", "SELECT * FROM lastrow", PARSED, LAST)
def _(t):
    return clean.keep_last(clean.parse_dates(log(t), ["join_date", "cancel_date"]), ["member_id"], ["loaded_at", "load_id"])


@query("cln3_exact_dedup", "SELECT DISTINCT * FROM visits")
def _(t):
    return clean.drop_exact_duplicates(t.visits)


@query("cln4_null_limits", """SELECT c AS "column", f AS null_fraction, th AS threshold, f <= th AS passed FROM (
SELECT 'location_id' AS c, AVG(CAST(location_id IS NULL AS DOUBLE)) AS f, 0.0::DOUBLE AS th FROM parsed UNION ALL
SELECT 'join_date', AVG(CAST(join_date IS NULL AS DOUBLE)), 0.0 FROM parsed UNION ALL
SELECT 'contract_source', AVG(CAST(contract_source IS NULL AS DOUBLE)), 0.0 FROM parsed UNION ALL
SELECT 'monthly_price', AVG(CAST(monthly_price IS NULL AS DOUBLE)), 0.01 FROM parsed)""", PARSED)
def _(t):
    return clean.null_fractions(clean.parse_dates(log(t), ["join_date", "cancel_date"]), NULL_LIMITS)


@query("cln5_repair_domains", "SELECT * FROM repaired", PARSED, LAST, REPAIRED)
def _(t):
    df = clean.keep_last(clean.parse_dates(log(t), ["join_date", "cancel_date"]), ["member_id"], ["loaded_at", "load_id"])
    return clean.repair_domains(df)


@query("cln6_duration_filter", "SELECT * FROM visits WHERE visit_duration_minutes BETWEEN 5 AND 300")
def _(t):
    return clean.limit_durations(t.visits)


@query("cln6_duration_clip", "SELECT * REPLACE (LEAST(visit_duration_minutes, 300) AS visit_duration_minutes) FROM visits")
def _(t):
    return clean.limit_durations(t.visits, mode="clip")


@query("cln7_drop_undated", "SELECT load_id, join_date FROM parsed WHERE join_date IS NOT NULL", PARSED)
def _(t):
    return clean.drop_undated(clean.parse_dates(log(t), ["join_date"]), ["join_date"]).select("load_id", "join_date")


@query("cln8_action_types", "SELECT * FROM actions WHERE action_type IN ('sms_reengagement','phone_call','discount_offer','pt_session')")
def _(t):
    return clean.keep_known_actions(t.actions)


MERGED = ("""pday AS (SELECT member_id, CAST(join_date AS DATE) AS day, MIN(join_date) AS join_date, CASE WHEN NOT BOOL_OR(cancel_date IS NULL) THEN MAX(cancel_date) END AS cancel_date FROM parsed WHERE join_date IS NOT NULL GROUP BY 1, 2)""",
          """pmark AS (SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM pday e WHERE e.member_id = d.member_id AND e.join_date < d.join_date AND date_diff('day', e.cancel_date, d.join_date) <= 30)
    OR (SELECT ARG_MAX(e.cancel_date IS NULL, e.join_date) FROM pday e WHERE e.member_id = d.member_id AND e.join_date < d.join_date) THEN 1 ELSE 0 END AS st FROM pday d)""",
          """pisl AS (SELECT member_id, island, MIN(join_date) AS join_date, CASE WHEN NOT BOOL_OR(cancel_date IS NULL) THEN MAX(cancel_date) END AS cancel_date
  FROM (SELECT *, SUM(st) OVER (PARTITION BY member_id ORDER BY join_date) AS island FROM pmark) GROUP BY 1, 2)""",
          """tenure AS (SELECT * EXCLUDE rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY join_date DESC) AS rn FROM pisl) WHERE rn = 1)""")


@query("cln9_clean_members", """SELECT r.* REPLACE (COALESCE(t.join_date, r.join_date) AS join_date, CASE WHEN t.member_id IS NULL THEN r.cancel_date ELSE t.cancel_date END AS cancel_date,
CASE WHEN t.member_id IS NULL THEN r.churned ELSE t.cancel_date IS NOT NULL END AS churned) FROM repaired r LEFT JOIN tenure t USING (member_id)""", PARSED, LAST, REPAIRED, *MERGED)
def _(t):
    return clean.clean_members(log(t), ["loaded_at", "load_id"], gate=False)


@query("cln9_gated_members", """SELECT r.member_id, COALESCE(t.join_date, r.join_date) AS join_date, t.cancel_date FROM repaired r JOIN tenure t USING (member_id)""",
       PARSED.replace("parsed AS", "parsed0 AS"), "parsed AS (SELECT * REPLACE (COALESCE(contract_source, 'regular') AS contract_source, COALESCE(monthly_price, 50) AS monthly_price) FROM parsed0 WHERE join_date IS NOT NULL)",
       LAST, REPAIRED, *MERGED)
def _(t):
    """With the gate on: rows that would break the limits are filled or dropped first."""
    whole = log(t).where(F.col("join_date").try_cast("timestamp_ntz").isNotNull()).fillna({"contract_source": "regular", "monthly_price": 50.0})
    return clean.clean_members(whole, ["loaded_at", "load_id"], gate=True).select("member_id", "join_date", "cancel_date")


@query("cln10_merge_reenrollments", """SELECT member_id, MIN(join_date) AS join_date, CASE WHEN NOT BOOL_OR(cancel_date IS NULL) THEN MAX(cancel_date) END AS cancel_date,
NOT BOOL_OR(cancel_date IS NULL) AS churned, COUNT(*) AS n_spells, ARG_MIN(load_id, join_date) AS load_id FROM isl GROUP BY member_id, island""", SPELLS)
def _(t):
    spells = t.base("orders").select(
        F.col("o_custkey").alias("member_id"), F.col("o_orderdate").alias("join_date"),
        F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("make_dt_interval(cast(5 + o_orderkey % 400 as int))")).alias("cancel_date"),
        F.col("o_orderkey").alias("load_id"))
    return clean.merge_reenrollments(spells)


@query("cln11_clean_visits", "SELECT * FROM vis", VIS)
def _(t):
    return silver_visits(t)


@query("cln11_clean_actions", "SELECT * FROM act", ACT)
def _(t):
    return silver_actions(t)


@query("cln12_reject_counts", """SELECT * FROM (SELECT 'read' AS step, COUNT(*) AS n FROM visits
UNION ALL SELECT 'duplicate', (SELECT COUNT(*) FROM visits) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM visits))
UNION ALL SELECT 'duration', COUNT(*) FROM (SELECT DISTINCT * FROM visits) WHERE NOT (visit_duration_minutes BETWEEN 5 AND 300)
UNION ALL SELECT 'undated', COUNT(*) FROM (SELECT DISTINCT * FROM visits) WHERE visit_duration_minutes BETWEEN 5 AND 300 AND visit_date IS NULL
UNION ALL SELECT 'kept', COUNT(*) FROM vis)""", VIS)
def _(t):
    return clean.visit_rejects(t.visits)


@query("cln12_observed_rejects", """SELECT * FROM (SELECT 'read' AS step, COUNT(*) AS n FROM dirty
UNION ALL SELECT 'duplicate', (SELECT COUNT(*) FROM dirty) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty))
UNION ALL SELECT 'duration', COUNT(*) FROM (SELECT DISTINCT * FROM dirty) WHERE NOT COALESCE(visit_duration_minutes BETWEEN 5 AND 300, FALSE)
UNION ALL SELECT 'undated', COUNT(*) FROM (SELECT DISTINCT * FROM dirty) WHERE visit_duration_minutes BETWEEN 5 AND 300 AND visit_date IS NULL
UNION ALL SELECT 'kept', COUNT(*) FROM (SELECT DISTINCT * FROM dirty) WHERE visit_duration_minutes BETWEEN 5 AND 300 AND visit_date IS NOT NULL)""",
       """dirty AS (SELECT member_id, location_id, CASE WHEN member_id % 7 = 3 THEN NULL ELSE visit_date END AS visit_date, CASE WHEN member_id % 11 = 5 THEN NULL ELSE visit_duration_minutes END AS visit_duration_minutes FROM visits)""")
def _(t):
    m = F.col("member_id")
    dirty = t.visits.withColumns({"visit_date": F.when(m % 7 != 3, F.col("visit_date")), "visit_duration_minutes": F.when(m % 11 != 5, F.col("visit_duration_minutes"))})
    return clean.write_clean_visits(dirty, scratch_folder(t.spark, "visits"))


@query("cln13_to_utc", """SELECT a.action_id, a.action_date - CASE l.region WHEN 'AFRICA' THEN INTERVAL 3 HOUR WHEN 'AMERICA' THEN INTERVAL (-5) HOUR
WHEN 'ASIA' THEN INTERVAL 9 HOUR WHEN 'EUROPE' THEN INTERVAL 1 HOUR ELSE INTERVAL 4 HOUR END AS action_utc
FROM actions a JOIN locations l USING (location_id)""")
def _(t):
    zones = F.create_map(*[F.lit(x) for x in ("AFRICA", "Africa/Nairobi", "AMERICA", "America/Panama", "ASIA", "Asia/Tokyo",
                                              "EUROPE", "Etc/GMT-1", "MIDDLE EAST", "Asia/Dubai")])
    local = t.actions.join(t.locations.select("location_id", zones[F.col("region")].alias("zone")), "location_id")
    return clean.to_utc(local, "action_date", "zone", "action_utc").select("action_id", "action_utc")


# ---- quality ---------------------------------------------------------------------------------

def dq(suite: str, source: str, *rows: tuple[str, str, str]) -> str:
    parts = [f"SELECT '{suite}' AS suite, '{c}' AS \"check\", '{col}' AS \"column\", CAST(({e}) AS BIGINT) AS n_bad FROM {source}"
             for c, col, e in rows]
    return "SELECT *, n_bad = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")"


def present(*cols: str):
    return [("required", c, "MAX(0)") for c in cols]


def n(cond: str) -> str:
    return f"COUNT(*) FILTER (WHERE {cond})"


@query("dq1_required_columns", dq("schema", "members", *present("member_id", "location_id"), ("required", "email", "MAX(1)")))
def _(t):
    return quality.required_columns(t.members, ["member_id", "location_id", "email"])


@query("dq2_bronze_members", dq("bronze_members", "member_log", *present(
    "member_id", "location_id", "join_date", "churned", "contract_source", "monthly_price"),
    ("null", "member_id", n("member_id IS NULL")), ("duplicate", "member_id", "COUNT(*) - COUNT(DISTINCT member_id)"),
    ("null", "location_id", n("location_id IS NULL")),
    ("unparseable", "join_date", n("join_date IS NOT NULL AND TRY_CAST(join_date AS TIMESTAMP) IS NULL"))))
def _(t):
    return quality.bronze_members(log(t))


@query("dq3_bronze_visits", dq("bronze_visits", "visits", *present("member_id", "location_id", "visit_date", "visit_duration_minutes"),
                               ("unparseable", "visit_date", "0 * COUNT(*)"), ("negative", "visit_duration_minutes", n("visit_duration_minutes < 0"))))
def _(t):
    return quality.bronze_visits(t.visits)


@query("dq4_bronze_actions", dq("bronze_retention_actions", "actions", *present(
    "member_id", "location_id", "action_date", "action_type", "cost"), ("negative", "cost", n("cost < 0"))))
def _(t):
    return quality.bronze_actions(t.actions)


@query("dq5_silver_members", dq("silver_members", "parsed", ("timestamp_type", "join_date", "MAX(0)"), ("null", "join_date", n("join_date IS NULL")),
                                ("before_join", "cancel_date", n("cancel_date < join_date")),
                                ("unknown_value", "contract_source", n("contract_source IS NULL OR contract_source NOT IN ('regular','aggregator')")),
                                ("non_positive", "monthly_price", n("monthly_price <= 0")),
                                ("churned_without_date", "churned", n("churned AND cancel_date IS NULL"))), PARSED)
def _(t):
    return quality.silver_members(clean.parse_dates(log(t), ["join_date", "cancel_date"]))


@query("dq6_silver_visits", dq("silver_visits", "visits", ("timestamp_type", "visit_date", "MAX(0)"),
                               ("too_short", "visit_duration_minutes", n("visit_duration_minutes < 5")),
                               ("too_long", "visit_duration_minutes", n("visit_duration_minutes > 300"))))
def _(t):
    return quality.silver_visits(t.visits)


@query("dq7_gold_member_360", dq("gold_member_360", "m360", *present(
    "member_id", "location_id", "tenure_days", "visit_count_30d", "days_since_last_visit", "retention_action_count"),
    *[("negative", f"visit_count_{w}d", n(f"visit_count_{w}d < 0")) for w in (7, 14, 30, 60, 90)],
    ("negative", "tenure_days", n("tenure_days < 0")), ("below_minus_one", "days_since_last_visit", n("days_since_last_visit < -1")),
    ("above_500", "visit_count_30d", n("visit_count_30d > 500")), ("negative", "retention_action_count", n("retention_action_count < 0"))),
    VIS, ACT, M360)
def _(t):
    return quality.gold_member_360(member_360(t))


@query("dq8_gold_locations", dq("gold_location_aggregates", "kpi", *present("location_id", "active_members", "churn_rate", "mrr"),
                                ("outside_0_1", "churn_rate", n("churn_rate < 0 OR churn_rate > 1")), ("negative", "mrr", n("mrr < 0"))), *GOLD)
def _(t):
    return quality.gold_locations(location_kpis(t))


@query("dq9_orphan_visits", "SELECT 'visits' AS suite, 'orphan' AS \"check\", 'member_id' AS \"column\", COUNT(*) AS n_bad, COUNT(*) = 0 AS passed "
       "FROM visits WHERE member_id NOT IN (SELECT member_id FROM act)", ACT)
def _(t):
    return quality.orphan_rows(t.visits, silver_actions(t), "member_id", "visits")


@query("dq10_future_cancels", dq("silver_members", "members", ("future", "cancel_date", n("cancel_date > TIMESTAMP '2000-06-01 00:00:00'"))))
def _(t):
    return quality.future_cancels(t.members, "2000-06-01 00:00:00")


@query("dq10_mrr_balance", f"SELECT {R('m', 2)} AS member_mrr, {R('l', 2)} AS location_mrr, ABS(m - l) <= 0.01 * GREATEST(nl, 1) AS passed FROM "
       "(SELECT (SELECT SUM(monthly_price) FROM m360 WHERE NOT churned) AS m, (SELECT SUM(mrr) FROM kpi) AS l, (SELECT COUNT(*) FROM kpi) AS nl)", *GOLD)
def _(t):
    m = member_360(t)
    from tenura.operators import gold
    return quality.mrr_balance(m, gold.location_kpis(m))


@query("dq11_freshness", f"SELECT MAX(ts) AS newest, {R('(epoch_us(TIMESTAMP ' + chr(39) + '2024-01-31 12:00:00' + chr(39) + ') - epoch_us(MAX(ts))) / 3.6e9', 4)} AS age_hours, "
       "(epoch_us(TIMESTAMP '2024-01-31 12:00:00') - epoch_us(MAX(ts))) / 3.6e9 <= 24 AS passed FROM events")
def _(t):
    return quality.freshness(t.base("events"), "2024-01-31 12:00:00", 24.0, "ts")


PROFILE_COLS = {"member_id": "bigint", "location_id": "int", "join_date": "timestamp_ntz", "cancel_date": "timestamp_ntz", "churned": "boolean",
                "contract_source": "string", "aggregator_platform": "string", "plan_type": "string", "monthly_price": "double", "gender": "string"}


@query("dq12_column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls, "
    f"{R(f'COUNT(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / COUNT(*)', 1)} AS null_pct, COUNT(DISTINCT {c}) AS n_unique, "
    f"MIN(CAST({c} AS VARCHAR)) AS example FROM members" for c, k in PROFILE_COLS.items()))
def _(t):
    return quality.column_profile(t.members.select(*PROFILE_COLS))
