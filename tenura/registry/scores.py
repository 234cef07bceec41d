"""Classification metrics, score tables and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.operators import churn, monitor
from tenura.registry.base import ACT, R, query, silver_actions
from tenura.registry.views import REF

# Labelled documents with a formula score, and members with theirs.
LAB = "lab AS (SELECT doc_id, quality AS y, CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS p FROM labels)"
MEM = "mem AS (SELECT member_id, location_id, CAST(churned AS BIGINT) AS y, churn_probability AS p FROM members JOIN scored USING (member_id))"
CURVE = """cnt AS (SELECT p, COUNT(*) AS n, SUM(y) AS pos FROM mem GROUP BY 1),
curve AS (SELECT p, n, pos, SUM(n) OVER w AS cn, SUM(pos) OVER w AS cp, (SELECT SUM(n) FROM cnt) AS tn, (SELECT SUM(pos) FROM cnt) AS tp FROM cnt WINDOW w AS (ORDER BY p DESC)),
pr AS (SELECT *, CAST(cp AS DOUBLE) / cn AS pre, CAST(cp AS DOUBLE) / tp AS rec, CASE WHEN cp > 0 THEN 2 * (CAST(cp AS DOUBLE) / cn) * (CAST(cp AS DOUBLE) / tp) / (CAST(cp AS DOUBLE) / cn + CAST(cp AS DOUBLE) / tp) ELSE 0 END AS f1 FROM curve)"""


def labelled(t):
    return t.base("labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") * 7919) % 1000 / F.lit(1000.0)).alias("p"))


def scored_members(t):
    return t.members.join(t.scored, "member_id").select("member_id", "location_id", F.col("churned").cast("bigint").alias("y"),
                                                        F.col("churn_probability").alias("p"))


def best(where: str, by: str) -> str:
    return f"SELECT p AS threshold, {R('pre', 6)} AS precision, {R('rec', 6)} AS recall, {R('f1', 6)} AS f1 FROM pr {where} ORDER BY {R(by, 8)} DESC, p LIMIT 1"


@query("chn1_training_check", f"SELECT COUNT(*) FILTER (WHERE y = 0) AS n_neg, COUNT(*) FILTER (WHERE y = 1) AS n_pos, {R('COUNT(*) FILTER (WHERE y = 0) / CAST(GREATEST(COUNT(*) FILTER (WHERE y = 1), 1) AS DOUBLE)', 6)} AS weight FROM mem", MEM)
def _(t):
    df = scored_members(t)
    weight = churn.check_training_input(df, df, "y")
    return df.agg(F.count_if(F.col("y") == 0).alias("n_neg"), F.count_if(F.col("y") == 1).alias("n_pos"), F.lit(weight).alias("weight"))


@query("chn2_class_weight", f"SELECT COUNT(*) FILTER (WHERE y = 0) AS n_neg, COUNT(*) FILTER (WHERE y = 1) AS n_pos, {R('COUNT(*) FILTER (WHERE y = 0) / CAST(GREATEST(COUNT(*) FILTER (WHERE y = 1), 1) AS DOUBLE)', 6)} AS scale_pos_weight FROM lab", LAB)
def _(t):
    return churn.class_weight(labelled(t), "y")


@query("chn5_f1_threshold", best("", "f1"), MEM, CURVE)
def _(t):
    return churn.f1_threshold(scored_members(t), "y", "p")


@query("chn6_precision_threshold", best("WHERE rec >= 0.5", "pre"), MEM, CURVE)
def _(t):
    return churn.precision_threshold(scored_members(t), "y", "p")


@query("chn7_min_precision_threshold", best("WHERE pre >= 0.3", "f1"), MEM, CURVE)
def _(t):
    return churn.f1_threshold(scored_members(t), "y", "p", min_precision=0.3)


AUC = R("(SELECT SUM(pos * ((tn - tp) - (cn - cp) + (n - pos) / 2.0::DOUBLE)) / (MAX(CAST(tp AS DOUBLE)) * MAX(tn - tp)) FROM curve)", 6)


@query("chn8_auc_roc", f"SELECT {AUC} AS auc_roc", MEM, CURVE)
def _(t):
    return churn.ranking_metrics(scored_members(t), "y", "p").select("auc_roc")


@query("chn8_auc_roc_pairs", f"SELECT {R('SUM(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / COUNT(*)', 6)} AS auc_roc FROM lab a JOIN lab b ON a.y = 1 AND b.y = 0", LAB)
def _(t):
    return churn.ranking_metrics(labelled(t), "y", "p").select("auc_roc")


@query("chn9_auc_pr", f"SELECT {R('SUM((rec - COALESCE(lrec, 0)) * (pre + COALESCE(lpre, 1)) / 2)', 6)} AS auc_pr FROM (SELECT *, LAG(rec) OVER (ORDER BY p DESC) AS lrec, LAG(pre) OVER (ORDER BY p DESC) AS lpre FROM pr)", MEM, CURVE)
def _(t):
    return churn.ranking_metrics(scored_members(t), "y", "p").select("auc_pr")


@query("chn10_confusion", f"""SELECT tn, fp, fn, tp, {R("COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0)", 6)} AS precision, {R("COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0)", 6)} AS recall,
{R("COALESCE(2.0::DOUBLE * tp / NULLIF(2 * tp + fp + fn, 0), 0)", 6)} AS f1 FROM (SELECT COUNT(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, COUNT(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp,
COUNT(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, COUNT(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp FROM mem)""", MEM)
def _(t):
    return churn.threshold_metrics(scored_members(t), "y", "p", 0.5)


@query("chn11_brier", f"SELECT {R('AVG((p - y) * (p - y))', 8)} AS brier_score FROM mem", MEM)
def _(t):
    return churn.brier(scored_members(t), "y", "p")


@query("chn12_calibration", f"SELECT CAST(LEAST(FLOOR(p * 10), 9) AS BIGINT) AS bin, COUNT(*) AS n, {R('AVG(p)', 6)} AS mean_predicted, {R('AVG(CAST(y AS DOUBLE))', 6)} AS fraction_positive FROM mem GROUP BY 1", MEM)
def _(t):
    return churn.calibration(scored_members(t), "y", "p")


@query("chn13_score_table", f"SELECT member_id, {R('churn_probability', 6)} AS churn_probability, CASE WHEN churn_probability >= 0.6 THEN 'high' WHEN churn_probability >= 0.36 THEN 'medium' ELSE 'low' END AS risk_tier FROM scored")
def _(t):
    return churn.score_table(t.scored, threshold=0.6)


@query("chn14_fixed_tiers", """SELECT member_id, CASE WHEN churn_probability < 0.2 THEN 'low' WHEN churn_probability < 0.5 THEN 'medium' WHEN churn_probability < 0.8 THEN 'high' ELSE 'critical' END AS risk_tier,
CASE WHEN churn_probability <= 0.25 THEN 'low' WHEN churn_probability <= 0.5 THEN 'medium' WHEN churn_probability <= 0.75 THEN 'high' ELSE 'critical' END AS quarter_tier FROM scored""")
def _(t):
    p = F.col("churn_probability")
    return t.scored.select("member_id", churn.fixed_tier(p).alias("risk_tier"), churn.fixed_tier(p, (0.25, 0.5, 0.75), True).alias("quarter_tier"))


@query("chn16_precision_at_k", "SELECT SUM(CAST(y AS DOUBLE)) / 100 AS precision_at_k, CAST(100 AS BIGINT) AS k FROM (SELECT y FROM mem ORDER BY p DESC, member_id LIMIT 100)", MEM)
def _(t):
    return churn.precision_at_k(scored_members(t), "y", "p", "member_id", 100)


@query("chn17_latest_scores", """SELECT user_id AS member_id, ts AS predicted_at, ((event_id * 31) % 1000) / 1000.0::DOUBLE AS churn_probability, CAST(30 AS BIGINT) AS horizon_days, event_type AS model_version,
CASE WHEN ((event_id * 31) % 1000) < 200 THEN 'low' WHEN ((event_id * 31) % 1000) < 500 THEN 'medium' WHEN ((event_id * 31) % 1000) < 800 THEN 'high' ELSE 'critical' END AS risk_tier
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, (event_id * 31) % 1000 DESC) AS rn FROM events) WHERE rn = 1""")
def _(t):
    p = (F.col("event_id") * 31) % 1000 / F.lit(1000.0)
    table = t.base("events").select(F.col("user_id").alias("member_id"), F.col("ts").alias("predicted_at"), p.alias("churn_probability"),
                                    F.lit(30).cast("bigint").alias("horizon_days"), F.col("event_type").alias("model_version"))
    return churn.latest_scores(table.withColumn("risk_tier", churn.fixed_tier(F.col("churn_probability"))))


# ---- monitoring ------------------------------------------------------------------------------

EV_REF = "2024-01-31 00:00:00"
WIN = """win AS (SELECT *, CAST(hour(ts) AS DOUBLE) AS hour, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 'current' ELSE 'reference' END AS "window"
  FROM events WHERE ts < TIMESTAMP '2024-01-31' AND ts >= TIMESTAMP '2024-01-01')"""


def windows(t):
    df = t.base("events").withColumn("hour", F.hour(F.col("ts").cast("timestamp")).cast("double"))
    tagged = monitor.split_windows(df, "ts", EV_REF, reference_days=20, current_days=10)
    return tagged.filter("window = 'reference'"), tagged.filter("window = 'current'")


def ks_sql(alpha: float = 0.05) -> str:
    return f"""ksd AS (SELECT 'value' AS feature, value AS x, "window" = 'current' AS c FROM win WHERE value IS NOT NULL UNION ALL SELECT 'hour', hour, "window" = 'current' FROM win),
ksc AS (SELECT feature, x, COUNT(*) FILTER (WHERE NOT c) AS r, COUNT(*) FILTER (WHERE c) AS u FROM ksd GROUP BY 1, 2),
ksr AS (SELECT feature, SUM(r) OVER w AS cr, SUM(u) OVER w AS cu, SUM(r) OVER (PARTITION BY feature) AS nr, SUM(u) OVER (PARTITION BY feature) AS nu FROM ksc WINDOW w AS (PARTITION BY feature ORDER BY x)),
kss AS (SELECT feature, MAX(nr)::BIGINT AS n_reference, MAX(nu)::BIGINT AS n_current, MAX(ABS(CAST(cr AS DOUBLE) / nr - CAST(cu AS DOUBLE) / nu)) AS d FROM ksr GROUP BY 1),
ksp AS (SELECT *, sqrt(CAST(n_reference AS DOUBLE) * n_current / (n_reference + n_current)) * d AS x FROM kss),
ks AS (SELECT feature, n_reference, n_current, {R("d", 6)} AS statistic, pv FROM (SELECT *, CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE GREATEST(0, LEAST(1,
  list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * k * k * x * x))))) END AS pv FROM ksp))"""


@query("mon1_ks_test", f"SELECT feature, n_reference, n_current, statistic, {R('pv', 6)} AS p_value, pv < 0.05 AS drifted FROM ks", WIN, ks_sql())
def _(t):
    return monitor.ks_test(*windows(t), ["value", "hour", "not_there"])


def psi_ctes(name: str, col: str) -> str:
    edges = ", ".join(f"quantile_cont({col}, {i / 10})" for i in range(11))
    return f"""{name}q AS (SELECT DISTINCT e FROM (SELECT UNNEST([{edges}]) AS e FROM win WHERE "window" = 'reference')),
{name}b AS (SELECT e AS lo, LEAD(e) OVER (ORDER BY e) AS hi, ROW_NUMBER() OVER (ORDER BY e) AS b, COUNT(*) OVER () AS m FROM {name}q),
{name}c AS (SELECT b, m, COUNT(*) FILTER (WHERE "window" = 'reference') AS r, COUNT(*) FILTER (WHERE "window" = 'current') AS u FROM {name}b
  LEFT JOIN win ON {col} >= lo AND ({col} < hi OR (b = m - 1 AND {col} = hi)) WHERE hi IS NOT NULL GROUP BY 1, 2),
{name}s AS (SELECT CASE WHEN r = 0 THEN 1e-6 ELSE CAST(r AS DOUBLE) / SUM(r) OVER () END AS e, CASE WHEN u = 0 THEN 1e-6 ELSE CAST(u AS DOUBLE) / SUM(u) OVER () END AS a, u FROM {name}c),
{name} AS (SELECT {R("SUM((a - e) * ln(a / e))", 6)} AS psi, COUNT(*) AS n_bins,
  (SELECT COUNT({col}) FROM win WHERE "window" = 'current') - SUM(u)::BIGINT AS n_out_of_range FROM {name}s)"""


@query("mon2_psi", "SELECT * FROM pv", WIN, psi_ctes("pv", "value"))
def _(t):
    return monitor.psi(*windows(t), "value")


@query("mon3_prediction_drift", "SELECT psi, psi > 0.2 AS is_drifted FROM pv", WIN, psi_ctes("pv", "value"))
def _(t):
    return monitor.prediction_drift(*windows(t), "value")


def summary(col: str) -> str:
    parts = []
    for tag in ("reference", "current"):
        f = f"FILTER (WHERE \"window\" = '{tag}')"
        parts += [f"{R(f'AVG({col}) {f}', 6)} AS mean_{tag}", f"{R(f'STDDEV_SAMP({col}) {f}', 6)} AS std_{tag}", f"MIN({col}) {f} AS min_{tag}", f"MAX({col}) {f} AS max_{tag}"]
    return f"SELECT '{col}' AS feature, {', '.join(parts)} FROM win"


@query("mon4_drift_report", f"""SELECT ks.feature, n_reference, n_current, statistic, {R("pv", 6)} AS p_value, pv < 0.05 AS drifted, s.* EXCLUDE (feature), z.psi, z.n_out_of_range FROM ks
JOIN ({summary("value")} UNION ALL {summary("hour")}) s USING (feature) JOIN (SELECT 'value' AS feature, psi, n_out_of_range FROM pv UNION ALL SELECT 'hour', psi, n_out_of_range FROM ph) z USING (feature)""",
       WIN, ks_sql(), psi_ctes("pv", "value"), psi_ctes("ph", "hour"))
def _(t):
    return monitor.drift_report(*windows(t), ["value", "hour"])


@query("mon4_drift_histogram", """SELECT CAST("window" = 'current' AS INT) AS is_cur, b AS bin, COUNT(value) FILTER (WHERE i = b) AS n FROM (SELECT "window", value, CAST(LEAST(FLOOR((value - lo) / (hi - lo) * 10), 9) AS BIGINT) AS i
FROM win, (SELECT MIN(value) AS lo, MAX(value) AS hi FROM win)), (SELECT UNNEST(range(0, 10)) AS b) GROUP BY 1, 2""", WIN)
def _(t):
    return monitor.drift_histograms(*windows(t), "value").select("is_cur", "bin", "n")


@query("mon5_performance_gate", f"""SELECT 'auc_roc' AS metric, {AUC} AS value, 0.8::DOUBLE AS threshold, {AUC} >= 0.8 AS passed
UNION ALL SELECT 'precision_at_k', v, 0.4, v >= 0.4 FROM (SELECT SUM(CAST(y AS DOUBLE)) / 100 AS v FROM (SELECT y FROM mem ORDER BY p DESC, member_id LIMIT 100))
UNION ALL SELECT 'brier_score', v, 0.25, v <= 0.25 FROM (SELECT {R("AVG((p - y) * (p - y))", 8)} AS v FROM mem)""", MEM, CURVE)
def _(t):
    return monitor.performance_gate(scored_members(t), "y", "p", "member_id")


@query("mon6_retrain_triggers", """SELECT model, d AS trigger_day FROM pick""",
       "low AS (SELECT event_type AS model, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 2 HAVING MIN(value) < 0.5)",
       """pick AS (WITH RECURSIVE walk AS (SELECT model, MIN(d) AS d FROM low GROUP BY 1 UNION ALL
  SELECT w.model, (SELECT MIN(l.d) FROM low l WHERE l.model = w.model AND l.d >= w.d + 7) FROM walk w WHERE w.d IS NOT NULL)
  SELECT * FROM walk WHERE d IS NOT NULL)""")
def _(t):
    return monitor.retrain_triggers(t.base("events"), "event_type", "ts", "value", threshold=0.5).withColumnRenamed("event_type", "model")


@query("mon7_churn_rate_gap", f"SELECT location_id, {R('a', 6)} AS actual_churn_rate, {R('b', 6)} AS predicted_churn_rate, {R(f'ABS({R(chr(97), 6)} - {R(chr(98), 6)}) * 100', 4)} AS difference_pp, "
       f"{R(f'ABS({R(chr(97), 6)} - {R(chr(98), 6)}) * 100', 4)} > 2.0 AS alert FROM (SELECT location_id, AVG(CAST(y AS DOUBLE)) AS a, AVG(p) AS b FROM mem GROUP BY 1)", MEM)
def _(t):
    return monitor.churn_rate_gap(scored_members(t).withColumn("y", F.col("y") == 1), "location_id", "y", "p")


@query("mon8_action_coverage", f"SELECT COUNT(*) AS high_risk_members, COUNT(*) FILTER (WHERE a) AS contacted, {R('AVG(CAST(a AS DOUBLE))', 6)} AS coverage, AVG(CAST(a AS DOUBLE)) >= 0.5 AS passed "
       "FROM (SELECT member_id IN (SELECT member_id FROM act) AS a FROM scored WHERE churn_probability > 0.5)", ACT)
def _(t):
    return monitor.action_coverage(t.scored, silver_actions(t))


@query("mon9_window_selection", """SELECT "window", COUNT(*) AS n, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM win GROUP BY 1""", WIN)
def _(t):
    df = monitor.split_windows(t.base("events"), "ts", EV_REF, 20, 10)
    return df.groupBy("window").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
