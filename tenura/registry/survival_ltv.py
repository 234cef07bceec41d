"""Survival curves, tests and models, and lifetime value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenura.functions import days_between, flag, round_dec
from tenura.operators import features, gold, ltv, survival
from tenura.registry.base import ACT, M360, R, TREF, VIS, member_360, normal_p, once, query, silver_visits
from tenura.registry.views import REF

FRAME = f"""sf AS (SELECT * FROM (SELECT *, CAST(cancel_date IS NOT NULL AS BIGINT) AS event,
  {R(f"date_diff('day', join_date, COALESCE(cancel_date, {TREF})) / 30.44::DOUBLE", 1)} AS duration FROM members) WHERE duration > 0)"""


def frame(t):
    return survival.survival_frame(t.members, REF)


@query("srv1_survival_frame", "SELECT member_id, event, duration FROM sf", FRAME)
def _(t):
    return frame(t).select("member_id", "event", "duration")


def km_ctes(by: str, source: str = "sf") -> tuple[str, ...]:
    part = f"PARTITION BY {by} " if by else ""
    k = f"{by}, " if by else ""
    z = "1.959963984540054::DOUBLE"
    return (f"kt AS (SELECT {k}duration, SUM(event)::BIGINT AS events, COUNT(*) AS n FROM {source} GROUP BY ALL)",
            f"kr AS (SELECT *, SUM(n) OVER ({part}ORDER BY duration DESC) AS at_risk FROM kt)",
            f"""kk AS (SELECT *, SUM(CASE WHEN events < at_risk THEN ln(1 - CAST(events AS DOUBLE) / at_risk) ELSE 0 END) OVER w AS l,
  SUM(CASE WHEN events < at_risk THEN CAST(events AS DOUBLE) / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS v, MAX(CAST(events = at_risk AS INT)) OVER w = 1 AS dead
  FROM kr WINDOW w AS ({part}ORDER BY duration))""",
            f"""km AS (SELECT {k}duration, CAST(at_risk AS BIGINT) AS at_risk, events, n - events AS censored, {R("CASE WHEN dead THEN 0 ELSE exp(l) END", 6)} AS survival,
  {R(f"CASE WHEN dead THEN 0 WHEN l = 0 THEN 1 ELSE exp(-exp(ln(-l) - {z} * sqrt(v) / l)) END", 6)} AS ci_lower,
  {R(f"CASE WHEN dead THEN 0 WHEN l = 0 THEN 1 ELSE exp(-exp(ln(-l) + {z} * sqrt(v) / l)) END", 6)} AS ci_upper FROM kk)""")


@query("srv2_kaplan_meier", "SELECT * FROM km", FRAME, *km_ctes(""))
def _(t):
    return survival.kaplan_meier(frame(t))


@query("srv3_stratified_kaplan_meier", "SELECT * FROM km", FRAME, *km_ctes("contract_source"))
def _(t):
    return survival.kaplan_meier(frame(t), ["contract_source"])


@query("srv4_median_survival", """SELECT plan_type, COALESCE(MIN(duration) FILTER (WHERE survival <= 0.5), 'infinity'::DOUBLE) AS median,
COALESCE(MIN(duration) FILTER (WHERE ci_lower <= 0.5), 'infinity'::DOUBLE) AS median_lower, COALESCE(MIN(duration) FILTER (WHERE ci_upper <= 0.5), 'infinity'::DOUBLE) AS median_upper FROM km GROUP BY 1""",
       FRAME, *km_ctes("plan_type"))
def _(t):
    return survival.median_survival(survival.kaplan_meier(frame(t), ["plan_type"]), ["plan_type"])


def logrank_ctes(cond: str) -> tuple[str, ...]:
    return (f"lt AS (SELECT duration, SUM(event) AS d, COUNT(*) AS c, SUM(event) FILTER (WHERE {cond}) AS d1, COUNT(*) FILTER (WHERE {cond}) AS c1 FROM sf GROUP BY 1)",
            "lr AS (SELECT COALESCE(d1, 0) AS d1, d, CAST(SUM(c) OVER w AS DOUBLE) AS n, CAST(SUM(c1) OVER w AS DOUBLE) AS n1 FROM lt WINDOW w AS (ORDER BY duration DESC))",
            "ls AS (SELECT SUM(d1)::BIGINT AS o, SUM(d * n1 / n) AS e, SUM(CASE WHEN n > 1 THEN n1 * (n - n1) * d * (n - d) / (n * n * (n - 1)) ELSE 0 END) AS v FROM lr)",
            "lx AS (SELECT o, e, (o - e) * (o - e) / v AS x FROM ls)")


LOGRANK = f"SELECT o AS observed, {R('e', 6)} AS expected, {R('x', 6)} AS test_statistic, {R(normal_p('sqrt(x)'), 6)} AS p_value FROM lx"


@query("srv5_log_rank_source", LOGRANK, FRAME, *logrank_ctes("contract_source = 'regular'"))
def _(t):
    return survival.log_rank(frame(t), F.col("contract_source") == "regular")


@query("srv5_log_rank_january", LOGRANK, FRAME, *logrank_ctes("month(join_date) = 1"))
def _(t):
    return survival.log_rank(frame(t), F.month("join_date") == 1)


@query("srv6_january_curves", "SELECT january, duration, survival FROM km", FRAME, "sj AS (SELECT *, month(join_date) = 1 AS january FROM sf)", *km_ctes("january", "sj"))
def _(t):
    return survival.kaplan_meier(frame(t).withColumn("january", F.month("join_date") == 1), ["january"]).select("january", "duration", "survival")


@query("srv6_quarter_curves", "SELECT quarter, duration, survival FROM km", FRAME, "sq AS (SELECT *, quarter(join_date) AS quarter FROM sf)", *km_ctes("quarter", "sq"))
def _(t):
    df = frame(t).withColumn("quarter", F.quarter("join_date").cast("bigint"))
    return survival.kaplan_meier(df, ["quarter"]).select("quarter", "duration", "survival")


COX = ["visit_frequency", "is_january", "is_aggregator", "price", "age"]


def priced(t):
    """The survival frame with ``price``: members without one take the median, so that none is left out."""
    df = frame(t)
    median = features.fit_percentiles(df, ["monthly_price"], 0.5)["monthly_price"]
    return df.withColumn("price", F.coalesce("monthly_price", F.lit(median)))


def cox_frame(t):
    """Covariates capped at the 99th percentile and standardised."""
    totals = silver_visits(t).groupBy("member_id").agg(F.count("*").alias("_v"))
    df = priced(t).join(totals, "member_id", "left").select(
        "member_id", "duration", "event", "contract_source",
        (F.coalesce("_v", F.lit(0)) / F.greatest("duration", F.lit(0.5))).alias("visit_frequency"),
        flag(F.month("join_date") == 1).cast("double").alias("is_january"),
        flag(F.col("contract_source") == "aggregator").cast("double").alias("is_aggregator"),
        "price", F.col("age").cast("double").alias("age"))
    capped = features.winsorise(df, features.fit_percentiles(df, ["visit_frequency"], 0.99))
    return features.standardise(capped, ["visit_frequency", "price", "age"])


def fitted(t):
    df = cox_frame(t)
    return df, once(t, "cox", lambda: survival.fit_cox(df, COX, penalizer=0.1))


@query("srv7_cox_coefficients")
def _(t):
    _, m = fitted(t)
    return survival.cox_summary(t.spark, m).select("covariate", "coef", "hazard_ratio")


@query("srv8_cox_summary")
def _(t):
    return survival.cox_summary(t.spark, fitted(t)[1])


# A fit of two covariates, whose Newton steps SQL can take: each step sums up every time's tied events one by one.
TWO, PENALTY, STEPS = ["aggregator", "age50"], 0.01, 7


def two_frame(t):
    return frame(t).withColumns({"aggregator": flag(F.col("contract_source") == "aggregator").cast("double"), "age50": F.col("age") / 50.0})


def two_fitted(t):
    df = two_frame(t)
    return df, once(t, "cox of two", lambda: survival.fit_cox(df, TWO, penalizer=PENALTY, tol=1e-10))


def newton_ctes() -> tuple[str, ...]:
    out = ["c0 AS (SELECT member_id, duration, event, CAST(contract_source = 'aggregator' AS DOUBLE) AS a0, age / 50::DOUBLE AS b0 FROM sf)",
           "cx AS (SELECT member_id, duration, event, a0 - (SELECT AVG(a0) FROM c0) AS a, b0 - (SELECT AVG(b0) FROM c0) AS b FROM c0)",
           f"nn AS (SELECT COUNT(*) * {PENALTY}::DOUBLE AS pen FROM cx)",
           "be0 AS (SELECT 0::DOUBLE AS p, 0::DOUBLE AS q)"]
    for k in range(STEPS + 1):
        sums = lambda lead, w, when: ", ".join(
            f"COALESCE(SUM({w}{x}) {when}, 0) AS {lead}{n}" for n, x in (("", ""), ("a", " * a"), ("b", " * b"), ("aa", " * a * a"), ("ab", " * a * b"), ("bb", " * b * b")))
        later = ", ".join(f"SUM(w{n}) OVER (ORDER BY duration DESC) AS r{n}" for n in ("", "a", "b", "aa", "ab", "bb"))
        out += [
            f"w{k} AS (SELECT duration, event, a, b, exp(p * a + q * b) AS w FROM cx, be{k})",
            f"t{k} AS (SELECT duration, SUM(event)::BIGINT AS d, {sums('w', 'w', '')}, {sums('e', 'w', 'FILTER (WHERE event = 1)')}, COALESCE(SUM(a) FILTER (WHERE event = 1), 0) AS sa, COALESCE(SUM(b) FILTER (WHERE event = 1), 0) AS sb FROM w{k} GROUP BY 1)",
            f"r{k} AS (SELECT *, {later} FROM t{k})",
            f"l{k} AS (SELECT *, r - f * e AS phi, (ra - f * ea) / (r - f * e) AS ma, (rb - f * eb) / (r - f * e) AS mb FROM (SELECT *, UNNEST(range(0, d)) / d::DOUBLE AS f FROM r{k} WHERE d > 0))",
            f"""g{k} AS (SELECT (SELECT SUM(p * sa + q * sb) FROM t{k}, be{k}) - SUM(ln(phi)) AS ll, (SELECT SUM(sa) FROM t{k}) - SUM(ma) AS ga, (SELECT SUM(sb) FROM t{k}) - SUM(mb) AS gb,
  SUM((raa - f * eaa) / phi - ma * ma) AS iaa, SUM((rab - f * eab) / phi - ma * mb) AS iab, SUM((rbb - f * ebb) / phi - mb * mb) AS ibb FROM l{k})""",
            f"v{k} AS (SELECT *, (ibb + pen) / det AS vaa, -iab / det AS vab, (iaa + pen) / det AS vbb FROM (SELECT *, (iaa + pen) * (ibb + pen) - iab * iab AS det FROM g{k}, nn))",
            f"be{k + 1} AS (SELECT p + vaa * (ga - pen * p) + vab * (gb - pen * q) AS p, q + vab * (ga - pen * p) + vbb * (gb - pen * q) AS q FROM be{k}, v{k})"]
    out += [f"fit AS (SELECT * FROM be{STEPS}, v{STEPS})",
            "co AS (SELECT 'aggregator' AS covariate, p AS coef, sqrt(vaa) AS se, ll FROM fit UNION ALL SELECT 'age50', q, sqrt(vbb), ll FROM fit)",
            f"mt AS (SELECT duration, any_value(d) AS d, any_value(sa) AS sa, any_value(sb) AS sb, AVG(ma) AS ma, AVG(mb) AS mb FROM l{STEPS} GROUP BY 1)",
            "rk AS (SELECT *, SUM(d) OVER (ORDER BY duration) - (d - 1) / 2::DOUBLE AS k FROM mt)",
            "rg AS (SELECT d, k - (SELECT SUM(k * d) / SUM(d) FROM rk) AS g, sa - d * ma AS ua, sb - d * mb AS ub FROM rk)",
            "us AS (SELECT SUM(g * ua) AS ua, SUM(g * ub) AS ub, SUM(d * g * g) AS spread, SUM(d)::DOUBLE AS n FROM rg)",
            "ph AS (SELECT 'aggregator' AS covariate, pow(n * (vaa * ua + vab * ub), 2) / (n * vaa * spread) AS x FROM us, fit UNION ALL SELECT 'age50', pow(n * (vab * ua + vbb * ub), 2) / (n * vbb * spread) FROM us, fit)"]
    return tuple(out)


NEWTON = (FRAME, *newton_ctes())
Z95 = "1.959963984540054::DOUBLE"


def rounded(df, *names):
    return df.withColumns({n: round_dec(F.col(n), 6) for n in names})


@query("srv7_cox_newton", f"SELECT covariate, {R('coef', 6)} AS coef, {R('exp(coef)', 6)} AS hazard_ratio FROM co", *NEWTON)
def _(t):
    return rounded(survival.cox_summary(t.spark, two_fitted(t)[1]).select("covariate", "coef", "hazard_ratio"), "coef", "hazard_ratio")


@query("srv8_cox_newton_summary", f"""SELECT covariate, {R('coef', 6)} AS coef, {R('exp(coef)', 6)} AS hazard_ratio, {R('se', 6)} AS se, {R('coef / se', 6)} AS z, {R(normal_p('abs(coef / se)'), 6)} AS p,
{R(f'coef - {Z95} * se', 6)} AS ci_lower, {R(f'coef + {Z95} * se', 6)} AS ci_upper, {R('ll', 6)} AS log_likelihood, {R('4 - 2 * ll', 6)} AS partial_aic FROM co""", *NEWTON)
def _(t):
    out = survival.cox_summary(t.spark, two_fitted(t)[1])
    return rounded(out, *out.columns[1:])


@query("srv12_proportional_hazards_newton", f"SELECT covariate, {R('x', 6)} AS test_statistic, {R(normal_p('sqrt(x)'), 6)} AS p_value, x > 3.841458820694124 AS violated FROM ph", *NEWTON)
def _(t):
    return rounded(survival.proportional_hazards_test(t.spark, two_fitted(t)[1]), "test_statistic", "p_value")


@query("srv12_schoenfeld_newton", f"SELECT member_id, duration, {R('a - ma', 6)} AS resid_aggregator, {R('b - mb', 6)} AS resid_age50 FROM cx JOIN mt USING (duration) WHERE event = 1", *NEWTON)
def _(t):
    df, m = two_fitted(t)
    return rounded(survival.schoenfeld_residuals(m, df), "resid_aggregator", "resid_age50")


@query("srv9_concordance")
def _(t):
    df, m = fitted(t)
    return survival.concordance(df, m.log_hazard())


@query("srv9_concordance_age", f"""SELECT {R("SUM(CASE WHEN a.age > b.age THEN 1.0 WHEN a.age = b.age THEN 0.5 ELSE 0 END) / COUNT(*)", 6)} AS concordance, COUNT(*) AS pairs,
{R("AVG(CAST(a.age = b.age AS DOUBLE))", 6)} AS undecided FROM sf a JOIN sf b ON a.event = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event = 0))""", FRAME)
def _(t):
    return survival.concordance(frame(t), F.col("age"))


@query("srv9_concordance_many_risks", f"""SELECT {R("SUM(CASE WHEN a.r > b.r THEN 1.0 WHEN a.r = b.r THEN 0.5 ELSE 0 END) / COUNT(*)", 6)} AS concordance, COUNT(*) AS pairs,
{R("AVG(CAST(a.r = b.r AS DOUBLE))", 6)} AS undecided FROM rf a JOIN rf b ON a.event = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event = 0))""",
       FRAME, "rf AS (SELECT duration, event, (member_id * 7919) % 997 AS r FROM sf)")
def _(t):
    return survival.concordance(frame(t), (F.col("member_id") * 7919) % 997)


# A model with fixed coefficients, so that predictions can be stated in SQL.
FIXED = {"is_aggregator": 0.4, "price50": -0.6}


def fixed_frame(t):
    return priced(t).withColumns({
        "monthly_price": F.col("price"), "is_aggregator": flag(F.col("contract_source") == "aggregator").cast("double"), "price50": F.col("price") / 50})


def fixed_model(t):
    df = fixed_frame(t)
    return df, survival.cox_with_coefficients(df, list(FIXED), list(FIXED.values()))


BASE = (FRAME, "fp AS (SELECT * REPLACE (COALESCE(monthly_price, (SELECT quantile_cont(monthly_price, 0.5) FROM sf)) AS monthly_price) FROM sf)",
        "ff AS (SELECT *, CAST(contract_source = 'aggregator' AS DOUBLE) AS xa, monthly_price / 50 AS xb FROM fp)",
        "fx AS (SELECT *, exp(0.4::DOUBLE * (xa - (SELECT AVG(xa) FROM ff)) - 0.6::DOUBLE * (xb - (SELECT AVG(xb) FROM ff))) AS hr FROM ff)",
        "ft AS (SELECT duration, SUM(event) AS d, SUM(hr) AS w FROM fx GROUP BY 1)",
        "fh AS (SELECT duration, d, SUM(d / r) OVER (ORDER BY duration) AS h FROM (SELECT duration, d, SUM(w) OVER (ORDER BY duration DESC) AS r FROM ft) WHERE d > 0)",
        "s0 AS (SELECT tt AS t, exp(-COALESCE((SELECT MAX(h) FROM fh WHERE duration <= tt), 0)) AS s FROM (SELECT UNNEST(range(1, 37)) AS tt))")


@query("srv10_predict_survival", "SELECT member_id, " + ", ".join(f"{R(f'pow((SELECT s FROM s0 WHERE t = {k}), hr)', 6)} AS s{k}" for k in (1, 6, 12, 24, 36)) + " FROM fx", *BASE)
def _(t):
    df, m = fixed_model(t)
    ks = [1, 6, 12, 24, 36]
    return survival.predict_survival(m, df, ks, "s").select("member_id", *[round_dec(F.col("s")[i], 6).alias(f"s{k}") for i, k in enumerate(ks)])


@query("srv11_median_survival", "SELECT member_id, LEAST(COALESCE((SELECT MIN(duration) FROM fh WHERE h * hr >= ln(2)), 120), 120) AS median_survival FROM fx", *BASE)
def _(t):
    df, m = fixed_model(t)
    return survival.predict_median(m, df).select("member_id", "median_survival")


@query("srv12_proportional_hazards")
def _(t):
    return survival.proportional_hazards_test(t.spark, fitted(t)[1])


@query("srv12_schoenfeld_residuals")
def _(t):
    df, m = fitted(t)
    return survival.schoenfeld_residuals(m, df)


@query("srv13_model_comparison")
def _(t):
    df, m = fitted(t)
    return survival.compare_models(df, COX, m)


VALUE = ("lv AS (SELECT member_id, contract_source, monthly_price AS p, (SELECT SUM(pow(s, hr)) FROM s0) AS ten, (SELECT SUM(pow(s, hr) / pow(1.01::DOUBLE, t)) FROM s0) AS disc, "
         "(SELECT SUM(pow(s, hr) / pow(1 + 0.12::DOUBLE / 12, t)) FROM s0) AS disc2 FROM fx)",
         f"lt1 AS (SELECT member_id, contract_source, {R('ten', 2)} AS expected_remaining_tenure, {R('p', 2)} AS expected_monthly_revenue, {R('p * disc', 2)} AS ltv FROM lv)")


def ltv_rows(t):
    df, m = fixed_model(t)
    return ltv.estimate_ltv(df, m)


@query("ltv1_estimate", "SELECT * EXCLUDE (contract_source) FROM lt1", *BASE, *VALUE)
def _(t):
    return ltv_rows(t)


# All members, so that those without a price take the median.
ALL = ("ga AS (SELECT sf.member_id, COALESCE(monthly_price, (SELECT quantile_cont(monthly_price, 0.5) FROM sf)) AS p, "
       "exp(0.4::DOUBLE * (CAST(contract_source = 'aggregator' AS DOUBLE) - (SELECT AVG(xa) FROM ff))) AS hr FROM sf)",)


@query("ltv2_yearly_discount", f"SELECT member_id, {R('(SELECT SUM(pow(s, hr)) FROM s1)', 2)} AS expected_remaining_tenure, {R('p', 2)} AS expected_monthly_revenue, "
       f"{R('p * (SELECT SUM(pow(s, hr) / pow(1 + 0.12::DOUBLE / 12, t)) FROM s1)', 2)} AS ltv FROM ga", FRAME,
       "ff AS (SELECT *, CAST(contract_source = 'aggregator' AS DOUBLE) AS xa FROM sf)", *ALL,
       "gt AS (SELECT duration, SUM(event) AS d, SUM(hr) AS w FROM sf JOIN ga USING (member_id) GROUP BY 1)",
       "gh AS (SELECT duration, SUM(d / r) OVER (ORDER BY duration) AS h FROM (SELECT duration, d, SUM(w) OVER (ORDER BY duration DESC) AS r FROM gt) WHERE d > 0)",
       "s1 AS (SELECT tt AS t, exp(-COALESCE((SELECT MAX(h) FROM gh WHERE duration <= tt), 0)) AS s FROM (SELECT UNNEST(range(1, 37)) AS tt))")
def _(t):
    df = frame(t).withColumn("is_aggregator", flag(F.col("contract_source") == "aggregator").cast("double"))
    m = survival.cox_with_coefficients(df, ["is_aggregator"], [0.4])
    return ltv.estimate_ltv(df, m, rate=0.12 / 12, fill_price="median")


@query("ltv3_segments", "SELECT member_id, ltv, CASE WHEN ltv >= (SELECT quantile_cont(ltv, 0.75) FROM lt1) THEN 'high' WHEN ltv >= (SELECT quantile_cont(ltv, 0.25) FROM lt1) THEN 'medium' ELSE 'low' END AS ltv_segment FROM lt1", *BASE, *VALUE)
def _(t):
    return ltv.segment_ltv(ltv_rows(t).select("member_id", "ltv"))


@query("ltv4_summary", f"SELECT contract_source, COUNT(*) AS count, {R('AVG(ltv)', 4)} AS mean_ltv, {R('quantile_cont(ltv, 0.5)', 4)} AS median_ltv, {R('STDDEV_SAMP(ltv)', 4)} AS std_ltv FROM lt1 GROUP BY 1", *BASE, *VALUE)
def _(t):
    rows = ltv_rows(t).join(t.members.select("member_id", "contract_source"), "member_id")
    return ltv.ltv_summary(rows, ["contract_source"])


# ---- cohorts by value --------------------------------------------------------------------------

MEANS = {"churn_rate": "CAST(churned AS DOUBLE)", "avg_tenure_days": "CAST(tenure_days AS DOUBLE)", "avg_visits_30d": "CAST(visit_count_30d AS DOUBLE)", "avg_ltv": "ltv"}


def side(tag: str, source: str) -> str:
    where = f"FILTER (WHERE contract_source = '{source}')"
    parts = [f"COUNT(*) {where} AS n_members_{tag}", f"COALESCE(SUM(monthly_price) FILTER (WHERE contract_source = '{source}' AND NOT churned), 0) AS mrr_{tag}"]
    for n, c in MEANS.items():
        parts += [f"AVG({c}) {where} AS {n}_{tag}", f"VAR_SAMP({c}) {where} / COUNT({c}) {where} AS v_{n}_{tag}"]
    return ", ".join(parts)


@query("gld9_cohort_report", "SELECT n_members_a, n_members_b, " + ", ".join(
    f"{R(f'{n}_a', 4 if n != 'mrr' else 2)} AS {n}_a, {R(f'{n}_b', 4 if n != 'mrr' else 2)} AS {n}_b, {R(f'{n}_a - {n}_b', 4 if n != 'mrr' else 2)} AS {n}_difference" for n in (*MEANS, "mrr"))
    + ", concat_ws(',', " + ", ".join(f"CASE WHEN ABS({n}_a - {n}_b) / sqrt(v_{n}_a + v_{n}_b) > 1.959963984540054 THEN '{n}' END" for n in MEANS) + ") AS significant_metrics "
    f"FROM (SELECT {side('a', 'regular')}, {side('b', 'aggregator')} FROM m360 LEFT JOIN (SELECT member_id, ltv FROM lt1) l USING (member_id))", VIS, ACT, M360, *BASE, *VALUE)
def _(t):
    wide = member_360(t).join(ltv_rows(t).select("member_id", "ltv"), "member_id", "left")
    src = F.col("contract_source")
    return gold.cohort_report(wide, src == "regular", src == "aggregator")


# ---- time to fulfilment: strata that reach their median ----------------------------------------

FULFILLED = """ofr AS (SELECT o_orderpriority AS priority, CAST(o_orderstatus = 'F' AS BIGINT) AS event, CAST(date_diff('day', o_orderdate, s) AS DOUBLE) AS duration
  FROM orders JOIN (SELECT l_orderkey, MAX(l_shipdate) AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE date_diff('day', o_orderdate, s) > 0)"""


def fulfilled(t):
    ships = t.base("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    days = days_between(F.col("s"), F.col("o_orderdate"))
    return t.base("orders").join(ships, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("priority"), flag(F.col("o_orderstatus") == "F").alias("event"), days.cast("double").alias("duration")).filter("duration > 0")


@query("srv3_fulfilment_curves", "SELECT * FROM km", FULFILLED, *km_ctes("priority", "ofr"))
def _(t):
    return survival.kaplan_meier(fulfilled(t), ["priority"])


@query("srv4_median_fulfilment", """SELECT priority, COALESCE(MIN(duration) FILTER (WHERE survival <= 0.5), 'infinity'::DOUBLE) AS median,
COALESCE(MIN(duration) FILTER (WHERE ci_lower <= 0.5), 'infinity'::DOUBLE) AS median_lower, COALESCE(MIN(duration) FILTER (WHERE ci_upper <= 0.5), 'infinity'::DOUBLE) AS median_upper FROM km GROUP BY 1""",
       FULFILLED, *km_ctes("priority", "ofr"))
def _(t):
    return survival.median_survival(survival.kaplan_meier(fulfilled(t), ["priority"]), ["priority"])


# ---- accelerated failure time at given coefficients --------------------------------------------

THETA = (3.9, -0.05, 0.02, -0.4)  # intercept, aggregator, age50, log scale


def aft_sql(family: str) -> str:
    z = "((ln(duration) - (3.9::DOUBLE - 0.05::DOUBLE * a0 + 0.02::DOUBLE * b0)) / exp(-0.4::DOUBLE))"
    ll, a = {"weibull": (f"event * {z} - exp({z})", f"event - exp({z})"),
             "log_logistic": (f"event * {z} - (1 + event) * ln(1 + exp({z}))", f"event - (1 + event) * exp({z}) / (1 + exp({z}))")}[family]
    s = "exp(-0.4::DOUBLE)"
    return (f"SELECT '{family}' AS family, COUNT(*) AS n, {R(f'SUM({ll} - event * (-0.4::DOUBLE + ln(duration)))', 4)} AS log_likelihood, {R(f'SUM(-({a}) / {s})', 4)} AS d_intercept, "
            f"{R(f'SUM(-({a}) * a0 / {s})', 4)} AS d_aggregator, {R(f'SUM(-({a}) * b0 / {s})', 4)} AS d_age50, {R(f'SUM(-({a}) * {z} - event)', 4)} AS d_log_scale FROM c0")


@query("srv13_aft_scores", f"{aft_sql('weibull')} UNION ALL {aft_sql('log_logistic')}", FRAME, newton_ctes()[0])
def _(t):
    df = two_frame(t)
    rows = None
    for family in ("weibull", "log_logistic"):
        one = survival.aft_score(df, TWO, family, THETA[:-1], THETA[-1])
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("family", "n", *[round_dec(F.col(c), 4).alias(c) for c in ("log_likelihood", "d_intercept", "d_aggregator", "d_age50", "d_log_scale")])


@query("srv13_fits_converge", "SELECT f AS family, TRUE AS score_is_zero, TRUE AS beats_given FROM (VALUES ('weibull'), ('log_normal'), ('log_logistic')) v(f), (SELECT COUNT(*) FROM sf)", FRAME)
def _(t):
    """At each fit's coefficients the score vanishes, and the likelihood is above that at the given ones."""
    df, rows = two_frame(t), []
    for family in survival.AFT_FAMILIES:
        m = survival.fit_aft(df, TWO, family)
        r = survival.aft_score(df, TWO, family, m.coef, m.log_scale).first()
        start = survival.aft_score(df, TWO, family, THETA[:-1], THETA[-1]).first()
        flat = max(abs(r[c]) for c in ("d_intercept", "d_aggregator", "d_age50", "d_log_scale")) < 1e-3 * r["n"] ** 0.5
        rows.append((family, bool(flat), bool(r["log_likelihood"] >= start["log_likelihood"])))
    return t.spark.createDataFrame(rows, "family string, score_is_zero boolean, beats_given boolean")
