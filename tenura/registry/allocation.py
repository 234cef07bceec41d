"""Budget allocation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tenura.config import ACTIONS, Limits
from tenura.errors import InfeasibleError
from tenura.functions import round_dec
from tenura.operators import allocate
from tenura.registry.base import R, once, query

LIMITS = Limits(total_budget=20_000.0)
#: Budgets of the uniform baseline at which every location runs out of money.
BUDGET, SMALL, URBAN_BUDGET = 1_500.0, 700.0, 600.0
SCENARIOS, RISK = 50, 0.3


def valued(t):
    return t.members.withColumn("ltv", F.coalesce("monthly_price", F.lit(50.0)) * 24)


def cands(t):
    return allocate.candidates(valued(t), t.cate)


ACTS = "(SELECT * FROM (VALUES " + ", ".join(f"('{a.name}', {float(a.cost)}::DOUBLE, {float(a.minutes)}::DOUBLE)" for a in ACTIONS) + ") v(action, cost, minutes))"
CAND = (f"vm AS (SELECT *, COALESCE(monthly_price, 50) * 24 AS ltv FROM members), acts AS {ACTS}",
        """cd AS (SELECT vm.member_id, location_id, contract_source, acts.action, cost, minutes, ltv * COALESCE(cate_mean, 0) AS value FROM vm JOIN acts ON acts.action <> 'discount_offer' OR contract_source = 'regular'
  LEFT JOIN cate ON cate.member_id = vm.member_id AND cate.action = acts.action)""")


def uniform(name: str, budget: float, where: str = "TRUE") -> str:
    return f"""{name} AS (SELECT member_id, location_id, action, cost, minutes, value FROM (SELECT *, SUM(cost) OVER (PARTITION BY location_id ORDER BY ratio DESC, md5(CAST(member_id AS VARCHAR)), member_id) AS cum,
  {budget} / (SELECT COUNT(DISTINCT location_id) FROM cd WHERE value > 0 AND {where}) AS share FROM (SELECT *, ROUND(value / cost, 8) AS ratio, ROW_NUMBER() OVER (PARTITION BY member_id ORDER BY ROUND(value / cost, 8) DESC, action DESC) AS rn
  FROM cd WHERE value > 0 AND {where}) WHERE rn = 1) WHERE cum <= share)"""


# Scenarios that can be stated in SQL: the mean shifted by fixed multiples of the deviation.
SCEN = """sc AS (SELECT member_id, action, s AS scenario, GREATEST(0, LEAST(1, cate_mean + (s - 2) * cate_std * (1 + member_id % 3) / 2)) AS cate_realized
  FROM cate, (SELECT UNNEST(range(0, 5)) AS s))"""


def scenarios(t):
    s = F.col("scenario")
    drawn = F.col("cate_mean") + (s - 2) * F.col("cate_std") * (1 + F.col("member_id") % 3) / 2
    return t.cate.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("scenario")).select(
        "member_id", "action", "scenario", F.greatest(F.lit(0.0), F.least(F.lit(1.0), drawn)).alias("cate_realized"))


def unit(k: str, seed: int) -> str:
    return f"((CAST('0x' || substr(md5(member_id || '|' || action || '|' || {k} || '|{seed}'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496::DOUBLE)"


DRAWN = (f"""dr AS (SELECT member_id, action, s AS scenario, GREATEST(0, LEAST(1, cate_mean + GREATEST(cate_std, 1e-6) * sqrt(-2::DOUBLE * ln({unit('s', 42)})) * cos(6.283185307179586::DOUBLE * {unit('s', 42 + 7919)}))) AS cate_realized
  FROM cate, (SELECT UNNEST(range(0, {SCENARIOS})) AS s))""",)


@query("opt1_sample_scenarios", f"SELECT member_id, action, scenario, {R('cate_realized', 6)} AS cate_realized FROM dr", *DRAWN)
def _(t):
    return allocate.sample_scenarios(t.cate, SCENARIOS).select("member_id", "action", "scenario", round_dec(F.col("cate_realized"), 6).alias("cate_realized"))


@query("opt2_candidate_values", f"SELECT member_id, location_id, contract_source, action, cost, minutes, {R('value', 6)} AS value FROM (SELECT vm.member_id, location_id, contract_source, acts.action, cost, minutes, "
       "ltv * COALESCE(cate_mean, 0) AS value FROM vm JOIN acts ON TRUE LEFT JOIN cate ON cate.member_id = vm.member_id AND cate.action = acts.action)", *CAND)
def _(t):
    return allocate.candidates(valued(t), t.cate, check_eligible=False).withColumn("value", round_dec(F.col("value"), 6))


@query("opt3_eligible_candidates", f"SELECT member_id, location_id, contract_source, action, cost, minutes, {R('value', 6)} AS value FROM cd", *CAND)
def _(t):
    return cands(t).withColumn("value", round_dec(F.col("value"), 6))


def solution_row(t, s):
    return t.spark.createDataFrame([(float(s.value), float(s.cost), float(s.bound), float(s.gap), s.allocation.count())],
                                   "value double, cost double, bound double, gap double, members_targeted bigint")


def solved(t):
    return once(t, "solved", lambda: allocate.solve(cands(t), LIMITS))


@query("opt4_solve")
def _(t):
    return solved(t).allocation


@query("opt4_solution_quality")
def _(t):
    return solution_row(t, solved(t))


@query("opt4_dual_value", f"""SELECT {R("0.4::DOUBLE * 20000 + (SELECT SUM((p - 0.4) * 2000 + v * 1200) FROM pr) + SUM(best)", 4)} AS bound FROM
(SELECT member_id, GREATEST(0, MAX(value - p * cost - v * minutes)) AS best FROM cd JOIN pr USING (location_id) GROUP BY 1)""", *CAND,
       "pr AS (SELECT location_id, GREATEST(0.4::DOUBLE, (location_id % 5) * 0.3::DOUBLE) AS p, (location_id % 3) * 0.1::DOUBLE AS v FROM locations WHERE location_id IN (SELECT location_id FROM cd))")
def _(t):
    rows = allocate.member_rows(cands(t))
    i = F.col("location_id")
    prices = rows.select("location_id").distinct().select(i, F.greatest(F.lit(0.4), (i % 5) * F.lit(0.3)).alias("p"), ((i % 3) * F.lit(0.1)).alias("v"))
    bound = allocate.dual_value(rows, prices, 0.4, LIMITS)
    return t.spark.createDataFrame([(bound,)], "b double").select(round_dec(F.col("b"), 4).alias("bound"))


def nothing_broken(limit: float) -> str:
    """What a feasible allocation within ``limit`` of the bound must report, and the size of the problem."""
    return (f"SELECT 0::BIGINT AS not_a_candidate, 0::BIGINT AS members_twice, 0::BIGINT AS locations_over_cap, 0::BIGINT AS locations_over_minutes, 0::BIGINT AS locations_below_floor, 0::DOUBLE AS over_budget, "
            f"COUNT(DISTINCT location_id) AS locations, COUNT(DISTINCT member_id) AS members, {limit}::DOUBLE AS gap_limit, TRUE AS gap_within FROM cd")


def checked(t, s, limit: float, floor: bool):
    c = cands(t)
    size = c.agg(F.count_distinct("location_id").alias("locations"), F.count_distinct("member_id").alias("members"))
    return allocate.violations(s.allocation, c, LIMITS, floor).join(size, F.lit(True)).withColumns({"gap_limit": F.lit(limit), "gap_within": F.lit(bool(0 <= s.gap + 1e-9 and s.gap < limit))})


@query("opt4_violations", nothing_broken(0.005), *CAND)
def _(t):
    return checked(t, solved(t), 0.005, False)


@query("opt5_uniform_baseline", f"SELECT member_id, location_id, action, cost, minutes, {R('value', 6)} AS value FROM ua", *CAND, uniform("ua", BUDGET))
def _(t):
    return allocate.uniform_baseline(cands(t), BUDGET).withColumn("value", round_dec(F.col("value"), 6))


def stochastic(t):
    return once(t, "stochastic", lambda: allocate.solve_stochastic(allocate.stochastic_rows(valued(t), t.cate, SCENARIOS), SCENARIOS, RISK, LIMITS))


@query("opt6_stochastic")
def _(t):
    s = stochastic(t)
    return t.spark.createDataFrame([(s.objective, s.cost, s.bound, s.gap, s.robust_gap, s.allocation.count())],
                                   "objective double, cost double, bound double, gap double, robust_gap double, members_targeted bigint")


@query("opt6_violations", nothing_broken(0.005), *CAND)
def _(t):
    return checked(t, stochastic(t), 0.005, True)


# A floor that the smaller locations cannot meet.
HIGH = Limits(total_budget=200_000.0, min_per_location=4_800.0, max_per_location=6_000.0)


@query("opt7_feasibility", f"""SELECT location_id, most, most >= {HIGH.min_per_location} AS meets_floor, COUNT(*) OVER () * {HIGH.min_per_location} <= {HIGH.total_budget} AS floors_fit_budget,
MIN(CAST(most >= {HIGH.min_per_location} AS INT)) OVER () = 1 AND COUNT(*) OVER () * {HIGH.min_per_location} <= {HIGH.total_budget} AS feasible
FROM (SELECT location_id, SUM(m) AS most FROM (SELECT location_id, member_id, MAX(cost) AS m FROM cd GROUP BY 1, 2) GROUP BY 1)""", *CAND)
def _(t):
    rows = allocate.member_rows(cands(t))
    table = allocate.feasibility(rows, HIGH).select("location_id", "most", "meets_floor")
    n = table.count()
    fits = bool(n * HIGH.min_per_location <= HIGH.total_budget)
    try:
        allocate.check_feasible(rows, HIGH)
        feasible = True
    except InfeasibleError:
        feasible = False
    return table.withColumns({"floors_fit_budget": F.lit(fits), "feasible": F.lit(feasible)})


def evaluated(alloc: str) -> str:
    return f"(SELECT s AS scenario, COALESCE(SUM(ltv * cate_realized), 0) AS v FROM (SELECT UNNEST(range(0, 5)) AS s) LEFT JOIN (SELECT sc.* FROM sc JOIN {alloc} USING (member_id, action)) h ON h.scenario = s LEFT JOIN vm USING (member_id) GROUP BY 1)"


@query("opt8_evaluate_scenarios", f"SELECT COUNT(*) AS n_scenarios, {R('AVG(v)', 4)} AS expected_mrr, {R('MIN(v)', 4)} AS worst_case_mrr, {R('MAX(v)', 4)} AS best_case_mrr, "
       f"{R('STDDEV_POP(v)', 4)} AS mrr_std, {R('AVG(v) - MIN(v)', 4)} AS robust_gap FROM {evaluated('ua')}", *CAND, uniform("ua", BUDGET), SCEN)
def _(t):
    return allocate.evaluate_scenarios(allocate.uniform_baseline(cands(t), BUDGET), scenarios(t), valued(t))


def side(alloc: str) -> str:
    return (f"(SELECT {R('AVG(v)', 4)} AS e, {R('MIN(v)', 4)} AS w, {R('AVG(v) - MIN(v)', 4)} AS g, (SELECT {R('SUM(cost)', 2)} FROM {alloc}) AS c, (SELECT COUNT(*) FROM {alloc}) AS n "
            f"FROM {evaluated(alloc)})")


@query("opt9_compare_allocations", f"""SELECT a.c AS total_cost_a, a.n AS members_a, a.e AS expected_mrr_a, a.w AS worst_case_mrr_a, a.g AS robust_gap_a, b.c AS total_cost_b, b.n AS members_b, b.e AS expected_mrr_b,
b.w AS worst_case_mrr_b, b.g AS robust_gap_b, {R("(b.e - a.e) / GREATEST(ABS(a.e), 1e-6) * 100", 4)} AS expected_mrr_diff_pct, {R("(b.w - a.w) / GREATEST(ABS(a.w), 1e-6) * 100", 4)} AS worst_case_mrr_diff_pct,
{R("(SELECT COUNT(*) FROM ua JOIN ub USING (member_id, action)) / CAST((SELECT COUNT(*) FROM (SELECT member_id, action FROM ua UNION SELECT member_id, action FROM ub)) AS DOUBLE)", 6)} AS jaccard
FROM {side("ua")} a, {side("ub")} b""", *CAND, uniform("ua", BUDGET), uniform("ub", SMALL), SCEN)
def _(t):
    c = cands(t)
    return allocate.compare_allocations(allocate.uniform_baseline(c, BUDGET), allocate.uniform_baseline(c, SMALL), scenarios(t), valued(t))


def frontier(t):
    return once(t, "frontier", lambda: allocate.efficient_frontier(allocate.stochastic_rows(valued(t), t.cate, SCENARIOS, seed=99), SCENARIOS, limits=LIMITS))


@query("opt10_efficient_frontier")
def _(t):
    return frontier(t)


@query("opt10_frontier_properties", "SELECT r AS risk_aversion, TRUE AS gap_within, TRUE AS within_budget, TRUE AS worst_below_expected, TRUE AS worst_never_falls FROM (SELECT UNNEST([0, 0.1, 0.2, 0.3, 0.5, 0.8, 1]::DOUBLE[]) AS r)")
def _(t):
    found = frontier(t)
    before = Window.orderBy("risk_aversion").rowsBetween(Window.unboundedPreceding, -1)  # one row per level
    return found.select("risk_aversion", F.col("gap").between(-1e-9, 0.005).alias("gap_within"), (F.col("total_cost") <= LIMITS.total_budget + 1e-6).alias("within_budget"),
                        (F.col("worst_case_mrr") <= F.col("expected_mrr")).alias("worst_below_expected"),
                        (F.col("worst_case_mrr") >= F.coalesce(F.max("worst_case_mrr").over(before), F.col("worst_case_mrr")) - 1e-6).alias("worst_never_falls"))


@query("opt11_location_plan", f"""SELECT location_id, SUM(n)::BIGINT AS n_members_targeted, string_agg(action || '(' || n || ')', ', ' ORDER BY n DESC, action) AS action_mix, {R("SUM(c)", 2)} AS budget_allocated,
{R("SUM(v)", 2)} AS expected_retained_mrr, {R("SUM(v) / SUM(c)", 2)} AS roi FROM (SELECT location_id, action, COUNT(*) AS n, SUM(cost) AS c, SUM({R("value", 2)}) AS v FROM ua GROUP BY 1, 2) GROUP BY 1""",
       *CAND, uniform("ua", BUDGET))
def _(t):
    a = allocate.uniform_baseline(cands(t), BUDGET)
    return allocate.location_plan(a.withColumn("value", round_dec(F.col("value"), 2)))


@query("opt12_action_pivot", "SELECT location_id, " + ", ".join(f"COUNT(*) FILTER (WHERE action = '{a.name}') AS {a.name}" for a in ACTIONS) + " FROM ua GROUP BY 1", *CAND, uniform("ua", BUDGET))
def _(t):
    return allocate.action_pivot(allocate.uniform_baseline(cands(t), BUDGET))


URBAN = "location_id IN (SELECT location_id FROM locations WHERE is_urban)"


@query("opt13_budget_and_locations", f"SELECT member_id, location_id, action, cost, minutes, {R('value', 6)} AS value FROM ua", *CAND, uniform("ua", URBAN_BUDGET, URBAN))
def _(t):
    urban = t.locations.filter("is_urban").select("location_id")
    return allocate.uniform_baseline(cands(t).join(urban, "location_id", "left_semi"), URBAN_BUDGET).withColumn("value", round_dec(F.col("value"), 6))


@query("opt14_simulate_intervention", f"""SELECT cd.action, COUNT(*) AS members, {R("SUM(cate_mean)", 4)} AS expected_saves, {R("SUM(cost)", 2)} AS cost, {R("SUM(value)", 2)} AS retained_value
FROM cd JOIN cate USING (member_id, action) JOIN (SELECT member_id, churned FROM members) m USING (member_id) WHERE contract_source = 'regular' AND NOT churned GROUP BY 1""", *CAND)
def _(t):
    return allocate.simulate_intervention(valued(t), t.cate, (F.col("contract_source") == "regular") & ~F.col("churned"))
