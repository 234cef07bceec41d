"""Exploratory summaries of members, visits and actions.

Medians here are over whole days, so ``percentile`` holds at most one counter per day of the
calendar and group; percentiles of free values use :func:`tenura.functions.ordered.exact_percentiles`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.functions import as_ts, days_between, flag, minus_days, round_dec, safe_div

MONTH_DAYS = 30.44


def with_tenure(members: DataFrame, ref, month_days: float = MONTH_DAYS) -> DataFrame:
    days = days_between(F.coalesce("cancel_date", as_ts(ref)), F.col("join_date"))
    return members.withColumn("tenure_days", days).withColumn("tenure_months", F.col("tenure_days") / F.lit(month_days))


def _long(one: DataFrame) -> DataFrame:
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])))


def network_summary(locations: DataFrame, members: DataFrame, visits: DataFrame, actions: DataFrame, ref) -> DataFrame:
    m = with_tenure(members, ref).agg(
        F.count("*").alias("total_members"), F.count_if(~F.col("churned")).alias("active_members"),
        F.count_if("churned").alias("churned_members"), round_dec(F.avg(flag(F.col("churned"))), 6).alias("churn_rate"),
        round_dec(F.percentile("tenure_days", F.lit(0.5)) / MONTH_DAYS, 4).alias("median_tenure_months"),
        round_dec(F.avg("monthly_price"), 4).alias("mean_monthly_price"))
    parts = [locations.agg(F.count("*").alias("total_locations")), m, visits.agg(F.count("*").alias("total_visits")),
             actions.agg(F.count("*").alias("total_actions"), F.count_distinct("member_id").alias("members_with_action"))]
    out = _long(parts[0])
    for p in parts[1:]:
        out = out.unionByName(_long(p))
    return out


def enrolments_by_month(members: DataFrame) -> DataFrame:
    return members.groupBy(F.date_trunc("month", F.col("join_date")).cast("timestamp_ntz").alias("join_month")).agg(
        F.count("*").alias("enrollments"))


def churn_by_month_of_year(members: DataFrame) -> DataFrame:
    return members.groupBy(F.month("join_date").cast("bigint").alias("month_of_year")).agg(
        round_dec(F.avg(flag(F.col("churned"))), 6).alias("churn_rate"), F.count("*").alias("n"))


def january_effect(members: DataFrame) -> DataFrame:
    jan, c = F.month("join_date") == 1, flag(F.col("churned"))
    one = members.agg(F.avg(F.when(jan, c)).alias("j"), F.avg(F.when(~jan, c)).alias("r"))
    return one.select(round_dec(F.col("j"), 6).alias("january_churn"), round_dec(F.col("r"), 6).alias("other_churn"),
                      round_dec(safe_div(F.col("j"), F.col("r")) - 1, 6).alias("relative_difference"))


def visits_per_month(members: DataFrame, visits: DataFrame, ref) -> DataFrame:
    """Visits per month of tenure; 0 when the tenure is not positive."""
    totals = visits.groupBy("member_id").agg(F.count("*").alias("total_visits"))
    total = F.coalesce("total_visits", F.lit(0))
    rate = F.when(F.col("tenure_days") > 0, total / F.col("tenure_months")).otherwise(0.0)
    return with_tenure(members, ref).join(totals, "member_id", "left").withColumns(
        {"total_visits": total, "visits_per_month": rate})


def segment_stats(members: DataFrame, visits: DataFrame, ref, by: str = "contract_source") -> DataFrame:
    return visits_per_month(members, visits, ref).groupBy(by).agg(
        F.count("*").alias("count"), round_dec(F.avg(flag(F.col("churned"))), 2).alias("churn_rate"),
        round_dec(F.avg("tenure_months"), 2).alias("avg_tenure_months"),
        round_dec(F.percentile("tenure_days", F.lit(0.5)) / MONTH_DAYS, 2).alias("median_tenure_months"),
        round_dec(F.avg("monthly_price"), 2).alias("avg_monthly_price"),
        round_dec(F.avg("visits_per_month"), 2).alias("avg_visits_per_month"))


def platform_breakdown(members: DataFrame, ref) -> DataFrame:
    rows = with_tenure(members, ref).filter((F.col("contract_source") == "aggregator") & F.col("aggregator_platform").isNotNull())
    return rows.groupBy("aggregator_platform").agg(
        F.count("*").alias("count"), round_dec(F.avg(flag(F.col("churned"))), 6).alias("churn_rate"),
        round_dec(F.avg("tenure_months"), 4).alias("avg_tenure")).orderBy(F.desc("count"), "aggregator_platform")


def location_churn(members: DataFrame, locations: DataFrame) -> DataFrame:
    agg = members.groupBy("location_id").agg(F.count("*").alias("member_count"), F.avg(flag(F.col("churned"))).alias("churn_rate"))
    return agg.join(locations, "location_id", "left")


def churn_by(loc_churn: DataFrame, by: str) -> DataFrame:
    """Mean of the location churn rates per region or urban flag."""
    return loc_churn.groupBy(by).agg(round_dec(F.avg("churn_rate"), 6).alias("mean_churn"), F.count("*").alias("n_locations"))


def location_churn_spread(loc_churn: DataFrame) -> DataFrame:
    """Quartiles of the location rates and their correlation with capacity (one value per location)."""
    q = F.percentile("churn_rate", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    one = loc_churn.agg(q.alias("q"), F.corr("capacity", "churn_rate").alias("r"))
    names = ("min", "q1", "median", "q3", "max")
    return one.select(*[round_dec(F.col("q")[i], 6).alias(n) for i, n in enumerate(names)],
                      round_dec(F.col("q")[3] - F.col("q")[1], 6).alias("iqr"), round_dec(F.col("r"), 6).alias("capacity_corr"))


def visit_decay(members: DataFrame, visits: DataFrame, cap: int = 24) -> DataFrame:
    """Mean visits per member in each month of tenure, by source and outcome.

    Visits become one row per member and day before they meet the members.
    """
    daily = visits.groupBy("member_id", "visit_date").agg(F.count("*").alias("_n"))
    info = members.select("member_id", "join_date", "contract_source", "churned")
    months = F.greatest(days_between(F.col("visit_date"), F.col("join_date")) / MONTH_DAYS, F.lit(0.0))
    bucket = F.least(F.floor(months), F.lit(cap)).cast("bigint")
    per_member = (daily.join(info, "member_id").groupBy("member_id", "contract_source", "churned", bucket.alias("tenure_bucket"))
                  .agg(F.sum("_n").alias("visits_in_month")))
    return per_member.groupBy("contract_source", "churned", "tenure_bucket").agg(
        round_dec(F.avg("visits_in_month"), 6).alias("avg_visits"))


def recency_to_end(members: DataFrame, visits: DataFrame, ref) -> DataFrame:
    """Median days from the last visit to the cancel date, or to ``ref`` for active members."""
    last = visits.groupBy("member_id").agg(F.max("visit_date").alias("_last"))
    end = F.when(F.col("churned"), F.col("cancel_date")).otherwise(as_ts(ref))
    gap = F.greatest(days_between(end, F.col("_last")), F.lit(0))
    rows = members.join(last, "member_id").withColumn("_gap", gap).filter("_gap is not null")
    return rows.groupBy("churned").agg(F.count("*").alias("n"), F.percentile("_gap", F.lit(0.5)).alias("median_days"))


def weekday_month_pivot(visits: DataFrame) -> DataFrame:
    """Visits by weekday (Monday is 0) and month; the twelve columns are fixed."""
    rows = visits.select(F.weekday("visit_date").cast("bigint").alias("day_of_week"), F.month("visit_date").alias("m"))
    out = rows.groupBy("day_of_week").pivot("m", list(range(1, 13))).count().fillna(0)
    return out.select("day_of_week", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


def naive_treatment_gap(members: DataFrame, actions: DataFrame, ref) -> DataFrame:
    acted = actions.select("member_id").distinct().withColumn("_a", F.lit(True))
    rows = with_tenure(members, ref).join(acted, "member_id", "left")
    return rows.groupBy(F.coalesce("_a", F.lit(False)).alias("received_action")).agg(
        F.count("*").alias("count"), round_dec(F.avg(flag(F.col("churned"))), 6).alias("churn_rate"),
        round_dec(F.avg("tenure_months"), 4).alias("avg_tenure_months"))


def action_type_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action_type").agg(F.count("*").alias("n"))


def action_lead_time(members: DataFrame, actions: DataFrame, low: int = -30, high: int = 180) -> DataFrame:
    """Days from an action to the churn of the member, as recorded and clipped."""
    ends = members.filter("churned").select("member_id", "cancel_date")
    rows = actions.join(ends, "member_id").withColumn("_d", days_between(F.col("cancel_date"), F.col("action_date")))
    clipped = F.greatest(F.least(F.col("_d"), F.lit(high)), F.lit(low))
    return rows.agg(F.count("_d").alias("n"), F.percentile("_d", F.lit(0.5)).alias("median_days"),
                    F.percentile(clipped, F.lit(0.5)).alias("median_days_clipped"),
                    F.count_if(F.col("_d") < 0).alias("after_churn"), round_dec(F.avg(flag(F.col("_d") < 0)), 6).alias("share_after_churn"))


def pre_action_rate(actions: DataFrame, visits: DataFrame, days: int = 60) -> DataFrame:
    """Visits per month in the ``days`` days before each member's first action."""
    first = actions.groupBy("member_id").agg(F.min("action_date").alias("_first"))
    daily = visits.groupBy("member_id", "visit_date").agg(F.count("*").alias("_n"))
    hit = daily.join(first, "member_id").filter(
        (F.col("visit_date") >= F.col("_first") - F.expr(f"interval {days} days")) & (F.col("visit_date") < F.col("_first")))
    return hit.groupBy("member_id").agg(F.sum("_n").alias("visits_before")).withColumn(
        "visits_per_month_pre", F.col("visits_before") / (days / 30.0))


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts and density in equal-width bins over the column's range; the last bin is closed.

    The range is read first (two numbers); empty bins of a group that occurs are returned too.
    """
    x = F.col(col).cast("double")
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = (r["lo"], r["hi"]) if r["lo"] is not None else (0.0, 1.0)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    i = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("bigint")
    counts = df.filter(x.isNotNull()).groupBy(*by, i.alias("bin")).agg(F.count("*").alias("n"))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("_total")) if by else counts.agg(F.sum("n").alias("_total"))
    grid = groups.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    width = (hi - lo) / bins
    return grid.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"),
        safe_div(F.coalesce("n", F.lit(0)), F.col("_total") * width).alias("density"))


def arm_distribution(df: DataFrame, arm: str, cols: Sequence[str]) -> DataFrame:
    """Share of each value of each covariate within each treatment arm."""
    long = df.select(arm, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([arm], list(cols), "covariate", "value")
    counts = long.filter("value is not null").groupBy(arm, "covariate", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy(arm, "covariate").agg(F.sum("n").alias("_t"))
    return counts.join(totals, [arm, "covariate"]).select(
        arm, "covariate", "value", "n", round_dec(F.col("n") / F.col("_t"), 6).alias("share"))
