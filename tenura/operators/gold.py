"""The wide member view, location KPIs, cohorts and the reports built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.config import VISIT_WINDOWS, Limits
from tenura.errors import DataError
from tenura.functions import as_ts, days_between, flag, hash_unit, minus_days, round_dec, safe_div
from tenura.functions.ordered import prefix_sums
from tenura.functions.stats import two_sided_p


def visit_windows(visits: DataFrame, ref, windows: Sequence[int] = VISIT_WINDOWS) -> DataFrame:
    """Visits per member in the last N days (no upper bound) and days since the last visit.

    All windows come from one aggregation with map-side partial counts.
    """
    when = F.col("visit_date")
    counts = [F.count_if(when >= minus_days(ref, n)).alias(f"visit_count_{n}d") for n in windows]
    return (visits.filter(F.col("member_id").isNotNull()).groupBy("member_id")
            .agg(*counts, F.max("visit_date").alias("_last"))
            .withColumn("days_since_last_visit", days_between(ref, F.col("_last"))).drop("_last"))


def action_summary(actions: DataFrame, tie: str = "action_id") -> DataFrame:
    """Number of actions per member and the type of the latest (ties by the given column)."""
    order = F.when(F.col("action_type").isNotNull() & F.col("action_date").isNotNull(),
                   F.struct("action_date", tie))
    return actions.filter(F.col("member_id").isNotNull()).groupBy("member_id").agg(
        F.count("*").alias("retention_action_count"), F.max_by("action_type", order).alias("last_action_type"))


def member_360(members: DataFrame, visits: DataFrame, actions: DataFrame, ref,
               windows: Sequence[int] = VISIT_WINDOWS) -> DataFrame:
    """One wide row per member. Both right sides are unique by member before they join."""
    base = members.withColumn("tenure_days", days_between(F.coalesce("cancel_date", as_ts(ref)), F.col("join_date")))
    out = (base.join(visit_windows(visits, ref, windows), "member_id", "left")
           .join(action_summary(actions), "member_id", "left"))
    filled = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
              for c in [*(f"visit_count_{n}d" for n in windows), "retention_action_count"]}
    filled["days_since_last_visit"] = F.coalesce(F.col("days_since_last_visit"), F.lit(-1)).cast("bigint")
    return out.withColumns(filled)


def location_kpis(m360: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    churned = F.coalesce(F.col("churned"), F.lit(False))
    agg = m360.filter(F.col("location_id").isNotNull()).groupBy("location_id").agg(
        F.count("member_id").alias("total_members"),
        F.count_if(~churned).alias("active_members"),
        F.count_if(churned).alias("churned_members"),
        F.avg("visit_count_30d").alias("_v"), F.avg("tenure_days").alias("_t"),
        F.coalesce(F.sum(F.when(~churned, F.col("monthly_price"))), F.lit(0.0)).alias("_m"),
        F.count_if(F.col("contract_source") == "aggregator").alias("_a"), *extra)
    keep = [c for c in agg.columns if not c.startswith("_")]
    return agg.select(
        *keep, round_dec(F.col("_v"), 2).alias("avg_visits_30d"), round_dec(F.col("_t"), 1).alias("avg_tenure_days"),
        round_dec(F.col("_m"), 2).alias("mrr"),
        round_dec(safe_div(F.col("churned_members"), F.col("total_members")), 4).alias("churn_rate"),
        round_dec(safe_div(F.col("_a"), F.col("total_members")), 4).alias("aggregator_pct"))


def _month_index(col: Column) -> Column:
    return F.year(col) * 12 + F.month(col) - 1


def cohort_retention(members: DataFrame, ref, min_size: int = 50) -> DataFrame:
    """Share of each join-month cohort still active at the start of every later month.

    Members are reduced to counts per (cohort, month of loss); the curve is a running total of
    those counts, so no member is repeated per period.
    """
    ref_ts = as_ts(ref)
    cohort = _month_index(F.col("join_date"))
    # a member who cancels within month k of the cohort is gone from period k + 1 on
    lost_at = F.greatest(_month_index(F.col("cancel_date")) - cohort + 1, F.lit(0))
    lost_at = F.when(F.col("cancel_date").isNotNull(), lost_at)
    counts = (members.filter(F.col("join_date").isNotNull())
              .groupBy(cohort.alias("_c"), lost_at.alias("_p")).agg(F.count("member_id").alias("_n")))
    sizes = counts.groupBy("_c").agg(F.sum("_n").alias("cohort_size")).filter(F.col("cohort_size") >= min_size)
    last = F.greatest(F.lit(1), _month_index(ref_ts) - F.col("_c"))
    grid = sizes.select("_c", "cohort_size", F.explode(F.sequence(F.lit(0), last)).alias("period"))
    lost = counts.filter(F.col("_p").isNotNull()).select("_c", F.col("_p").alias("period"), "_n")
    run = Window.partitionBy("_c").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(lost, ["_c", "period"], "left").withColumn(
        "retained", F.col("cohort_size") - F.sum(F.coalesce("_n", F.lit(0))).over(run))
    month = F.format_string("%04d-%02d", F.floor(F.col("_c") / 12).cast("int"), (F.col("_c") % 12 + 1).cast("int"))
    return out.select(month.alias("cohort_month"), F.col("period").cast("bigint").alias("period"), "cohort_size",
                      "retained", round_dec(safe_div(F.col("retained"), F.col("cohort_size")), 4).alias("retention_rate"))


GRAINS = {"daily": "day", "weekly": "week", "monthly": "month"}


def member_numbers(members: DataFrame, key: str = "member_id", location: str = "location_id") -> DataFrame:
    """(key, number): members numbered from 0, those of a location next to each other, so that bitmaps of a location's members are dense."""
    one = members.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(location).alias(location)).withColumn("_one", F.lit(1))
    inside = prefix_sums(one, hash_unit(key, seed=0), ["_one"], [location], tie=[key])
    sizes = one.groupBy(location).agg(F.sum("_one").alias("_one"))
    starts = prefix_sums(sizes, hash_unit(location, seed=0), ["_one"], tie=[location]).select(F.col(location).alias("_at"), (F.col("cum__one") - F.col("_one")).alias("_start"))
    return inside.join(starts, F.col(location).eqNullSafe(F.col("_at"))).select(key, (F.col("_start") + F.col("cum__one") - 1).cast("bigint").alias("number"))


def daily_activity(visits: DataFrame, member: Column, sketch: bool = False) -> DataFrame:
    """State per location, day and block of members: visits, minutes and who came, as a bitmap (exact) or a sketch.

    ``member`` is a number per member (see ``member_numbers``). States of later days are added without reading earlier visits again, and
    states merge: those of a week or month are the union of its days'. One scan, one shuffle, partial states where rows are read.
    """
    day = F.date_trunc("day", F.col("visit_date")).alias("day")
    rows = visits.filter(F.col("location_id").isNotNull() & F.col("visit_date").isNotNull())
    block = F.lit(0).cast("bigint") if sketch else F.coalesce(F.bitmap_bucket_number(member), F.lit(0).cast("bigint"))
    who = F.hll_sketch_agg(member, 14) if sketch else F.bitmap_construct_agg(F.bitmap_bit_position(member))
    return rows.groupBy("location_id", day, block.alias("block")).agg(F.count("*").alias("visits"), F.sum("visit_duration_minutes").alias("minutes"), who.alias("who"))


def merge_activity(states: DataFrame, grains: Sequence[str] = tuple(GRAINS), sketch: bool = False) -> DataFrame:
    """Visits, visiting members and minutes per location by day, ISO week and month, from daily states; with sketches members are off by about 1 %."""
    periods = F.explode(F.array(*[
        F.struct(F.lit(g).alias("grain"), F.date_trunc(GRAINS[g], F.col("day")).cast("timestamp_ntz").alias("period_start")) for g in grains]))
    union = F.hll_union_agg("who") if sketch else F.bitmap_or_agg("who")
    merged = states.select("*", periods.alias("_p")).select("*", "_p.*").groupBy("grain", "location_id", "period_start", "block").agg(
        F.sum("visits").alias("visits"), F.sum("minutes").alias("minutes"), union.alias("who"))
    size = F.hll_sketch_estimate("who") if sketch else F.bitmap_count("who")
    return merged.groupBy("grain", "location_id", "period_start").agg(
        F.sum("visits").alias("visits"), F.sum(size).cast("bigint").alias("visiting_members"), F.sum("minutes").cast("bigint").alias("total_minutes"))


def location_activity(visits: DataFrame, grains: Sequence[str] = tuple(GRAINS), numbers: DataFrame | None = None) -> DataFrame:
    """Visits and visiting members per location by day, ISO week and month.

    Members count through bitmaps of their numbers: the integer ``member_id`` itself, or ``numbers`` (member_id, number) for
    ids of another kind, made from the visits where none are given.
    """
    member = F.col("member_id")
    if numbers is None and dict(visits.dtypes)["member_id"] not in ("tinyint", "smallint", "int", "bigint"):
        numbers = member_numbers(visits)
    if numbers is not None:
        visits, member = visits.join(numbers, "member_id", "left"), F.col("number")
    return merge_activity(daily_activity(visits, member.cast("bigint")), grains)


def location_metrics(m360: DataFrame, scores: DataFrame, visits: DataFrame, ref, last_days: int = 30,
                     threshold: float = 0.5) -> DataFrame:
    """KPIs of every location with members at risk, and visits per member in the asked period."""
    joined = m360.join(scores.select("member_id", "churn_probability"), "member_id", "left")
    kpis = location_kpis(joined, [F.count_if(F.col("churn_probability") > threshold).alias("at_risk_members")])
    in_period = (visits.filter((F.col("visit_date") >= minus_days(ref, last_days)) & (F.col("visit_date") < as_ts(ref)))
                 .groupBy("location_id").agg(F.count("*").alias("_n")))
    per_member = round_dec(safe_div(F.coalesce("_n", F.lit(0)), F.col("total_members")), 2)
    return kpis.join(in_period, "location_id", "left").select(
        "location_id", F.lit(f"last_{last_days}d").alias("period"), "active_members", "churned_members", "churn_rate",
        "mrr", per_member.alias("avg_visits_per_member"), "at_risk_members", "aggregator_pct")


def allocation_rollup(allocation: DataFrame) -> DataFrame:
    """Members, budget, action counts and return per location, from per-action partial counts."""
    per_action = allocation.groupBy("location_id", "action").agg(
        F.count("*").alias("n"), F.sum("cost").alias("cost"), F.sum("value").alias("value"))
    actions = F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n"))))
    return per_action.groupBy("location_id").agg(
        F.sum("n").alias("members_targeted"), round_dec(F.sum("cost"), 2).alias("budget_used"),
        actions.alias("actions"),
        round_dec(F.coalesce(safe_div(F.sum("value"), F.nullif(F.sum("cost"), F.lit(0.0))), F.lit(0.0)), 2).alias("roi"))


def compare_cohorts(m360: DataFrame, a: Column, b: Column, metrics: dict[str, Column], alpha: float = 0.05) -> DataFrame:
    """Means of two filtered groups, their difference and a Welch test, in one pass.

    The p-value uses the normal distribution, which equals the t test for large groups.
    """
    aggs = []
    for name, value in metrics.items():
        v = value.cast("double")
        for tag, cond in (("a", a), ("b", b)):
            inside = F.when(cond, v)
            aggs += [F.count(inside).alias(f"n_{tag}_{name}"), F.avg(inside).alias(f"m_{tag}_{name}"),
                     F.var_samp(inside).alias(f"v_{tag}_{name}")]
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{s}_{m}").alias(s) for s in ("n_a", "m_a", "v_a", "n_b", "m_b", "v_b")])
        for m in metrics])
    long = m360.agg(*aggs).select(F.inline(rows))
    se = F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b"))
    # the p-value must be a column before "z" is renamed: inside a lambda a name means the new alias
    out = long.withColumn("_z", F.try_divide(F.col("m_a") - F.col("m_b"), se)).withColumn("_p", two_sided_p(F.col("_z")))
    p = F.col("_p")
    return out.select("metric", F.col("n_a").alias("n_members_a"), F.col("n_b").alias("n_members_b"),
                      round_dec(F.col("m_a"), 4).alias("mean_a"), round_dec(F.col("m_b"), 4).alias("mean_b"),
                      round_dec(F.col("m_a") - F.col("m_b"), 4).alias("difference"),
                      round_dec(F.col("_z"), 4).alias("z"),
                      round_dec(p, 6).alias("p_value"), F.coalesce(p < alpha, F.lit(False)).alias("significant"))


def cohort_report(members: DataFrame, a: Column, b: Column, price: str = "monthly_price", value: str = "ltv", alpha: float = 0.05) -> DataFrame:
    """One row for two filtered groups: size, churn rate, mean tenure, visits and lifetime value, recurring revenue of the active, differences, and the names of the metrics that differ.

    ``members`` is the wide member view with a lifetime value. Everything comes from one pass of sums; a metric differs when
    Welch's test says so at ``alpha`` (rates and means, not the totals).
    """
    means = {"churn_rate": flag(F.col("churned")), "avg_tenure_days": F.col("tenure_days"), "avg_visits_30d": F.col("visit_count_30d"), "avg_ltv": F.col(value)}
    aggs = []
    for tag, cond in (("a", a), ("b", b)):
        aggs += [F.count_if(cond).alias(f"n_members_{tag}"), F.coalesce(F.sum(F.when(cond & ~F.coalesce("churned", F.lit(False)), F.col(price))), F.lit(0.0)).alias(f"mrr_{tag}")]
        for name, col in means.items():
            v = F.when(cond, col.cast("double"))
            aggs += [F.avg(v).alias(f"{name}_{tag}"), F.try_divide(F.var_samp(v), F.count(v)).alias(f"_v_{name}_{tag}")]
    one = members.agg(*aggs)
    gap = {n: F.col(f"{n}_a") - F.col(f"{n}_b") for n in (*means, "mrr")}
    ps = {f"_p_{n}": two_sided_p(F.try_divide(gap[n], F.sqrt(F.col(f"_v_{n}_a") + F.col(f"_v_{n}_b")))) for n in means}
    one = one.withColumns(ps)
    named = F.array_compact(F.array(*[F.when(F.col(f"_p_{n}") < alpha, F.lit(n)) for n in means]))
    out = ["n_members_a", "n_members_b"]
    for n in (*means, "mrr"):
        digits = 2 if n == "mrr" else 4
        out += [round_dec(F.col(f"{n}_{t}"), digits).alias(f"{n}_{t}") for t in "ab"] + [round_dec(gap[n], digits).alias(f"{n}_difference")]
    return one.select(*out, F.array_join(named, ",").alias("significant_metrics"))


def best_action(effects: DataFrame, segment: str, effect: str = "cate_mean") -> DataFrame:
    """Action with the largest effect per segment; ties go to the first name."""
    per_value = effects.filter(F.col(effect).isNotNull()).groupBy(segment, effect).agg(F.min("action").alias("action"))
    return per_value.groupBy(segment).agg(F.max_by("action", effect).alias("action"), F.max(effect).alias(effect))


def location_card(metrics: DataFrame, actions: DataFrame, drivers: DataFrame, ref, last_days: int = 30,
                  limits: Limits = Limits(), top: int = 3) -> DataFrame:
    """Location metrics with actions and spending in the period and the leading churn drivers.

    ``drivers`` has one row per member: location, churned, and 0/1 flags named ``driver_*``.
    """
    flags = [c for c in drivers.columns if c.startswith("driver_")]
    if not flags:
        raise DataError("drivers needs columns named driver_*")
    shares = drivers.filter(F.col("churned")).groupBy("location_id").agg(*[
        F.avg(F.col(c).cast("double")).alias(c) for c in flags])
    entries = F.array(*[F.struct((-round_dec(F.col(c), 4)).alias("o"), F.lit(c[len("driver_"):]).alias("reason"))
                        for c in flags])
    ranked = F.slice(F.array_sort(entries), 1, top)
    text = F.array_join(F.transform(ranked, lambda x: F.concat(
        x["reason"], F.lit("="), F.format_number(-x["o"], 4))), ",")
    shares = shares.select("location_id", text.alias("top_churn_reasons"))
    spent = (actions.filter((F.col("action_date") >= minus_days(ref, last_days)) & (F.col("action_date") < as_ts(ref)))
             .groupBy("location_id").agg(F.count("*").alias("_n"), F.sum("cost").alias("_c")))
    cost = F.coalesce("_c", F.lit(0.0))
    return (metrics.join(spent, "location_id", "left").join(shares, "location_id", "left")
            .withColumns({"retention_actions_this_period": F.coalesce("_n", F.lit(0)),
                          "budget_spent": round_dec(cost, 2),
                          "budget_remaining": round_dec(F.lit(limits.max_per_location) - cost, 2)})
            .drop("_n", "_c"))


def period_change(visits: DataFrame, actions: DataFrame, ref, days: int = 30) -> DataFrame:
    """Visits, visiting members and spending per location: last period against the one before."""
    now, cut, start = as_ts(ref), minus_days(ref, days), minus_days(ref, 2 * days)

    def tagged(df: DataFrame, ts: str) -> DataFrame:
        t = F.col(ts)
        return df.filter((t >= start) & (t < now)).withColumn("_cur", t >= cut)

    per_member = tagged(visits, "visit_date").groupBy("location_id", "_cur", "member_id").agg(F.count("*").alias("_n"))
    v = per_member.groupBy("location_id").agg(
        F.sum(F.when(F.col("_cur"), F.col("_n")).otherwise(0)).alias("visits"),
        F.sum(F.when(~F.col("_cur"), F.col("_n")).otherwise(0)).alias("visits_before"),
        F.count_if("_cur").alias("visiting_members"), F.count_if(~F.col("_cur")).alias("visiting_members_before"))
    a = tagged(actions, "action_date").groupBy("location_id").agg(
        F.sum(F.when(F.col("_cur"), F.col("cost")).otherwise(0.0)).alias("spend"),
        F.sum(F.when(~F.col("_cur"), F.col("cost")).otherwise(0.0)).alias("spend_before"))
    names = ["visits", "visits_before", "visiting_members", "visiting_members_before"]
    return v.join(a, "location_id", "full").select(
        "location_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("spend", "spend_before")],
        (F.coalesce("visits", F.lit(0)) - F.coalesce("visits_before", F.lit(0))).alias("visits_change"),
        round_dec(safe_div(F.col("visits") - F.col("visits_before"), F.col("visits_before")), 4).alias("visits_change_pct"))
