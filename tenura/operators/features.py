"""Leakage-safe features, encodings, temporal splits and the point-in-time join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.config import (AGE_BINS, AGE_LABELS, CONTRACT_SOURCES, GENDERS, MODEL_EXCLUDED, PLAN_TYPES, PLATFORMS,
                           VISIT_WINDOWS)
from tenura.errors import DataError
from tenura.functions import as_ts, days_between, flag, micros, minus_days, round_dec, safe_div
from tenura.functions.ordered import percentile_rows, ranked_values


def need(df: DataFrame, cols: Sequence[str], name: str = "input") -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise DataError(f"{name} is missing columns {missing}")


def visit_features(visits: DataFrame, ref, windows: Sequence[int] = VISIT_WINDOWS) -> DataFrame:
    """Behaviour strictly before ``ref`` for members with at least one earlier visit.

    Window counts, mean duration over 30 days, recency, and the ratio of the last 14 days to the
    14 days before, all from one scan and one aggregation.
    """
    need(visits, ["member_id", "visit_date"], "visits")
    when = F.col("visit_date")
    since = {n: minus_days(ref, n) for n in {*windows, 14, 28, 30}}
    minutes = F.col("visit_duration_minutes") if "visit_duration_minutes" in visits.columns else F.lit(None)
    recent = F.count_if(when >= since[14])
    prior = F.count_if((when >= since[28]) & (when < since[14]))
    return visits.filter(F.col("member_id").isNotNull() & (when < as_ts(ref))).groupBy("member_id").agg(
        *[F.count_if(when >= since[n]).alias(f"visit_count_{n}d") for n in windows],
        F.avg(F.when(when >= since[30], minutes)).alias("avg_visit_duration_30d"),
        days_between(ref, F.max(when)).alias("days_since_last_visit"),
        (recent / F.greatest(prior, F.lit(1))).alias("visit_frequency_trend"))


def tenure_features(members: DataFrame, ref, month_days: float = 30.0) -> DataFrame:
    need(members, ["member_id", "join_date"], "members")
    days = days_between(ref, F.col("join_date"))
    return members.select("member_id", days.alias("tenure_days"),
                          round_dec(days / F.lit(month_days), 2).alias("tenure_months"),
                          flag(days <= 90).alias("is_first_90_days"))


def one_hot(col: str, values: Sequence[str]) -> list[Column]:
    """One 0/1 column per listed value; anything else gives all zeros. The schema never changes."""
    return [flag(F.col(col) == v).alias(f"{col}_{v}") for v in values]


def contract_features(members: DataFrame, sources: Sequence[str] = tuple(CONTRACT_SOURCES),
                      plans: Sequence[str] = tuple(PLAN_TYPES)) -> DataFrame:
    need(members, ["member_id", "contract_source", "plan_type"], "members")
    return members.select("member_id", *one_hot("contract_source", sources), *one_hot("plan_type", plans))


def right_closed_bin(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(edge[i], edge[i+1]]``; a missing last edge is open; outside gives null."""
    out = F.lit(None).cast("string")
    for i in range(len(labels) - 1, -1, -1):
        inside = col > edges[i]
        if i + 1 < len(edges):
            inside = inside & (col <= edges[i + 1])
        out = F.when(inside, F.lit(labels[i])).otherwise(out)
    return out


def demographic_features(members: DataFrame) -> DataFrame:
    """Platform and gender indicators, and the age group."""
    platform = members.withColumn("aggregator_platform", F.coalesce("aggregator_platform", F.lit("none")))
    return platform.select("member_id", *one_hot("aggregator_platform", PLATFORMS), *one_hot("gender", GENDERS),
                           right_closed_bin(F.col("age"), AGE_BINS, AGE_LABELS).alias("age_group"))


def financial_features(members: DataFrame, transactions: DataFrame, ref, late_days: int = 90) -> DataFrame:
    """Price, total revenue and whether a payment was late in the last ``late_days`` days before ref."""
    before = F.col("txn_date") < as_ts(ref)
    recent = before & (F.col("txn_date") >= minus_days(ref, late_days))
    spend = transactions.filter(before).groupBy("member_id").agg(
        F.sum("amount").alias("_rev"), F.max(flag(recent & F.col("is_late"))).alias("_late"))
    return members.select("member_id", "monthly_price").join(spend, "member_id", "left").select(
        "member_id", "monthly_price", round_dec(F.coalesce("_rev", F.lit(0.0)), 2).alias("total_revenue"),
        F.coalesce("_late", F.lit(0)).alias("payment_delay_flag"))


def location_context(members: DataFrame, locations: DataFrame, ref, days: int = 30) -> DataFrame:
    """Trailing churn rate, active members, urban flag and utilisation of each member's location.

    The rate is members who cancelled in the window over those active when it began.
    """
    start, cancel = minus_days(ref, days), F.col("cancel_date")
    joined = F.col("join_date") < start
    at_start = joined & (cancel.isNull() | (cancel >= start))
    lost = at_start & (cancel < as_ts(ref))
    active = (F.col("join_date") <= as_ts(ref)) & (cancel.isNull() | (cancel > as_ts(ref)))
    agg = members.groupBy("location_id").agg(
        F.count_if(lost).alias("_lost"), F.count_if(at_start).alias("_start"),
        F.count_if(active).alias("location_active_members"))
    context = agg.join(locations, "location_id").select(
        "location_id",
        round_dec(F.coalesce(safe_div(F.col("_lost"), F.nullif(F.col("_start"), F.lit(0))), F.lit(0.0)), 4)
        .alias("location_churn_rate_30d"),
        "location_active_members", flag(F.col("is_urban")).alias("location_is_urban"),
        round_dec(safe_div(F.col("location_active_members"), F.col("capacity")), 4).alias("location_capacity_utilization"))
    return members.select("member_id", "location_id").join(context, "location_id", "left")


def seasonal_features(members: DataFrame, ref) -> DataFrame:
    month, now = F.month("join_date"), F.month(as_ts(ref))
    return members.select("member_id", month.cast("bigint").alias("enrollment_month"),
                          flag(month == 1).alias("enrollment_is_january"), now.cast("bigint").alias("current_month"),
                          flag(now.isin(12, 1, 2)).alias("is_summer"))


def feature_matrix(df: DataFrame, excluded: Sequence[str] = tuple(MODEL_EXCLUDED), keep: Sequence[str] = ()) -> DataFrame:
    """Drop identifiers, leakage and text; booleans become 0/1. Missing values stay missing.

    A projection from the schema only. Timestamps are dropped with the text columns, since no
    model can take them. ``keep`` lists key columns to carry through.
    """
    out = []
    for name, kind in df.dtypes:
        if name in keep:
            out.append(F.col(name))
        elif name in excluded or kind in ("string", "date") or kind.startswith(("timestamp", "array", "map", "struct")):
            continue
        else:
            out.append(F.col(name).cast("bigint").alias(name) if kind == "boolean" else F.col(name))
    return df.select(*out)


def temporal_split(df: DataFrame, date_col: str, train: int, val: int, test: int) -> DataFrame:
    """Tag rows ``train``, ``val`` or ``test`` by month windows from the first date; later rows drop out.

    One minimum is read first. The bounds then enter the plan as constants, so each split is a
    filter that reaches the scan, and nothing is sorted.
    """
    need(df, [date_col])
    t0 = F.col("t0")
    row = df.agg(F.min(F.col(date_col).cast("timestamp_ntz")).alias("t0")).select(
        *[(t0 + F.make_interval(months=F.lit(m))).alias(n)
          for n, m in (("a", train), ("b", train + val), ("c", train + val + test))]).first()
    if row["a"] is None:
        raise DataError("cannot split an empty table")
    d = F.col(date_col).cast("timestamp_ntz")
    a, b, c = (F.lit(row[k].isoformat(sep=" ")).cast("timestamp_ntz") for k in "abc")
    tag = F.when(d < a, "train").when(d < b, "val").otherwise("test")
    return df.filter(d < c).withColumn("split", tag)


def expanding_folds(df: DataFrame, date_col: str, train: int = 12, val: int = 3, step: int = 1) -> DataFrame:
    """Rows with ``(fold, role)`` for expanding-window validation, training strictly before validation.

    Fold bounds are a short list of constants. A row is repeated once per fold it belongs to,
    by an array built inside the row, not by a range join.
    """
    need(df, [date_col])
    d = F.col(date_col).cast("timestamp_ntz")
    ends = df.agg(F.min(d).alias("lo"), F.max(d).alias("hi"))
    months = F.months_between(F.col("hi").cast("timestamp"), F.col("lo").cast("timestamp"))
    count = F.floor((months - train) / step) + 1
    bounds = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(0)).cast("int"))).alias("i"))
    shift = F.lit(train) + F.col("i") * step
    rows = bounds.select("i", (F.col("lo") + F.make_interval(months=shift)).alias("a"),
                         (F.col("lo") + F.make_interval(months=shift + val)).alias("b"), "hi").filter(
        F.col("a") <= F.col("hi")).orderBy("i").collect()
    if not rows:
        raise DataError("the table spans fewer months than one training window")
    ts = lambda v: F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")
    folds = F.array(*[
        F.when(d < ts(r["b"]), F.struct(F.lit(n).cast("bigint").alias("fold"),
                                        F.when(d < ts(r["a"]), "train").otherwise("val").alias("role")))
        for n, r in enumerate(rows)])
    return df.withColumn("_f", F.explode(F.array_compact(folds))).select("*", "_f.*").drop("_f")


def point_in_time_join(entities: DataFrame, features: DataFrame, key: str, ts: str = "event_timestamp",
                       ttl_seconds: int | None = 86_400, tie: Sequence[str] = (), bucket_seconds: int = 600) -> DataFrame:
    """Latest feature row at or before each entity time, dropped when older than the TTL.

    A key's timeline is cut into buckets, so one task sees one bucket of one key, even if the
    key holds a third of all rows. The last feature row of every bucket (combined on the map
    side) is carried to the next bucket that asks for one. Neither a range join nor a sort of a
    whole key is needed; only one row per bucket of a key meets in the carry step.
    """
    if ts in (key, *tie):
        raise DataError("the time column cannot be a key")
    cols = [c for c in features.columns if c not in (key, ts)]
    bucket = F.floor(micros(F.col(ts)) / F.lit(bucket_seconds * 1_000_000)).cast("bigint")
    payload = F.struct(F.col(ts).alias("feature_timestamp"), *cols)
    order = F.struct(ts, *tie) if tie else F.struct(ts, *cols)
    feats = (features.filter(F.col(ts).isNotNull()).withColumn("_b", bucket)
             .groupBy(key, "_b", ts).agg(F.max_by(payload, order).alias("_p")))
    asked = entities.select(key, ts).filter(F.col(ts).isNotNull()).distinct().withColumn("_b", bucket)

    last = feats.groupBy(key, "_b").agg(F.max_by("_p", ts).alias("_p"))
    buckets = last.unionByName(asked.select(key, "_b").distinct(), allowMissingColumns=True) \
        .groupBy(key, "_b").agg(F.first("_p", ignorenulls=True).alias("_p"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.select(key, "_b", F.last("_p", ignorenulls=True).over(earlier).alias("_p")).filter("_p is not null")

    events = (carry.select(key, "_b", F.lit(0).alias("_k"), F.lit(None).cast("timestamp_ntz").alias(ts), "_p")
              .unionByName(feats.select(key, "_b", F.lit(1).alias("_k"), F.col(ts).cast("timestamp_ntz").alias(ts), "_p"))
              .unionByName(asked.select(key, "_b", F.lit(2).alias("_k"), F.col(ts).cast("timestamp_ntz").alias(ts)),
                           allowMissingColumns=True))
    within = Window.partitionBy(key, "_b").orderBy(F.col(ts).asc_nulls_first(), "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("_hit", F.last("_p", ignorenulls=True).over(within)).filter("_k = 2")
    if ttl_seconds is not None:
        age = micros(F.col(ts)) - micros(F.col("_hit.feature_timestamp"))
        found = found.withColumn("_hit", F.when(age <= ttl_seconds * 1_000_000, F.col("_hit")))
    found = found.select(key, ts, F.col("_hit.feature_timestamp").alias("feature_timestamp"),
                         *[F.col(f"_hit.{c}").alias(c) for c in cols])
    return entities.join(found, [key, ts], "left")


def visits_before_end(members: DataFrame, visits: DataFrame, ref, days: int = 30) -> DataFrame:
    """Visits 0 to ``days`` days before each member's cancel date, or before ``ref`` while active.

    Visits are counted per member and moment before the join, so a hot member joins as few rows.
    """
    ends = members.select("member_id", F.coalesce("cancel_date", as_ts(ref)).alias("_end"))
    daily = visits.groupBy("member_id", "visit_date").agg(F.count("*").alias("_n"))
    hit = daily.join(ends, "member_id").filter(days_between(F.col("_end"), F.col("visit_date")).between(0, days))
    counts = hit.groupBy("member_id").agg(F.sum("_n").alias("visit_frequency"))
    return members.select("member_id").join(counts, "member_id", "left").select(
        "member_id", F.coalesce("visit_frequency", F.lit(0)).alias("visit_frequency"))


def category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<col>_code``: position of the value among the sorted distinct values, -1 for null.

    Only the distinct values are ranked, in ranges. Rows get their code by a join that leaves rows without a value out and is
    split where one value has many rows; where the codes are few, Spark sends them to the rows instead.
    """
    for c in cols:
        codes = ranked_values(df.select(F.col(c).alias("_v")), "_v").withColumnRenamed("rank", "_code")
        known = df.where(F.col(c).isNotNull()).join(codes, F.col(c) == F.col("_v")).withColumnRenamed("_code", f"{c}_code").drop("_v")
        df = known.unionByName(df.where(F.col(c).isNull()).withColumn(f"{c}_code", F.lit(-1).cast("bigint")))
    return df


def fit_percentiles(df: DataFrame, cols: Sequence[str], p: float) -> dict[str, float]:
    """Exact percentile of each column (one long-form job; one number per column returns)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    return {r["column"]: r["p"] for r in percentile_rows(long, "value", {"p": p}, ["column"])}


def impute(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    """Replace nulls by values fitted on the training rows, e.g. ``fit_percentiles(train, cols, 0.5)``."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(v))) for c, v in fills.items()})


def winsorise(df: DataFrame, caps: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) > v, F.lit(float(v))).otherwise(F.col(c).cast("double")) for c, v in caps.items()})


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Subtract the mean and divide by the population deviation (constant columns become 0)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in cols})
