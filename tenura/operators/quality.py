"""Data-quality suites: one pass per table, one row per check."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.errors import QualityError, StaleFeaturesError
from tenura.functions import as_ts, round_dec

Check = tuple[str, str, Column]  # check name, column, aggregate giving the number of bad rows


def _suite(df: DataFrame, suite: str, checks: Sequence[Check]) -> DataFrame:
    one = df.agg(*[agg.cast("bigint").alias(f"_c{i}") for i, (_, _, agg) in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(suite).alias("suite"), F.lit(name).alias("check"), F.lit(col).alias("column"),
                 F.coalesce(F.col(f"_c{i}"), F.lit(0)).alias("n_bad"),
                 (F.coalesce(F.col(f"_c{i}"), F.lit(0)) == 0).alias("passed"))
        for i, (name, col, _) in enumerate(checks)])
    return one.select(F.inline(rows))


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def _bad(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _constant(value: int) -> Column:
    """An aggregate with a known result, also over an empty table."""
    return F.coalesce(F.max(F.lit(value)), F.lit(value))


def _present(df: DataFrame, required: Sequence[str]) -> list[Check]:
    """Schema-only check: the number of bad rows is 1 for a missing column."""
    return [("required", c, _constant(int(c not in df.columns))) for c in required]


def _unparseable(col: str) -> Column:
    return F.col(col).isNotNull() & F.col(col).cast("string").try_cast("timestamp_ntz").isNull()


def required_columns(df: DataFrame, required: Sequence[str], suite: str = "schema") -> DataFrame:
    return _suite(df.filter(F.lit(False)), suite, _present(df, required))


def bronze_members(df: DataFrame) -> DataFrame:
    checks = _present(df, ["member_id", "location_id", "join_date", "churned", "contract_source",
                           "monthly_price"])
    if _has(df, "member_id"):
        m = F.col("member_id")
        distinct = F.count_distinct(m) + F.max(m.isNull().cast("int"))
        checks += [("null", "member_id", _bad(m.isNull())),
                   ("duplicate", "member_id", F.count(F.lit(1)) - distinct)]
    if _has(df, "location_id"):
        checks.append(("null", "location_id", _bad(F.col("location_id").isNull())))
    if _has(df, "join_date"):
        checks.append(("unparseable", "join_date", _bad(_unparseable("join_date"))))
    return _suite(df, "bronze_members", checks)


def bronze_visits(df: DataFrame) -> DataFrame:
    checks = _present(df, ["member_id", "location_id", "visit_date", "visit_duration_minutes"])
    if _has(df, "visit_date"):
        checks.append(("unparseable", "visit_date", _bad(_unparseable("visit_date"))))
    if _has(df, "visit_duration_minutes"):
        checks.append(("negative", "visit_duration_minutes", _bad(F.col("visit_duration_minutes") < 0)))
    return _suite(df, "bronze_visits", checks)


def bronze_actions(df: DataFrame) -> DataFrame:
    checks = _present(df, ["member_id", "location_id", "action_date", "action_type", "cost"])
    if _has(df, "cost"):
        checks.append(("negative", "cost", _bad(F.col("cost") < 0)))
    return _suite(df, "bronze_retention_actions", checks)


def _is_time(df: DataFrame, col: str) -> list[Check]:
    kind = dict(df.dtypes).get(col, "")
    return [("timestamp_type", col, _constant(int(not kind.startswith(("timestamp", "date")))))]


def silver_members(df: DataFrame, sources: Sequence[str] = ("regular", "aggregator")) -> DataFrame:
    checks: list[Check] = []
    if _has(df, "join_date"):
        checks += _is_time(df, "join_date") + [("null", "join_date", _bad(F.col("join_date").isNull()))]
    if _has(df, "cancel_date", "join_date"):
        checks.append(("before_join", "cancel_date", _bad(F.col("cancel_date") < F.col("join_date"))))
    if _has(df, "contract_source"):
        known = F.coalesce(F.col("contract_source").isin(*sources), F.lit(False))
        checks.append(("unknown_value", "contract_source", _bad(~known)))
    if _has(df, "monthly_price"):
        checks.append(("non_positive", "monthly_price", _bad(F.col("monthly_price") <= 0)))
    if _has(df, "churned", "cancel_date"):
        checks.append(("churned_without_date", "churned", _bad(F.col("churned") & F.col("cancel_date").isNull())))
    return _suite(df, "silver_members", checks)


def silver_visits(df: DataFrame, low: int = 5, high: int = 300) -> DataFrame:
    checks: list[Check] = []
    if _has(df, "visit_date"):
        checks += _is_time(df, "visit_date")
    if _has(df, "visit_duration_minutes"):
        m = F.col("visit_duration_minutes")
        checks += [("too_short", "visit_duration_minutes", _bad(m < low)),
                   ("too_long", "visit_duration_minutes", _bad(m > high))]
    return _suite(df, "silver_visits", checks)


def gold_member_360(df: DataFrame) -> DataFrame:
    checks = _present(df, ["member_id", "location_id", "tenure_days", "visit_count_30d",
                           "days_since_last_visit", "retention_action_count"])
    checks += [("negative", c, _bad(F.col(c) < 0)) for c in df.columns if c.startswith("visit_count_")]
    if _has(df, "tenure_days"):
        checks.append(("negative", "tenure_days", _bad(F.col("tenure_days") < 0)))
    if _has(df, "days_since_last_visit"):
        checks.append(("below_minus_one", "days_since_last_visit", _bad(F.col("days_since_last_visit") < -1)))
    if _has(df, "visit_count_30d"):
        checks.append(("above_500", "visit_count_30d", _bad(F.col("visit_count_30d") > 500)))
    if _has(df, "retention_action_count"):
        checks.append(("negative", "retention_action_count", _bad(F.col("retention_action_count") < 0)))
    return _suite(df, "gold_member_360", checks)


def gold_locations(df: DataFrame) -> DataFrame:
    checks = _present(df, ["location_id", "active_members", "churn_rate", "mrr"])
    if _has(df, "churn_rate"):
        checks.append(("outside_0_1", "churn_rate", _bad((F.col("churn_rate") < 0) | (F.col("churn_rate") > 1))))
    if _has(df, "mrr"):
        checks.append(("negative", "mrr", _bad(F.col("mrr") < 0)))
    return _suite(df, "gold_location_aggregates", checks)


def orphan_rows(child: DataFrame, parent: DataFrame, key: str, suite: str) -> DataFrame:
    """Referential integrity. Child keys are counted first, so a hot key joins as one row."""
    keys = child.groupBy(key).agg(F.count("*").alias("_n"))
    known = parent.select(key).distinct()
    orphans = keys.join(known, key, "left_anti")
    return _suite(orphans, suite, [("orphan", key, F.sum("_n"))])


def future_cancels(members: DataFrame, ref) -> DataFrame:
    return _suite(members, "silver_members", [("future", "cancel_date", _bad(F.col("cancel_date") > as_ts(ref)))])


def mrr_balance(member_360: DataFrame, location_kpis: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Revenue summed over members against revenue summed over locations."""
    paying = ~F.col("churned") & F.col("location_id").isNotNull()
    left = member_360.agg(F.coalesce(F.sum(F.when(paying, F.col("monthly_price"))), F.lit(0.0)).alias("v")).select(
        F.lit("member").alias("side"), "v")
    right = location_kpis.agg(F.coalesce(F.sum("mrr"), F.lit(0.0)).alias("v"), F.count("*").alias("n")).select(
        F.lit("location").alias("side"), "v", "n")
    both = left.unionByName(right, allowMissingColumns=True).agg(
        F.max(F.when(F.col("side") == "member", F.col("v"))).alias("m"),
        F.max(F.when(F.col("side") == "location", F.col("v"))).alias("l"),
        F.max("n").alias("n"))
    # each location total is rounded once, so the allowance grows with their number
    gap = F.abs(F.col("m") - F.col("l"))
    return both.select(round_dec(F.col("m"), 2).alias("member_mrr"), round_dec(F.col("l"), 2).alias("location_mrr"),
                       (gap <= tolerance * F.greatest(F.col("n"), F.lit(1))).alias("passed"))


def freshness(features: DataFrame, ref, max_age_hours: float = 24.0, ts: str = "event_timestamp") -> DataFrame:
    newest = features.agg(F.max(ts).alias("newest"))
    age = (F.unix_micros(as_ts(ref).cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 3.6e9
    return newest.select("newest", round_dec(age, 4).alias("age_hours"),
                         F.coalesce(age <= max_age_hours, F.lit(False)).alias("passed"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, null count and share, distinct count and an example value for every column.

    Exact: a scan turns the rows into (column, value as text) and counts them where they are read, so a common value moves once
    per task, and only distinct values move at all. ``exact=False`` keeps sketches instead (relative error about 5 %), and moves only these.
    """
    kinds = dict(df.dtypes)
    named = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(i), F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype")))])
    if exact:
        cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("string").alias("_v")) for i, c in enumerate(df.columns)])))
        counts = cells.groupBy("_i", "_v").agg(F.count("*").alias("_n"))
        long = counts.groupBy("_i").agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"), F.sum("_n").alias("_n"),
                                        F.count("_v").alias("n_unique"), F.min("_v").alias("example"))
        seen = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("_i")).join(long, "_i", "left").fillna(0, ["nulls", "n_unique"])
    else:
        aggs = [F.count(F.lit(1)).alias("_n")]
        for i, c in enumerate(df.columns):
            aggs += [F.count_if(F.col(c).isNull()).alias(f"_z{i}"), F.approx_count_distinct(c).alias(f"_d{i}"), F.min(F.col(c).cast("string")).alias(f"_e{i}")]
        rows = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_z{i}").alias("nulls"), F.col("_n"), F.col(f"_d{i}").alias("n_unique"), F.col(f"_e{i}").alias("example")) for i in range(len(df.columns))])
        seen = df.agg(*aggs).select(F.inline(rows))
    return seen.select(named[F.col("_i")]["column"].alias("column"), named[F.col("_i")]["dtype"].alias("dtype"), "nulls",
                       round_dec(F.try_divide(F.col("nulls") * 100.0, F.col("_n")), 1).alias("null_pct"), "n_unique", "example")


def require(*suites: DataFrame) -> None:
    """Block a pipeline on the first failed check; reads only the few check rows."""
    bad = reduce(DataFrame.unionByName, suites).filter(~F.col("passed")).collect()
    if bad:
        raise QualityError("; ".join(f"{r['suite']}.{r['check']}({r['column']}): {r['n_bad']}" for r in bad))


def require_fresh(features: DataFrame, ref, max_age_hours: float = 24.0) -> None:
    row = freshness(features, ref, max_age_hours).first()
    if not row["passed"]:
        raise StaleFeaturesError(f"newest feature row is {row['age_hours']} hours old")
