"""Cleaning, deduplication and standardisation of the raw tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tenura.config import ACTION_ALIASES, ACTION_TYPES, MemberRules
from tenura.errors import DataError
from tenura.functions import days_between


def parse_dates(df: DataFrame, cols: Sequence[str], formats: Sequence[str] = ()) -> DataFrame:
    """Turn text dates into timestamps; text that is no date becomes null."""
    types = dict(df.dtypes)

    def parsed(c: str) -> Column:
        if types[c] != "string":
            return F.col(c).cast("timestamp_ntz")
        tries = [F.col(c).try_cast("timestamp_ntz")]
        tries += [F.try_to_timestamp(F.col(c), F.lit(f)).cast("timestamp_ntz") for f in formats]
        return F.coalesce(*tries)

    return df.withColumns({c: parsed(c) for c in cols if c in types})


def keep_last(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the last in the given order.

    ``max_by`` is combined on the map side, so a key with very many copies ships one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*[F.col(c) for c in order_by])
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def null_fractions(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Rows ``(column, null_fraction, threshold, passed)`` from one pass; absent columns are skipped."""
    cols = [c for c in limits if c in df.columns]
    if not cols:
        raise DataError("none of the limited columns exists")
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(0.0)).alias("null_fraction"),
                 F.lit(float(limits[c])).alias("threshold"),
                 (F.coalesce(F.col(c), F.lit(0.0)) <= float(limits[c])).alias("passed")) for c in cols])
    return one.select(F.inline(rows))


def enforce_null_limits(df: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """The input unchanged, or an error naming every column above its limit (runs one aggregate)."""
    bad = null_fractions(df, limits).filter(~F.col("passed")).collect()
    if bad:
        raise DataError("; ".join(f"{r['column']}: {r['null_fraction']:.2%} null, limit "
                                  f"{r['threshold']:.2%}" for r in bad))
    return df


def repair_domains(df: DataFrame, rules: MemberRules = MemberRules()) -> DataFrame:
    """Unknown or missing contract sources become ``regular``; unknown plans become ``basic``."""
    source, plan = F.col("contract_source"), F.col("plan_type")
    known = F.coalesce(source.isin(*rules.contract_sources), F.lit(False))
    return df.withColumns({
        "contract_source": F.when(known, source).otherwise("regular"),
        "plan_type": F.when(plan.isNull() | plan.isin(*rules.plan_types), plan).otherwise("basic"),
    })


def limit_durations(df: DataFrame, rules: MemberRules = MemberRules(), mode: str = "filter") -> DataFrame:
    """Keep visits inside the inclusive bounds, or with ``mode='clip'`` cap the long ones."""
    minutes = F.col("visit_duration_minutes")
    if mode == "filter":
        return df.filter(minutes.between(rules.min_minutes, rules.max_minutes))
    if mode == "clip":
        return df.withColumn("visit_duration_minutes", F.least(minutes, F.lit(rules.max_minutes)))
    raise DataError(f"unknown mode {mode!r}")


def drop_undated(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def keep_known_actions(df: DataFrame, aliases: Mapping[str, str] = ACTION_ALIASES) -> DataFrame:
    """Translate old action names, then drop rows of any other type."""
    kind = F.col("action_type")
    for old, new in aliases.items():
        kind = F.when(F.col("action_type") == old, F.lit(new)).otherwise(kind)
    return df.withColumn("action_type", kind).filter(F.col("action_type").isin(*ACTION_TYPES))


def merge_reenrollments(spells: DataFrame, window_days: int = 30, tie: str = "load_id") -> DataFrame:
    """Join membership spells of a member when the next starts at most ``window_days`` after a cancel.

    The cancel that counts is the latest of all earlier spells, so a short spell inside a long one does not end it.
    An open spell does: the next one starts anew.
    The merged spell has the earliest join date, the latest cancel date (none while it is open)
    and the attributes of its first spell. Spells that start on the same day are combined before
    the window (open if one of them is), so a member's window holds at most one row per calendar
    day however often it was loaded.
    """
    rest = [c for c in spells.columns if c not in ("member_id", "join_date", "cancel_date", "churned")]
    open_end = F.bool_or(F.col("cancel_date").isNull())
    daily = spells.filter(F.col("join_date").isNotNull()).groupBy("member_id", F.to_date("join_date").alias("_day")).agg(
        F.min("join_date").alias("join_date"), F.when(~open_end, F.max("cancel_date")).alias("cancel_date"),
        F.min_by(F.struct(*rest), F.col(tie)).alias("_rest"))
    by_member = Window.partitionBy("member_id").orderBy("join_date")
    latest = F.max("cancel_date").over(by_member.rowsBetween(Window.unboundedPreceding, -1))
    was_open = F.lag("cancel_date").over(by_member).isNull()
    starts = was_open | ~F.coalesce(days_between(F.col("join_date"), latest) <= window_days, F.lit(False))
    merged = (daily.withColumn("_start", starts.cast("int"))
              .withColumn("_island", F.sum("_start").over(
                  by_member.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("member_id", "_island")
              .agg(F.min("join_date").alias("join_date"),
                   F.when(~open_end, F.max("cancel_date")).alias("cancel_date"),
                   F.min_by("_rest", "join_date").alias("_rest"),
                   F.count("*").alias("n_spells")))
    return merged.select("member_id", "join_date", "cancel_date",
                         F.col("cancel_date").isNotNull().alias("churned"), "n_spells", "_rest.*")


def clean_members(raw: DataFrame, order_by: Sequence[str], rules: MemberRules = MemberRules(),
                  gate: bool = False) -> DataFrame:
    """Parse dates, merge re-enrolments, keep one row per member, check null shares, repair categories.

    Spells are merged before a member's rows are reduced to the last one, which would leave nothing to merge. The row that stays has
    the attributes of the member's last row in the given order, and the join date, cancel date and ``churned`` of the latest
    membership after merging: a return within ``reenrollment_window_days`` of a cancel carries the first join date on.
    Members without any readable join date keep their last row as it is.
    """
    parsed = parse_dates(raw, ["join_date", "cancel_date"])
    last = keep_last(parsed, ["member_id"], order_by)
    spells = parsed.select("member_id", "join_date", "cancel_date", F.struct(*order_by).alias("_order"))
    merged = merge_reenrollments(spells, rules.reenrollment_window_days, "_order")
    tenure = merged.groupBy("member_id").agg(F.max(F.struct("join_date", "cancel_date", "churned")).alias("_t"))
    own = {c: F.when(F.col("_t").isNotNull(), F.col("_t")[c]).otherwise(F.col(c)) for c in ("join_date", "cancel_date", "churned") if c in raw.columns}
    df = last.join(tenure, "member_id", "left").withColumns(own).select(*raw.columns)
    if gate:
        enforce_null_limits(df, rules.null_limits)
    return repair_domains(df, rules)


def clean_visits(raw: DataFrame, rules: MemberRules = MemberRules(), mode: str = "filter") -> DataFrame:
    df = drop_exact_duplicates(parse_dates(raw, ["visit_date"]))
    return drop_undated(limit_durations(df, rules, mode), ["visit_date"])


def clean_actions(raw: DataFrame) -> DataFrame:
    df = drop_exact_duplicates(parse_dates(raw, ["action_date"]))
    return drop_undated(keep_known_actions(df), ["action_date"])


def visit_rejects(raw: DataFrame, rules: MemberRules = MemberRules()) -> DataFrame:
    """How many rows each visit-cleaning step removes, as ``(step, n)``.

    Copies are counted as total minus distinct, so only one row per distinct visit moves.
    """
    df = parse_dates(raw, ["visit_date"])
    minutes = F.col("visit_duration_minutes")
    in_range = F.coalesce(minutes.between(rules.min_minutes, rules.max_minutes), F.lit(False))
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    one = counted.agg(
        F.sum("_n").alias("read"), F.sum(F.col("_n") - 1).alias("duplicate"),
        F.count_if(~in_range).alias("duration"),
        F.count_if(in_range & F.col("visit_date").isNull()).alias("undated"),
        F.count_if(in_range & F.col("visit_date").isNotNull()).alias("kept"))
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("step"), F.coalesce(F.col(s), F.lit(0)).alias("n"))
        for s in ("read", "duplicate", "duration", "undated", "kept")])))


def write_clean_visits(raw: DataFrame, path: str, rules: MemberRules = MemberRules()) -> DataFrame:
    """Clean the visits, write them, and give the reject counts ``(step, n)`` that the write itself observed.

    Counters sit on the rows that pass by: what was read, and after the copies are gone what each filter is about to drop. No row is
    read a second time. Counts are those of the job that wrote (a lost executor's repeated tasks may be counted again).
    """
    seen, kept = Observation(), Observation()
    minutes = F.col("visit_duration_minutes")
    in_range = F.coalesce(minutes.between(rules.min_minutes, rules.max_minutes), F.lit(False))
    distinct = drop_exact_duplicates(parse_dates(raw, ["visit_date"]).observe(seen, F.count(F.lit(1)).alias("read")))
    counted = distinct.observe(kept, F.count(F.lit(1)).alias("distinct"), F.count_if(~in_range).alias("duration"),
                               F.count_if(in_range & F.col("visit_date").isNull()).alias("undated"), F.count_if(in_range & F.col("visit_date").isNotNull()).alias("kept"))
    drop_undated(limit_durations(counted, rules), ["visit_date"]).write.mode("overwrite").parquet(path)
    got = {**seen.get, **kept.get}
    rows = [("read", got["read"]), ("duplicate", got["read"] - got["distinct"]), *[(s, got[s]) for s in ("duration", "undated", "kept")]]
    return raw.sparkSession.createDataFrame(rows, "step string, n bigint")


def to_utc(df: DataFrame, ts: str, zone: str, out: str) -> DataFrame:
    """Local event times to UTC, with the zone name taken from a column."""
    local = F.to_utc_timestamp(F.col(ts).cast("timestamp"), F.col(zone))
    return df.withColumn(out, local.cast("timestamp_ntz"))
