"""Feature tables as plain files: a registry of views, publishing, and latest-value retrieval."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.errors import DataError

# The feature columns and types of each view.
VIEWS = {
    "visit_behavior": {"visit_count_7d": "bigint", "visit_count_14d": "bigint", "visit_count_30d": "bigint",
                       "visit_count_60d": "bigint", "visit_count_90d": "bigint", "avg_visit_duration_30d": "double",
                       "days_since_last_visit": "bigint", "visit_frequency_trend": "double"},
    "tenure": {"tenure_days": "bigint", "tenure_months": "double", "is_first_90_days": "bigint"},
    "financial": {"monthly_price": "double", "total_revenue": "double", "payment_delay_flag": "bigint"},
}


def conform(df: DataFrame, view: str) -> DataFrame:
    """The rows in the registered schema of the view; missing feature columns are null."""
    if view not in VIEWS:
        raise DataError(f"unknown feature view {view!r}; known: {sorted(VIEWS)}")
    missing = [c for c in ("member_id", "event_timestamp") if c not in df.columns]
    if missing:
        raise DataError(f"feature rows need columns {missing}")
    cols = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in VIEWS[view].items()]
    return df.select("member_id", "event_timestamp", *cols)


def publish(df: DataFrame, view: str, root: str) -> None:
    rows = conform(df, view).withColumn("event_day", F.to_date("event_timestamp"))
    rows.write.mode("append").partitionBy("event_day").parquet(f"{root}/{view}")


def read_view(spark, view: str, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{view}").drop("event_day")


def latest(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Newest row per member, combined on the map side."""
    return df.groupBy("member_id").agg(F.max_by(F.struct(*cols), F.struct("event_timestamp", *cols)).alias("_f")) \
        .select("member_id", "_f.*")


def online_features(keys: DataFrame, refs: Sequence[str], views: dict[str, DataFrame]) -> DataFrame:
    """Latest values of ``view:feature`` references for the given members."""
    if not refs:
        raise DataError("no feature references given")
    wanted: dict[str, list[str]] = {}
    for ref in refs:
        view, _, feature = ref.partition(":")
        if view not in VIEWS or feature not in VIEWS[view]:
            raise DataError(f"unknown feature reference {ref!r}")
        wanted.setdefault(view, []).append(feature)
    ids = keys.select("member_id").distinct()
    # the history is reduced to one row per member where it is read, before it meets the keys: a member with a long one costs no more
    parts = [latest(views[v], cols).join(ids, "member_id", "left_semi") for v, cols in wanted.items()]
    return reduce(lambda left, right: left.join(right, "member_id", "left"), parts, ids)


def feature_service(keys: DataFrame, views: dict[str, DataFrame]) -> DataFrame:
    """All features of all three views in one retrieval."""
    return online_features(keys, [f"{v}:{c}" for v, cols in VIEWS.items() for c in cols], views)
