"""Lifetime value from survival probabilities, segments and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.errors import DataError
from tenura.functions import round_dec
from tenura.functions.ordered import exact_percentiles, percentile_rows
from tenura.operators.features import fit_percentiles
from tenura.operators.survival import CoxModel, predict_survival


def monthly_discounts(rate: float, months: int) -> list[float]:
    return [1.0 / (1.0 + rate) ** t for t in range(1, months + 1)]


def _dot(s: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(s, F.lit(weights), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def estimate_ltv(members: DataFrame, model: CoxModel, rate: float = 0.01, months: int = 36, fill_price: str | None = None,
                 digits: int = 2) -> DataFrame:
    """Value and expected months over the horizon, from one array per row and no shuffle.

    ``rate`` is monthly; a yearly 12 % is 0.12 / 12. With ``fill_price='median'`` members without
    a price get the median price, otherwise their value is null.
    """
    missing = [c for c in ("member_id", "monthly_price") if c not in members.columns]
    if missing:
        raise DataError(f"members is missing columns {missing}")
    price = F.col("monthly_price")
    if fill_price == "median":
        price = F.coalesce(price, F.lit(float(fit_percentiles(members, ["monthly_price"], 0.5)["monthly_price"])))
    elif fill_price is not None:
        raise DataError(f"unknown fill {fill_price!r}")
    rows = predict_survival(model, members, list(range(1, months + 1)), "_s")
    value = price * _dot(F.col("_s"), monthly_discounts(rate, months))
    return rows.select("member_id", round_dec(_dot(F.col("_s"), [1.0] * months), digits).alias("expected_remaining_tenure"),
                       round_dec(price, digits).alias("expected_monthly_revenue"), round_dec(value, digits).alias("ltv"))


def segment_ltv(ltv: DataFrame, col: str = "ltv") -> DataFrame:
    """``high`` from the 75th percentile, ``medium`` from the 25th, else ``low`` (both exact)."""
    if col not in ltv.columns:
        raise DataError(f"no column {col!r}")
    rows = percentile_rows(ltv, col, {"p25": 0.25, "p75": 0.75})
    q, v = (rows[0] if rows else None), F.col(col)
    if q is None or q["p25"] is None:
        return ltv.withColumn("ltv_segment", F.lit(None).cast("string"))
    return ltv.withColumn("ltv_segment", F.when(v >= q["p75"], "high").when(v >= q["p25"], "medium").otherwise("low"))


def ltv_summary(ltv: DataFrame, by: Sequence[str], col: str = "ltv") -> DataFrame:
    stats = ltv.groupBy(*by).agg(F.count(col).alias("count"), round_dec(F.avg(col), 4).alias("mean_ltv"),
                                 round_dec(F.stddev_samp(col), 4).alias("std_ltv"))
    medians = exact_percentiles(ltv, col, {"median_ltv": 0.5}, by)
    return stats.join(medians, list(by), "left").withColumn("median_ltv", round_dec(F.col("median_ltv"), 4))
