"""Drift tests, model gates and business checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.config import DRIFT_FEATURES
from tenura.functions import as_ts, flag, minus_days, round_dec, safe_div
from tenura.functions.ordered import count_percentiles, prefix_sums
from tenura.operators import churn
from tenura.session import checkpointed


def split_windows(df: DataFrame, ts: str, ref, reference_days: int = 90, current_days: int = 7) -> DataFrame:
    """Tag rows ``current`` (the last days before ref) or ``reference`` (the days before those)."""
    t, cut = F.col(ts), minus_days(ref, current_days)
    rows = df.filter((t < as_ts(ref)) & (t >= minus_days(ref, current_days + reference_days)))
    return rows.withColumn("window", F.when(t >= cut, "current").otherwise("reference"))


def _both(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long rows (feature, value, is_cur) for features both tables have."""
    shared = [f for f in features if f in reference.columns and f in current.columns]
    cast = [F.col(f).cast("double").alias(f) for f in shared]
    rows = reference.select(F.lit(0).alias("is_cur"), *cast).unionByName(current.select(F.lit(1).alias("is_cur"), *cast))
    return rows.unpivot(["is_cur"], shared, "feature", "value").filter("value is not null")


def _kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_test(reference: DataFrame, current: DataFrame, features: Sequence[str] = tuple(DRIFT_FEATURES), alpha: float = 0.05) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of each feature, with the asymptotic p-value.

    Values collapse to counts per feature, and the two distribution functions are running totals
    split by value ranges, so one feature is never sorted in one task.
    """
    return _ks(value_table(reference, current, features), alpha)


def _ks(counts: DataFrame, alpha: float) -> DataFrame:
    run = prefix_sums(counts, F.col("value"), ["ref", "cur"], ["feature"], null_keys=False)
    gap = F.abs(F.col("cum_ref") / F.col("total_ref") - F.col("cum_cur") / F.col("total_cur"))
    stats = run.filter("total_ref > 0 and total_cur > 0").groupBy("feature").agg(
        F.max(gap).alias("d"), F.max("total_ref").alias("n_reference"), F.max("total_cur").alias("n_current"))
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    p = _kolmogorov_tail(F.sqrt(n * m / (n + m)) * F.col("d"))
    return stats.select("feature", "n_reference", "n_current", round_dec(F.col("d"), 6).alias("statistic"),
                        round_dec(p, 6).alias("p_value"), (p < alpha).alias("drifted"))


def value_table(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (feature, value, ref, cur): how often each value occurs in either table. One scan of each, whatever the number of features."""
    return _both(reference, current, features).groupBy("feature", "value").agg(F.sum(1 - F.col("is_cur")).alias("ref"), F.sum("is_cur").alias("cur"))


def psi_edges(values: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges): the distinct percentiles of the reference's values, at most ``bins + 1``, in order."""
    probs = {f"p{i}": i / bins for i in range(bins + 1)}
    counts = values.filter("ref > 0").select("feature", F.col("value").alias("_x"), F.col("ref").alias("n"))
    return count_percentiles(counts, probs, ["feature"]).select("feature", F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))


def psi_table(values: DataFrame, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Rows (feature, psi, n_bins, n_out_of_range) from a ``value_table``, for all features at once.

    Edges are one row per feature; values are placed between them where they lie, and only counts per feature and bin move.
    Values outside the reference's range are left out before normalising, and counted. Bins are half open, the last one
    is closed. Fewer than two distinct edges give 0.
    """
    k = F.size("edges") - 1
    at = F.size(F.filter("edges", lambda e: e <= F.col("value"))) - 1  # -1 below the range
    last = F.when(F.col("value") == F.element_at("edges", -1), k - 1).when(F.col("value") > F.element_at("edges", -1), F.lit(-1)).otherwise(at)
    placed = values.join(psi_edges(values, bins), "feature").select("feature", k.alias("k"), last.alias("bin"), "ref", "cur")
    counts = placed.groupBy("feature", "k", "bin").agg(F.sum("ref").alias("e"), F.sum("cur").alias("a"))
    inside = F.col("bin") >= 0
    total = lambda c: F.greatest(F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)), F.lit(1))
    one = counts.groupBy("feature", "k").agg(F.map_from_entries(F.collect_list(F.when(inside, F.struct("bin", F.struct("e", "a"))))).alias("_c"), total("e").alias("_te"), total("a").alias("_ta"),
                                             F.coalesce(F.sum(F.when(~inside, F.col("a"))), F.lit(0)).alias("out"))

    def share(i: Column, c: str, t: str) -> Column:
        part = F.coalesce(F.try_element_at("_c", i)[c], F.lit(0)) / F.col(t)
        return F.when(part == 0, eps).otherwise(part)

    term = lambda acc, i: acc + (share(i, "a", "_ta") - share(i, "e", "_te")) * F.ln(share(i, "a", "_ta") / share(i, "e", "_te"))
    value = F.when(F.col("k") < 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("k") - 1, F.lit(0))), F.lit(0.0), term))
    return one.select("feature", round_dec(value, 6).alias("psi"), F.greatest(F.col("k"), F.lit(0)).cast("bigint").alias("n_bins"), F.when(F.col("k") < 1, 0).otherwise(F.col("out")).cast("bigint").alias("n_out_of_range"))


def psi(reference: DataFrame, current: DataFrame, col: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index of one column; see ``psi_table``. A reference without values gives 0."""
    found = psi_table(value_table(reference, current, [col]), bins, eps).drop("feature")
    return found.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("psi"), F.coalesce(F.max("n_bins"), F.lit(0).cast("bigint")).alias("n_bins"),
                     F.coalesce(F.max("n_out_of_range"), F.lit(0).cast("bigint")).alias("n_out_of_range"))


def prediction_drift(reference: DataFrame, current: DataFrame, col: str, threshold: float = 0.2) -> DataFrame:
    return psi(reference, current, col).select("psi", (F.col("psi") > threshold).alias("is_drifted"))


def drift_report(reference: DataFrame, current: DataFrame, features: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """KS test, PSI and summary statistics per feature, as rows to store.

    The tables are read once, into counts of the values of all features; everything else comes from these.
    """
    values = checkpointed(value_table(reference, current, features))
    stat, spread = [], []
    for tag, c in (("reference", "ref"), ("current", "cur")):
        v, n = F.when(F.col(c) > 0, F.col("value")), F.col(c)
        stat += [F.sum(n).alias(f"_n_{tag}"), F.try_divide(F.sum(v * n), F.sum(n)).alias(f"_m_{tag}"), F.min(v).alias(f"min_{tag}"), F.max(v).alias(f"max_{tag}")]
        off = F.col("value") - F.col(f"_m_{tag}")
        spread += [F.sum(F.when(n > 0, n * off * off)).alias(f"_q_{tag}")]
    means = values.groupBy("feature").agg(*stat)
    squares = values.join(means.select("feature", "_m_reference", "_m_current"), "feature").groupBy("feature").agg(*spread)
    cols = []
    for tag in ("reference", "current"):
        n = F.col(f"_n_{tag}")
        cols += [round_dec(F.col(f"_m_{tag}"), 6).alias(f"mean_{tag}"), round_dec(F.sqrt(F.when(n > 1, F.col(f"_q_{tag}") / (n - 1))), 6).alias(f"std_{tag}"), f"min_{tag}", f"max_{tag}"]
    summary = means.join(squares, "feature").select("feature", *cols)
    return _ks(values, alpha).join(summary, "feature").join(psi_table(values).select("feature", "psi", "n_out_of_range"), "feature")


def drift_histograms(reference: DataFrame, current: DataFrame, feature: str, bins: int = 10) -> DataFrame:
    from tenura.operators.eda import histogram

    return histogram(_both(reference, current, [feature]), "value", bins, ["is_cur"])


def performance_gate(df: DataFrame, label: str, score: str, key: str, auc: float = 0.80, precision: float = 0.40,
                     k: int = 100, brier: float = 0.25) -> DataFrame:
    """Rows ``(metric, value, threshold, passed)``; the Brier score must stay below its limit."""
    row = lambda df, metric, col, limit, ok: df.select(
        F.lit(metric).alias("metric"), F.col(col).alias("value"), F.lit(limit).alias("threshold"), ok.alias("passed"))
    a = churn.ranking_metrics(df, label, score)
    p = churn.precision_at_k(df, label, score, key, k)
    b = churn.brier(df, label, score)
    return (row(a, "auc_roc", "auc_roc", auc, F.col("auc_roc") >= auc)
            .unionByName(row(p, "precision_at_k", "precision_at_k", precision, F.col("precision_at_k") >= precision))
            .unionByName(row(b, "brier_score", "brier_score", brier, F.col("brier_score") <= brier)))


def retrain_triggers(history: DataFrame, model: str, day: str, metric: str, threshold: float = 0.78, cooldown_days: int = 7) -> DataFrame:
    """Days on which a model is retrained: its metric is low and the last retraining is long enough ago.

    The history is reduced to one row per model and day; a model's low days (at most one per
    calendar day) are walked in order inside one array.
    """
    low = history.groupBy(model, F.to_date(day).alias("_d")).agg(F.min(metric).alias("_m")).filter(F.col("_m") < threshold)
    days = low.groupBy(model).agg(F.array_sort(F.collect_list("_d")).alias("_days"))
    picked = F.expr(
        "aggregate(_days, cast(array() as array<date>), (acc, d) -> CASE WHEN size(acc) = 0 THEN array(d) "
        f"WHEN date_diff(d, element_at(acc, -1)) >= {int(cooldown_days)} THEN concat(acc, array(d)) ELSE acc END)")
    return days.select(model, F.explode(picked).alias("trigger_day"))


def churn_rate_gap(scored: DataFrame, by: str, label: str = "churned", score: str = "churn_probability", tolerance_pp: float = 2.0) -> DataFrame:
    gap = F.abs(F.col("actual_churn_rate") - F.col("predicted_churn_rate")) * 100
    return scored.groupBy(by).agg(
        round_dec(F.avg(flag(F.col(label))), 6).alias("actual_churn_rate"), round_dec(F.avg(score), 6).alias("predicted_churn_rate")).select(
        by, "actual_churn_rate", "predicted_churn_rate", round_dec(gap, 4).alias("difference_pp"), (round_dec(gap, 4) > tolerance_pp).alias("alert"))


def action_coverage(scores: DataFrame, actions: DataFrame, high: float = 0.5, target: float = 0.5) -> DataFrame:
    """Share of high-risk members with at least one action."""
    acted = actions.select("member_id").distinct().withColumn("_a", F.lit(1))
    rows = scores.filter(F.col("churn_probability") > high).join(acted, "member_id", "left")
    share = F.avg(F.coalesce("_a", F.lit(0)).cast("double"))
    return rows.agg(F.count("*").alias("high_risk_members"), F.sum(F.coalesce("_a", F.lit(0))).alias("contacted"),
                    round_dec(share, 6).alias("coverage"), F.coalesce(share >= target, F.lit(False)).alias("passed"))
