"""Churn models, thresholds, classification metrics, scoring and risk tiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.errors import DataError
from tenura.functions import flag, round_dec, safe_div
from tenura.functions.ordered import prefix_sums

# ---- metrics ---------------------------------------------------------------------------------


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row per distinct score with counts at or above it: the base of every ranking metric.

    Rows collapse to distinct scores first; running totals are split by score ranges.
    """
    counts = (df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score"))
              .agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")))
    run = prefix_sums(counts, -F.col("score"), ["n", "pos"])
    precision = F.col("cum_pos") / F.col("cum_n")
    recall = F.coalesce(safe_div(F.col("cum_pos"), F.nullif(F.col("total_pos"), F.lit(0))), F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return run.select("score", "n", "pos", "cum_n", "cum_pos", "total_n", "total_pos",
                      precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def _best(curve: DataFrame, by: str) -> DataFrame:
    top = F.max_by(F.struct("score", "precision", "recall", "f1"),
                   F.struct(round_dec(F.col(by), 8).alias("v"), (-F.col("score")).alias("s")))
    return curve.agg(top.alias("t")).select(
        F.col("t.score").alias("threshold"), *[round_dec(F.col(f"t.{c}"), 6).alias(c) for c in ("precision", "recall", "f1")])


def f1_threshold(df: DataFrame, label: str, score: str, min_precision: float | None = None) -> DataFrame:
    """Score with the best F1 (lowest score on ties), if asked only where precision is high enough."""
    curve = score_curve(df, label, score)
    if min_precision is not None:
        curve = curve.filter(F.col("precision") >= min_precision)
    return _best(curve, "f1")


def precision_threshold(df: DataFrame, label: str, score: str, min_recall: float = 0.5) -> DataFrame:
    """Score with the best precision while recall is at least ``min_recall``; 0.5 if there is none."""
    best = _best(score_curve(df, label, score).filter(F.col("recall") >= min_recall), "precision")
    return best.withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def threshold_value(df: DataFrame, label: str, score: str, method: str = "f1_optimal") -> float:
    """The threshold as a number; an unknown method gives 0.5."""
    pick = {"f1_optimal": f1_threshold, "precision_at_recall": precision_threshold}.get(method)
    if pick is None:
        return 0.5
    row = pick(df, label, score).first()
    return 0.5 if row["threshold"] is None else float(row["threshold"])


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve (ties count half) and under the precision-recall curve."""
    curve = score_curve(df, label, score)
    neg = F.col("n") - F.col("pos")
    total_neg = F.col("total_n") - F.col("total_pos")
    below = total_neg - (F.col("cum_n") - F.col("cum_pos"))  # negatives with a lower score
    wins = F.col("pos") * (below + neg / 2.0)
    before_n, before_pos = F.col("cum_n") - F.col("n"), F.col("cum_pos") - F.col("pos")
    prev = F.when(before_n == 0, 1.0).otherwise(safe_div(before_pos, before_n))
    step = F.col("pos") / F.col("total_pos") * (F.col("precision") + prev) / 2
    return curve.agg(
        round_dec(F.try_divide(F.sum(wins), F.max(F.col("total_pos").cast("double")) * F.max(total_neg)), 6).alias("auc_roc"),
        round_dec(F.sum(step), 6).alias("auc_pr"))


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    p, y = F.col(score) >= threshold, F.col(label).cast("int") == 1
    return df.agg(F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"),
                  F.count_if(~p & y).alias("fn"), F.count_if(p & y).alias("tp"))


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts with precision, recall and F1; a zero denominator gives 0."""
    c = confusion(df, label, score, threshold)
    zero = lambda col: F.coalesce(col, F.lit(0.0))
    precision = zero(safe_div(F.col("tp"), F.nullif(F.col("tp") + F.col("fp"), F.lit(0))))
    recall = zero(safe_div(F.col("tp"), F.nullif(F.col("tp") + F.col("fn"), F.lit(0))))
    f1 = zero(safe_div(2 * F.col("tp"), F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))))
    return c.select("tn", "fp", "fn", "tp", round_dec(precision, 6).alias("precision"),
                    round_dec(recall, 6).alias("recall"), round_dec(f1, 6).alias("f1"))


def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    d = F.col(score) - F.col(label).cast("double")
    return df.agg(round_dec(F.avg(d * d), 8).alias("brier_score"))


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    i = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("bigint")
    return df.groupBy(i.alias("bin")).agg(
        F.count("*").alias("n"), round_dec(F.avg(score), 6).alias("mean_predicted"),
        round_dec(F.avg(F.col(label).cast("double")), 6).alias("fraction_positive"))


def precision_at_k(df: DataFrame, label: str, score: str, key: str, k: int = 100) -> DataFrame:
    """Share of positives among the ``k`` best scores; the denominator is ``k`` itself.

    The top rows are found per task and merged, so no full sort happens.
    """
    top = df.orderBy(F.desc(score), F.asc(key)).limit(k)
    return top.agg((F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)) / k).alias("precision_at_k"),
                   F.lit(k).cast("bigint").alias("k"))


def evaluate(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> dict[str, float]:
    """All metrics of one scored table as numbers."""
    out = ranking_metrics(df, label, score).first().asDict()
    out |= threshold_metrics(df, label, score, threshold).first().asDict()
    out |= brier(df, label, score).first().asDict()
    return out | {"threshold": threshold}


# ---- tiers and scores ------------------------------------------------------------------------


def relative_tier(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, "high").when(p >= threshold * 0.6, "medium").otherwise("low")


def fixed_tier(p: Column, cuts: Sequence[float] = (0.2, 0.5, 0.8), right_closed: bool = False) -> Column:
    """low, medium, high or critical. Cuts belong to the upper tier, or to the lower if right-closed."""
    names = ("low", "medium", "high", "critical")
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        out = F.when(p <= cut if right_closed else p < cut, name).otherwise(out)
    return out


def score_table(scored: DataFrame, threshold: float = 0.5, key: str = "member_id") -> DataFrame:
    p = F.col("churn_probability")
    return scored.select(key, round_dec(p, 6).alias("churn_probability"), relative_tier(p, threshold).alias("risk_tier"))


def latest_scores(predictions: DataFrame, key: str = "member_id") -> DataFrame:
    """Newest row per member of an append-only prediction table."""
    rest = [c for c in predictions.columns if c != key]
    return predictions.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("predicted_at", "churn_probability")).alias("_p")) \
        .select(key, "_p.*")


# ---- models ----------------------------------------------------------------------------------


def class_weight(df: DataFrame, label: str) -> DataFrame:
    pos = F.count_if(F.col(label).cast("int") == 1)
    return df.agg(F.count_if(F.col(label).cast("int") == 0).alias("n_neg"), pos.alias("n_pos"),
                  round_dec(F.count_if(F.col(label).cast("int") == 0) / F.greatest(pos, F.lit(1)), 6).alias("scale_pos_weight"))


def check_training_input(train: DataFrame, val: DataFrame, label: str) -> float:
    """Fail on empty tables or a single class; returns the weight of a positive row."""
    t = class_weight(train, label).first()
    if t["n_neg"] + t["n_pos"] == 0 or val.isEmpty():
        raise DataError("the training or validation table is empty")
    if not t["n_neg"] or not t["n_pos"]:
        raise DataError("training labels hold one class only")
    return float(t["scale_pos_weight"])


@dataclass
class ChurnModel:
    gbt: GBTClassificationModel
    features: list[str]

    def predict(self, df: DataFrame, out: str = "churn_probability") -> DataFrame:
        """Add the churn probability; missing inputs must have been filled."""
        rows = VectorAssembler(inputCols=self.features, outputCol="_x", handleInvalid="error").transform(df)
        scored = self.gbt.transform(rows)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))

    def importance(self) -> DataFrame:
        from pyspark.sql import SparkSession

        rows = [(f, float(w)) for f, w in zip(self.features, self.gbt.featureImportances.toArray())]
        return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def train(train_df: DataFrame, val_df: DataFrame, features: Sequence[str], label: str, max_depth: int = 6,
          step: float = 0.05, rounds: int = 500, subsample: float = 0.8, columns: str = "0.8", seed: int = 42,
          stop_tol: float = 0.001) -> ChurnModel:
    """Gradient-boosted trees with class weights and early stopping on the validation rows.

    Stopping is on log loss, and columns are sampled per node; Spark's trees offer no stop on the
    precision-recall area and no sampling per tree.
    """
    weight = check_training_input(train_df, val_df, label)
    both = train_df.withColumn("_val", F.lit(False)).unionByName(val_df.withColumn("_val", F.lit(True)))
    y = F.col(label).cast("double")
    rows = both.select(*features, y.alias("_y"), F.when(y == 1, weight).otherwise(1.0).alias("_w"), "_val")
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows).select("_x", "_y", "_w", "_val").persist()
    try:
        gbt = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", validationIndicatorCol="_val", maxDepth=max_depth,
                            stepSize=step, maxIter=rounds, subsamplingRate=subsample, featureSubsetStrategy=columns,
                            validationTol=stop_tol, seed=seed)
        return ChurnModel(gbt.fit(rows), list(features))
    finally:
        rows.unpersist()


def train_per_segment(train_df: DataFrame, val_df: DataFrame, features: Sequence[str], label: str, segment: str,
                      values: Sequence[str], **params) -> dict[str, ChurnModel]:
    """One model per listed segment value."""
    return {v: train(train_df.filter(F.col(segment) == v), val_df.filter(F.col(segment) == v), features, label, **params)
            for v in values}


def risk_factors(model: ChurnModel, df: DataFrame, baseline: dict[str, float], key: str = "member_id", top: int = 5) -> DataFrame:
    """Features whose replacement by a baseline value changes a member's score most.

    The variants are further columns of the same row, so members are neither repeated nor
    shuffled; the strongest ``top`` come from an array with one entry per feature.
    """
    feats = model.features
    rows = df.select(key, *[F.col(f).cast("double").alias(f) for f in feats])
    for i, replaced in enumerate([None, *feats]):
        cols = [f"_b_{f}" if f == replaced else f for f in feats]
        if replaced is not None:
            rows = rows.withColumn(f"_b_{replaced}", F.lit(float(baseline[replaced])))
        rows = VectorAssembler(inputCols=cols, outputCol="_x").transform(rows)
        scorer = model.gbt.copy()
        scorer.setFeaturesCol("_x").setRawPredictionCol("").setPredictionCol("")
        scorer.setProbabilityCol("_prob")
        rows = scorer.transform(rows).withColumn(f"_p{i}", vector_to_array("_prob")[1]).drop("_x", "_prob")
    impacts = [F.col("_p0") - F.col(f"_p{i + 1}") for i in range(len(feats))]
    entries = F.array(*[F.struct((-F.abs(d)).alias("o"), F.lit(f).alias("feature"), d.alias("impact")) for f, d in zip(feats, impacts)])
    best = F.slice(F.array_sort(entries), 1, top)
    return rows.select(key, F.col("_p0").alias("churn_probability"), F.posexplode(best).alias("_i", "_e")).select(
        key, "churn_probability", (F.col("_i") + 1).cast("bigint").alias("rank"), "_e.feature", "_e.impact")
