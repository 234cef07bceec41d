"""From the member view to churn scores and an allocation input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.operators import churn, features


def train_and_score(table: DataFrame, inputs: Sequence[str], label: str, date_col: str, train: int = 12, val: int = 3, test: int = 3,
                    **params) -> tuple[DataFrame, dict[str, float], churn.ChurnModel]:
    """Split by time, fill medians fitted on the training rows, fit, pick the threshold, score and evaluate.

    Returns scored members with tiers, the test metrics and the model.
    """
    split = features.temporal_split(table, date_col, train, val, test)
    medians = features.fit_percentiles(split.filter("split = 'train'"), inputs, 0.5)
    filled = features.impute(split, {c: (0.0 if v is None else v) for c, v in medians.items()})
    part = {s: filled.filter(F.col("split") == s) for s in ("train", "val", "test")}
    model = churn.train(part["train"], part["val"], inputs, label, **params)
    threshold = churn.threshold_value(model.predict(part["val"]), label, "churn_probability")
    metrics = churn.evaluate(model.predict(part["test"]), label, "churn_probability", threshold)
    return churn.score_table(model.predict(filled), threshold), metrics, model
