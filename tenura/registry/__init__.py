"""Queries over the mapped tables, one module per area."""

AREAS = ["tables", "gold_layer", "feature_layer", "exploration", "scores", "models", "texts", "survival_ltv", "effects", "refutation", "allocation"]
