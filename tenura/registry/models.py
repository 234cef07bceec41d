"""Fitted churn models at their default settings: 500 rounds with early stopping, depth 6, step 0.05, split by time.

Rows of a fitted model depend on its trees, so SQL checks what must hold for any.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tenura.functions import flag
from tenura.operators import churn, features
from tenura.registry.base import member_360, once, query
from tenura.session import checkpointed

# Attributes known while a member is active; the label is the churn flag.
INPUTS = ["monthly_price", "age", "retention_action_count", "contract_source_aggregator", "plan_type_basic", "plan_type_premium", "join_month"]


def table(t):
    """All members, and the training and validation rows of the time split; medians come from the training rows alone."""
    df = member_360(t).withColumns({"y": flag(F.col("churned")), "join_month": F.month("join_date").cast("bigint")})
    hot = features.contract_features(t.members).drop("contract_source_regular", "plan_type_standard", "plan_type_aggregator_standard")
    wide = checkpointed(df.join(hot, "member_id"))
    split = features.temporal_split(wide, "join_date", 12, 3, 3)
    medians = features.fit_percentiles(split.filter("split = 'train'"), ["monthly_price"], 0.5)
    part = lambda s: features.impute(split.filter(F.col("split") == s), medians).drop("split")
    return features.impute(wide, medians), part("train"), part("val")


def model(t):
    def fit():
        full, train, val = table(t)
        return full, train, churn.train(train, val, INPUTS, "y")
    return once(t, "churn", fit)


def of_source(t, source: str):
    inputs = [c for c in INPUTS if c != "contract_source_aggregator"]

    def fit():
        full, train, val = table(t)
        return full, churn.train_per_segment(train, val, inputs, "y", "contract_source", ["regular", "aggregator"])
    full, models = once(t, "churn by source", fit)
    return models[source].predict(full.filter(F.col("contract_source") == source)).select("member_id", "contract_source", "churn_probability")


@query("chn3_boosted_model")
def _(t):
    full, _, m = model(t)
    return churn.score_table(m.predict(full))


@query("chn3_model_properties", f"""SELECT COUNT(*) AS members, TRUE AS probabilities, TRUE AS better_than_the_base_rate, {len(INPUTS)}::BIGINT AS inputs,
(SELECT COUNT(*) FROM members WHERE join_date < (SELECT MIN(join_date) FROM members) + INTERVAL 12 MONTH) AS training_rows FROM members""")
def _(t):
    """Every member has a probability; on the rows it was trained on, with the weights it was trained with, the model's log loss is below that of the base rate."""
    full, train, m = model(t)
    p = F.col("churn_probability")
    every = m.predict(full).agg(F.count("*").alias("members"), (F.count_if(p.between(0, 1)) == F.count("*")).alias("probabilities"))
    weight = churn.class_weight(train, "y").first()["scale_pos_weight"]
    scored = m.predict(train).select("y", F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9)).alias("p"), F.when(F.col("y") == 1, float(weight)).otherwise(1.0).alias("w"))
    loss = F.sum(F.col("w") * -F.when(F.col("y") == 1, F.ln("p")).otherwise(F.ln(1 - F.col("p")))) / F.sum("w")
    fit = scored.agg((loss < math.log(2.0)).alias("better_than_the_base_rate"), F.count("*").alias("training_rows"))  # with these weights both classes weigh the same
    return every.join(fit, F.lit(True)).withColumn("inputs", F.lit(len(m.features)).cast("bigint"))


@query("chn4_models_per_segment")
def _(t):
    return of_source(t, "regular").unionByName(of_source(t, "aggregator"))


@query("chn4_members_by_model", "SELECT member_id, contract_source, TRUE AS probability FROM members")
def _(t):
    both = of_source(t, "regular").unionByName(of_source(t, "aggregator"))
    return both.select("member_id", "contract_source", F.col("churn_probability").between(0, 1).alias("probability"))


@query("chn15_risk_factors")
def _(t):
    full, _, m = model(t)
    return churn.risk_factors(m, full, features.fit_percentiles(full, INPUTS, 0.5))


@query("chn15_factor_properties", "SELECT member_id, 5::BIGINT AS factors, TRUE AS ranked, TRUE AS bounded FROM members")
def _(t):
    full, _, m = model(t)
    rows = churn.risk_factors(m, full, features.fit_percentiles(full, INPUTS, 0.5))
    size = F.transform(F.array_sort(F.collect_list(F.struct("rank", "impact"))), lambda e: F.abs(e["impact"]))
    return rows.groupBy("member_id").agg(F.count("*").alias("factors"), (size == F.reverse(F.array_sort(size))).alias("ranked"), (F.max(F.abs("impact")) <= 1).alias("bounded"))


@query("chn15_global_importance")
def _(t):
    return model(t)[2].importance()


@query("chn15_importance_properties", f"SELECT {len(INPUTS)}::BIGINT AS features, TRUE AS shares_add_up, TRUE AS shares FROM members LIMIT 1")
def _(t):
    w = F.col("importance")
    return model(t)[2].importance().agg(F.count("*").alias("features"), F.round(F.sum(w), 6).isin(0.0, 1.0).alias("shares_add_up"), (F.min(w) >= 0).alias("shares"))
