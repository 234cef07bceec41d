"""The table pipeline: raw tables to gated silver tables to gold tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tenura.config import MemberRules
from tenura.operators import clean, gold, quality
from tenura.sources import catalog


@dataclass
class Silver:
    members: DataFrame
    visits: DataFrame
    actions: DataFrame


@dataclass
class Gold:
    member_360: DataFrame
    locations: DataFrame
    cohorts: DataFrame
    activity: DataFrame


def build_silver(members: DataFrame, visits: DataFrame, actions: DataFrame, order_by: Sequence[str], rules: MemberRules = MemberRules(),
                 gate: bool = True) -> Silver:
    """Clean the three raw tables; with ``gate`` failed null limits and silver checks stop the run."""
    out = Silver(clean.clean_members(members, order_by, rules, gate), clean.clean_visits(visits, rules), clean.clean_actions(actions))
    if gate:
        quality.require(quality.silver_members(out.members, rules.contract_sources),
                        quality.silver_visits(out.visits, rules.min_minutes, rules.max_minutes),
                        quality.orphan_rows(out.visits, out.members, "member_id", "visits"))
    return out


def build_gold(silver: Silver, ref, min_cohort: int = 50) -> Gold:
    """Lazy gold tables; nothing runs until they are written or read."""
    wide = gold.member_360(silver.members, silver.visits, silver.actions, ref)
    return Gold(wide, gold.location_kpis(wide), gold.cohort_retention(silver.members, ref, min_cohort), gold.location_activity(silver.visits))


def run(members: DataFrame, visits: DataFrame, actions: DataFrame, order_by: Sequence[str], ref, root: str,
        rules: MemberRules = MemberRules(), gate: bool = True) -> dict[str, str]:
    """Write silver and gold under ``root``. Gold reads the written silver, so raw data is read once.

    Location KPIs are read from the written member view for the same reason.
    """
    spark = members.sparkSession
    silver = build_silver(members, visits, actions, order_by, rules, gate=False)
    paths = {n: f"{root}/{n}" for n in ("silver/members", "silver/visits", "silver/actions", "gold/member_360", "gold/locations",
                                        "gold/cohorts", "gold/activity")}
    for name in ("members", "visits", "actions"):
        catalog.write_layer(getattr(silver, name), paths[f"silver/{name}"])
    kept = Silver(*[spark.read.parquet(paths[f"silver/{n}"]) for n in ("members", "visits", "actions")])
    if gate:
        clean.enforce_null_limits(kept.members, rules.null_limits)
        quality.require(quality.silver_members(kept.members, rules.contract_sources),
                        quality.silver_visits(kept.visits, rules.min_minutes, rules.max_minutes),
                        quality.orphan_rows(kept.visits, kept.members, "member_id", "visits"))
    out = build_gold(kept, ref)
    catalog.write_layer(out.member_360, paths["gold/member_360"])
    wide = spark.read.parquet(paths["gold/member_360"])
    catalog.write_layer(gold.location_kpis(wide), paths["gold/locations"])
    catalog.write_layer(out.cohorts, paths["gold/cohorts"])
    catalog.write_layer(out.activity, paths["gold/activity"], partition_by=["grain"])
    if gate:
        quality.require(quality.gold_member_360(wide), quality.gold_locations(spark.read.parquet(paths["gold/locations"])))
    return paths
