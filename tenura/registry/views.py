"""The driver's generic tables, mapped to the tables of the retention domain.

The same text runs on Spark and, as common table expressions, in the SQL checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF = "2001-08-02 00:00:00"
BASE = ("region nation customer supplier part orders lineitem events documents embeddings "
        "pages benchmark labels conversations").split()

VIEWS = {
    "locations": """
SELECT n.n_nationkey AS location_id, r.r_name AS region, (n.n_nationkey % 5 < 3) AS is_urban,
       300 + 20 * n.n_nationkey AS capacity
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "members": """
SELECT c.c_custkey AS member_id, c.c_nationkey AS location_id, o.first_order AS join_date,
       CASE WHEN o.last_order < TIMESTAMP '2000-11-01 00:00:00' THEN o.last_order END AS cancel_date,
       (o.last_order < TIMESTAMP '2000-11-01 00:00:00') AS churned,
       CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'aggregator' ELSE 'regular' END AS contract_source,
       CASE WHEN c.c_mktsegment <> 'HOUSEHOLD' THEN NULL WHEN c.c_custkey % 3 = 0 THEN 'gympass'
            WHEN c.c_custkey % 3 = 1 THEN 'totalpass' ELSE 'wellhub' END AS aggregator_platform,
       CASE c.c_mktsegment WHEN 'HOUSEHOLD' THEN 'aggregator_standard' WHEN 'BUILDING' THEN 'basic'
            WHEN 'FURNITURE' THEN 'premium' ELSE 'standard' END AS plan_type,
       CASE WHEN c.c_acctbal >= -950 THEN 30 + CAST(FLOOR(ABS(c.c_acctbal)) AS DOUBLE) / 64 END AS monthly_price,
       18 + c.c_custkey % 58 AS age,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, c.c_name AS name
FROM customer c JOIN (SELECT o_custkey, MIN(o_orderdate) AS first_order, MAX(o_orderdate) AS last_order
                      FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey""",
    "visits": """
SELECT o.o_custkey AS member_id, c.c_nationkey AS location_id, l.l_shipdate AS visit_date,
       CAST(l.l_quantity * 7 - 3 AS INT) AS visit_duration_minutes
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""",
    "actions": """
SELECT o.o_custkey AS member_id, c.c_nationkey AS location_id, o.o_orderdate AS action_date,
       o.o_orderkey AS action_id,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'phone_call' WHEN '2-HIGH' THEN 'discount_offer'
            WHEN '3-MEDIUM' THEN 'sms_reengagement' WHEN '5-LOW' THEN 'pt_session' ELSE 'plan_upgrade' END AS action_type,
       CAST(CASE o.o_orderpriority WHEN '1-URGENT' THEN 15 WHEN '2-HIGH' THEN 50
            WHEN '3-MEDIUM' THEN 2.5 WHEN '5-LOW' THEN 80 ELSE 20 END AS DOUBLE) AS cost
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P' AND o.o_orderkey % 5 = 0""",
    "transactions": """
SELECT o_custkey AS member_id, o_orderdate AS txn_date, o_totalprice AS amount,
       (o_orderpriority = '5-LOW') AS is_late FROM orders""",
    "scored": """
SELECT c_custkey AS member_id, ((c_custkey * 7919) % 1000) / CAST(1000 AS DOUBLE) AS churn_probability
FROM customer""",
    "cate": """
SELECT c_custkey AS member_id, action, ((c_custkey * 31 + k * 17) % 150) / CAST(1000 AS DOUBLE) AS cate_mean,
       (5 + (c_custkey * 13 + k * 7) % 36) / CAST(1000 AS DOUBLE) AS cate_std
FROM (SELECT c_custkey, a.action, a.k FROM customer
      JOIN (SELECT 'sms_reengagement' AS action, 1 AS k UNION ALL SELECT 'phone_call', 2
            UNION ALL SELECT 'discount_offer', 3 UNION ALL SELECT 'pt_session', 4) a ON a.k > 0) x""",
}


def oracle(body: str, *ctes: str) -> str:
    """One SQL statement: the mapped views, further expressions, and the query."""
    parts = [f"{name} AS ({text})" for name, text in VIEWS.items()]
    parts += [c.strip().rstrip(",") for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


class Tables:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = {}
        for b in BASE:
            for lead in ("FROM ", "JOIN "):
                if f"{lead}{b}" in text:
                    text = text.replace(f"{lead}{b}", f"{lead}{{{b}}}")
                    used[b] = self.base(b)
        return self.spark.sql(text, **used)

    locations = cached_property(lambda self: self.view("locations"))
    members = cached_property(lambda self: self.view("members"))
    visits = cached_property(lambda self: self.view("visits"))
    actions = cached_property(lambda self: self.view("actions"))
    transactions = cached_property(lambda self: self.view("transactions"))
    scored = cached_property(lambda self: self.view("scored"))

    @cached_property
    def cate(self) -> DataFrame:
        """The same rows as the SQL view, unfolded from a constant array."""
        names = ("sms_reengagement", "phone_call", "discount_offer", "pt_session")
        acts = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(k).alias("k")) for k, a in enumerate(names, 1)])
        c, k = F.col("c_custkey"), F.col("k")
        return self.base("customer").select("c_custkey", F.inline(acts)).select(
            c.alias("member_id"), "action", ((c * 31 + k * 17) % 150 / F.lit(1000.0)).alias("cate_mean"),
            ((5 + (c * 13 + k * 7) % 36) / F.lit(1000.0)).alias("cate_std"))
