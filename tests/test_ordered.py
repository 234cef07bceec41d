import hashlib
import random
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.functions import ordered
from tenura.functions.ordered import exact_percentiles, prefix_sums


@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_running_totals_with_a_hot_key_and_heavy_ties(spark, ranges):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(4)}", i, rng.choice([1.0, 1.0, 1.0, rng.random(), 7.5]), rng.randrange(1, 9))
            for i in range(600)]
    df = spark.createDataFrame(rows, "k string, id long, x double, n long")
    got = {r["id"]: (r["cum_n"], r["total_n"]) for r in prefix_sums(df, -F.col("x"), ["n"], ["k"], tie=["id"], ranges=ranges).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], hashlib.md5(str(r[1]).encode()).hexdigest(), r[1]))
        for r, c in zip(part, accumulate(p[3] for p in part)):
            assert got[r[1]] == (c, sum(p[3] for p in part))


def test_running_totals_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 5)], "k string, x double, n long")
    got = {(r["k"], r["x"]): r["cum_n"] for r in prefix_sums(df, F.col("x"), ["n"], ["k"]).collect()}
    assert got == {(None, 1.0): 2, (None, 2.0): 5, ("a", 1.0): 5}


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=257), "b": np.array([4.0]), "c": np.repeat([1.0, 2.0], [5, 90])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in exact_percentiles(df, "v", probs, ["k"]).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r["k"]], p), abs=1e-12)


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert exact_percentiles(df, "v", {"m": 0.5}, ["k"]).count() == 0


def test_no_task_gets_a_hot_key_or_a_hot_value(spark):
    """A third of the rows share one key, and a third of those share one value."""
    n = 30_000
    i = F.col("id")
    df = spark.range(n).select(F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (i % 50).cast("string"))).alias("k"), "id",
                               F.when(i % 9 == 0, 5.0).otherwise(F.xxhash64("id") % 1000 / 100.0).alias("x"))
    valued = df.withColumn("_v", F.col("x"))
    ranged = ordered._with_range(valued, ordered.range_edges(valued, "_v", 64), ["id"])
    largest = ranged.groupBy("k", "_r", "_s").count().agg(F.max("count")).first()[0]
    assert largest < 0.02 * n
