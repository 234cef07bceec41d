"""Running totals and exact percentiles that never put a whole group into one task.

A plain ``sum() over (partition by key order by x)`` sends every row of a key to one task.
Here the value axis is first cut into ranges of about equal row counts. Totals per range are
small, their running totals give an offset per range, and only the rows of one range of one
key meet in one task. A value that is heavy by itself becomes a range of its own and is cut
further by a hash of the tie-breaking columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tenura.session import checkpointed

RANGES = 256


def range_edges(df: DataFrame, col: str, ranges: int = RANGES) -> list[float]:
    """At most ``ranges - 1`` cut points of a numeric column (one small job, bounded result).

    They only balance the work; results do not depend on them.
    """
    probs = [i / ranges for i in range(1, ranges)]
    row = df.agg(F.percentile_approx(F.col(col), probs, 10 * ranges).alias("e")).first()
    return sorted({float(e) for e in (row["e"] or [])})


def _with_range(df: DataFrame, edges: list[float], tie: Sequence[str]) -> DataFrame:
    if not edges:
        df = df.withColumn("_i", F.lit(0.0))
    else:
        splits = [float("-inf"), *edges, float("inf")]
        df = Bucketizer(splits=splits, inputCol="_v", outputCol="_i", handleInvalid="error").transform(df)
    idx = F.col("_i").cast("int")
    at_edge = F.lit(False) if not edges else F.coalesce(
        F.get(F.lit(edges), idx - 1) == F.col("_v"), F.lit(False))
    df = df.withColumn("_r", idx * 2 + F.when(at_edge, 0).otherwise(1))
    if tie:
        df = df.withColumn("_t", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in tie])))
        return df.withColumn("_s", F.when(at_edge, F.substring("_t", 1, 2)).otherwise(F.lit("")))
    return df.withColumn("_t", F.lit("")).withColumn("_s", F.lit(""))


def prefix_sums(
    df: DataFrame,
    order: Column,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    tie: Sequence[str] = (),
    ranges: int = RANGES,
    null_keys: bool = True,
) -> DataFrame:
    """Add ``cum_<c>`` (running total up to and including the row) and ``total_<c>`` per key.

    Rows are ordered by ``order``, then by the MD5 of the ``tie`` columns, then by the columns.
    Without ``tie`` the order value must be unique within a key. Without keys the offsets number
    at most ``2 * ranges * 256`` rows and are broadcast; with keys the optimizer decides. Where
    keys are never null, ``null_keys=False`` lets the join and the window share one shuffle.
    """
    keys, sums, tie = list(keys), list(sums), list(tie)
    valued = df.withColumn("_v", order.cast("double"))
    edges = range_edges(valued, "_v", ranges)
    ranged = _with_range(valued, edges, tie)
    totals = ranged.groupBy(*keys, "_r", "_s").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_r", "_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_r").alias("_r2"), F.col("_s").alias("_s2"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    cond = [F.col("_r") == F.col("_r2"), F.col("_s") == F.col("_s2")]
    cond += [F.col(k).eqNullSafe(F.col(f"_k_{k}")) if null_keys else F.col(k) == F.col(f"_k_{k}") for k in keys]
    if not keys:
        offsets = F.broadcast(offsets)
    within = (Window.partitionBy(*keys, "_r", "_s").orderBy("_v", "_t", *tie)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = ranged.join(offsets, cond, "inner")
    out = joined.withColumns({f"cum_{c}": F.col(f"_off_{c}") + F.sum(c).over(within) for c in sums})
    return out.drop("_v", "_i", "_r", "_t", "_s", "_r2", "_s2",
                    *[f"_k_{k}" for k in keys], *[f"_off_{c}" for c in sums])


def exact_percentiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (),
) -> DataFrame:
    """Exact percentiles with linear interpolation, one output column per entry of ``probs``.

    Values are collapsed to counts before any row moves, and the ranks come from
    :func:`prefix_sums`; memory per task does not grow with the group as in ``percentile``.
    """
    return count_percentiles(value_counts(df, value, keys), probs, list(keys))


def percentile_rows(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()) -> list[Row]:
    """The same as rows on the driver, for few keys. The input is computed once: its value counts
    are kept while the range edges and the ranks are found."""
    counts = value_counts(df, value, keys).persist()
    try:
        return count_percentiles(counts, probs, list(keys)).collect()
    finally:
        counts.unpersist()


def value_counts(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return (df.filter(F.col(value).isNotNull())
            .groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("n")))


def count_percentiles(counts: DataFrame, probs: dict[str, float], keys: list[str]) -> DataFrame:
    """Exact percentiles of values given as (keys, _x, n): a value and how often it occurs."""
    ranked = prefix_sums(counts, F.col("_x"), ["n"], keys)
    first_rank = F.col("cum_n") - F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first_rank <= rank) & (rank < F.col("cum_n")), F.col("_x")))

    aggs, outs = [], []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("total_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * F.col(f"_f_{name}")).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def ranked_values(values: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values of any sortable type with ``rank`` from 0 in sorted order.

    Values are dealt to ranges and ranked inside them; the sizes of earlier ranges are added. Where the ranges are cut depends on
    a sample, so the cut is written before it is used; ranks do not depend on it.
    """
    distinct = values.select(col).where(F.col(col).isNotNull()).distinct()
    ranged = checkpointed(distinct.repartitionByRange(col).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(col)) - 1
    return ranged.join(F.broadcast(before), "_p").select(col, (F.col("_before") + inside).cast("bigint").alias("rank"))
