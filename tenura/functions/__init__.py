"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def round_dec(col: Column, digits: int) -> Column:
    """Half-up rounding through a decimal, so a tie does not depend on binary noise."""
    return F.round(col.cast("decimal(28,8)"), digits).cast("double")


def as_ts(value) -> Column:
    """A timestamp column from a column, a column name is not accepted, or an ISO string."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp_ntz")


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def days_between(end, start) -> Column:
    """Whole days from ``start`` to ``end``, rounded towards minus infinity."""
    return F.floor((micros(as_ts(end)) - micros(as_ts(start))) / F.lit(MICROS_PER_DAY)).cast("bigint")


def minus_days(ts, days: int) -> Column:
    return as_ts(ts) - F.expr(f"interval {days} days")


def n_if(cond: Column) -> Column:
    return F.count_if(cond)


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it is false or null."""
    return F.coalesce(cond, F.lit(False)).cast("bigint")


def safe_div(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def hash_unit(*cols, seed: int) -> Column:
    """A uniform value in (0, 1) that depends only on the key columns and the seed: 52 bits of the MD5 of their texts, joined by ``|``.

    Unlike ``rand`` it gives the same row the same value after a repartition or a lost task, and any engine can repeat it.
    """
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    digits = F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def hash_normal(*cols, seed: int) -> Column:
    """A standard normal value per key by the Box-Muller formula."""
    u1 = hash_unit(*cols, seed=seed)
    u2 = hash_unit(*cols, seed=seed + 7_919)
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)
