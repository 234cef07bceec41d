"""Whitened embeddings: equal vectors counted once, a weighted covariance from centred matrix products, projections joined back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_value, saved

by_value(__name__)

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Vectors with an entry at or beyond this are left out: their numbers would not be exact any more.
LARGEST = float(1 << 40)
#: Dimensions at most: the covariance and its eigenvectors are worked out on the driver.
DIMENSIONS = 8192
#: Distinct vectors that a task multiplies at a time.
ROWS = 4096
#: Eigenvalues below this share of the largest count as zero and give no component.
RANK = 1e-12


@dataclass
class Whitening:
    """n and the per-dimension sums of the fit list, the covariance's trace, its leading eigenvalues and unit eigenvectors (rows)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """(id, x): integer vectors as little-endian 64-bit numbers; see ``whiten`` for the rows that are left out."""
    given = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    good = given.where(F.coalesce(ok, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                v = b.column("v")
                flat = v.flatten().to_numpy(zero_copy_only=False)
                x = (np.floor(SCALE * flat) + SHIFT).astype("<i8")
                ends = np.cumsum(np.asarray(pc.list_value_length(v)))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in np.split(x, ends[:-1])], pa.binary())], ["id", "x"])

    out = saved(good.mapInArrow(run, "id bigint, x binary"), "vectors")
    if dim is None:
        sizes = out.groupBy((F.octet_length("x") / 8).cast("int").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).head()
        dim = sizes["dim"] if sizes else 0
    return out.where(F.octet_length("x") == 8 * dim)


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), -1) if raw else np.empty((0, 0), np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def fit_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension, over distinct vectors x with their weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for b in _pieces(batches):
            if not b.num_rows:
                continue
            x, w = _matrix(b.column("x")), b.column("weight").to_numpy()
            exact = int(np.abs(x).max()) * int(w.sum()) < 1 << 62
            part = w @ x if exact else w.astype(object) @ x.astype(object)
            n, s = n + int(w.sum()), [int(p) for p in part] if s is None else [p + int(q) for p, q in zip(s, part)]
        if s is not None:
            cells = [n, *s]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(s)), pa.int64()), pa.array([str(c) for c in cells])], ["cell", "total"])

    parts = distinct.mapInArrow(run, "cell bigint, total string")
    rows = parts.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("cell").limit(DIMENSIONS + 2).collect()
    return (int(rows[0]["total"]), [int(r["total"]) for r in rows[1:]]) if rows else (0, [])


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with the whole part of the mean taken off in integers, so that nothing is lost to large numbers."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([float(s - n * int(m)) / n for s, m in zip(sums, whole)])
    return (x - whole) - rest


def covariance(table: DataFrame, column: str, n: int, dim: int, rows_of) -> np.ndarray:
    """Sum of weight * r' r over the rows r that ``rows_of`` makes of a batch of ``column`` (already centred), divided by n.

    A task adds up its products in one matrix and gives it out row by row; rows of all tasks are summed in Spark, so the driver gets dim rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((dim, dim)), False
        for b in _pieces(batches):
            if b.num_rows:
                r = rows_of(b.column(column))
                total += (r * b.column("weight").to_numpy()[:, None].astype(float)).T @ r
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([t.tobytes() for t in total], pa.binary())], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column("i").to_pylist(), b.column("row").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(row)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([r.tobytes() for r in sums.values()], pa.binary())], ["i", "row"])

    parts = table.select(column, "weight").mapInArrow(run, "i bigint, row binary").repartition("i").mapInArrow(add, "i bigint, row binary")
    out = np.zeros((dim, dim))
    for r in parts.toLocalIterator():
        out[r["i"]] = np.frombuffer(r["row"])
    return (out + out.T) / (2 * n)


def fit(distinct: DataFrame, components: int = 8) -> Whitening | None:
    """Whitening from (x, weight) rows, one for each distinct vector; None without any."""
    n, sums = fit_sums(distinct)
    if not n:
        return None
    dim = len(sums)
    if dim > DIMENSIONS:
        raise ValueError(f"{dim} dimensions; a covariance of more than {DIMENSIONS} does not fit one machine")
    v = covariance(distinct, "x", n, dim, lambda c: centred(_matrix(c), n, sums))
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > RANK * max(float(e.max()), 0.0)][:components]
    return Whitening(n, sums, float(np.trace(v)), e[order], u[:, order].T)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exact: with y = x - m, m the mean's whole part and R = S - n * m,
    n^2 * sum(y^2) - 2 * n * sum(y * R) + sum(R^2), and only small numbers are multiplied in 64 bits."""
    whole = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, whole)]
    y = x - np.array(whole, np.int64)
    if float(np.abs(y).max(initial=0)) ** 2 * len(sums) >= 2.0**62 or float(np.abs(y).max(initial=0)) * n * len(sums) >= 2.0**62:
        y = y.astype(object)
    r = np.array(rest, y.dtype)
    const = sum(q * q for q in rest)
    return [n * n * int(a) - 2 * n * int(b) + const for a, b in zip((y * y).sum(1), (y * r).sum(1))]


def project(distinct: DataFrame, model: Whitening) -> DataFrame:
    """(x, weight, deviation, z): each distinct vector whitened once; ``z`` has one entry for each component."""
    n, sums = model.n, model.sums
    turn = (model.vectors / np.sqrt(model.values)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            if b.num_rows:
                x = _matrix(b.column("x"))
                z = centred(x, n, sums) @ turn
                yield pa.RecordBatch.from_arrays(
                    [b.column("x"), b.column("weight"), pa.array([str(d) for d in deviations(x, n, sums)]), pa.array(list(z), pa.list_(pa.float64()))],
                    ["x", "weight", "deviation", "z"],
                )

    return distinct.mapInArrow(run, "x binary, weight bigint, deviation string, z array<double>")


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the fit list."""
    k = len(model.values)
    if not k:
        return 0.0
    n = model.n
    rows = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    mean = np.array([r or 0.0 for r in projected.select([F.sum(F.col("z")[i] * F.col("weight")) / n for i in range(k)]).head()])
    return float(np.abs(covariance(projected, "z", n, k, lambda c: rows(c) - mean) - np.eye(k)).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, weights: str = "count", dim: int | None = None) -> DataFrame:
    """One row per remaining row of ``table`` and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(1024 * c) + 100000. Rows go whose vector is null or empty, holds a null, NaN, infinite or
    huge entry (2^40 and more, where x is not exact any more), or has another length than ``dim`` (if None: the commonest
    length, the longer one on a tie). The fit list has every remaining row (``weights="count"``) or every distinct vector
    once (``"one"``); n is its size and S its sums. ``deviation`` is the exact sum of (n * x - S)^2 as decimal(38, 0). Rows
    with a null id and rows that repeat an id stay. Other columns are not read, so they may have any name. Components whose
    eigenvalue is zero (below 10^-12 of the largest) do not come out: a table of one distinct vector, like an empty one, gives
    no rows.

    Vectors are grouped with partial counts where they are read, and everything dear is done once for each distinct vector. The
    join back is a plain hash join on a digest, which adaptive execution splits where one vector has many rows.
    """
    if weights not in ("count", "one"):
        raise ValueError("weights is 'count' or 'one'")
    rows = vectors(table, id_col, vector_col, dim)
    weight = F.count(F.lit(1)) if weights == "count" else F.lit(1).cast("bigint")
    distinct = saved(rows.groupBy("x").agg(weight.alias("weight")), "distinct")
    schema = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(distinct, components)
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], f"{id_col} bigint, {schema}")
    done = saved(project(distinct, model), "whitened")
    error = identity_error(done, model)
    once = done.select(F.sha2("x", 256).alias("key"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "z")
    back = rows.select("id", F.sha2("x", 256).alias("key")).join(once, "key")
    each = back.select(F.col("id").alias(id_col), "deviation", F.posexplode("z").alias("at", "whitened"))
    share = F.array([F.lit(x) for x in model.explained])
    return each.select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error")
    )
