"""Most similar vectors by cosine: exact in blocks, or through an index of hyperplane buckets.

Both ways are one: rows carry a bucket, queries the buckets they look into, and the two meet in groups of bounded size. Without an
index there is one bucket. Neither side passes through the driver, and no pair of vectors becomes a row: a group gives
out the k best of each of its queries.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenura.errors import DataError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

#: Vector entries of each side that meet in one task, about.
VALUES = 2_000_000


@dataclass(frozen=True)
class Hyperplanes:
    """Tables of buckets: a bit tells on which side of a random plane through the origin a vector lies.

    A query looks into the ``probes`` buckets of each table that are reached by crossing the planes nearest to it. More probes raise the share of
    true neighbours found, and the work. The planes follow from the seed.
    """

    tables: int = 4
    bits: int = 10
    probes: int = 200
    seed: int = 42

    def planes(self, dim: int) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(size=(dim, self.tables * self.bits))

    def sides(self, x: np.ndarray) -> np.ndarray:
        """Signed distances (row, table, bit)."""
        return (x @ self.planes(x.shape[1])).reshape(len(x), self.tables, self.bits)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket of each row in each table."""
        return ((self.sides(x) > 0) * (1 << np.arange(self.bits))).sum(2)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """Buckets (row, table, probe), those across the nearest planes first."""
        flips = np.array(list(itertools.product((0, 1), repeat=self.bits)))  # all ways to cross planes
        d = self.sides(x)
        cost = np.abs(d) @ flips.T
        n = min(self.probes, len(flips))
        near = np.argpartition(cost, n - 1, axis=2)[:, :, :n] if n < len(flips) else np.broadcast_to(np.arange(n), (*cost.shape[:2], n))
        own = ((d > 0) * (1 << np.arange(self.bits))).sum(2)
        return own[:, :, None] ^ (flips * (1 << np.arange(self.bits))).sum(1)[near]


def _vectors(column: pa.Array, count: int) -> np.ndarray:
    """Rows scaled to length 1; rows of zeros stay."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(count, -1)
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length == 0, 1.0, length)[:, None]


def _lean(rows: DataFrame, id_col: str, vec: str, type_col: str | None, out: str) -> DataFrame:
    kind = F.col(type_col).cast("string") if type_col else F.lit("")
    ok = F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, lambda x: x.isNull())
    return rows.where(ok).select(F.col(id_col).alias(out), F.col(vec).cast("array<double>").alias("v"), kind.alias("kind"), F.size(vec).alias("dim")).where(F.col("kind").isNotNull())


def _placed(lean: DataFrame, out: str, index: Hyperplanes | None, query: bool) -> DataFrame:
    """Rows with the ``place`` (table and bucket) they belong to, or for a query every place it looks into."""
    if index is None:
        return lean.withColumn("place", F.lit(0).cast("bigint"))
    kind = dict(lean.dtypes)[out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    x = _vectors(some.column("v"), some.num_rows)
                    places = index.probed(x) if query else index.buckets(x)[:, :, None]
                    places = places + (np.arange(index.tables) << index.bits)[None, :, None]
                    row = np.repeat(np.arange(some.num_rows), places[0].size)
                    yield pa.RecordBatch.from_arrays([*[some.column(c).take(pa.array(row)) for c in (out, "v", "kind", "dim")], pa.array(places.ravel().astype(np.int64))], [out, "v", "kind", "dim", "place"])

    return lean.mapInArrow(run, f"{out} {kind}, v array<double>, kind string, dim int, place bigint")


def _best(sims: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (row, query) of the k best rows of each query; equal similarities go by ``order``."""
    rows, queries = [], []
    for j in range(sims.shape[1]):
        s = sims[:, j]
        some = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
        some = some[np.lexsort((order[some], -s[some]))][:k]
        rows.append(some)
        queries.append(np.full(len(some), j))
    return np.concatenate(rows), np.concatenate(queries)


def top_similar(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec: str = "embedding", query_id: str = "query_id",
                type_col: str | None = None, digits: int = 9, index: Hyperplanes | None = None) -> DataFrame:
    """The ``k`` most similar corpus rows per query by cosine (1 minus the cosine distance): query_id, id, similarity, rank.

    Exact without ``index``; with one, only rows of the buckets a query looks into are compared, each exactly. Similarities are rounded to ``digits``,
    equal ones go by id. With ``type_col`` (in both tables) a query only sees rows of its own type. Vectors that are null, empty or
    hold a null are left out, and only vectors of one length are compared.
    """
    if queries.isEmpty():
        raise DataError("no queries given")
    rows = _placed(_lean(corpus, id_col, vec, type_col, "_id"), "_id", index, False)
    asks = _placed(_lean(queries, query_id, vec, type_col, "_query"), "_query", index, True)
    keys = ["kind", "dim", "place"]
    parts = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") * F.col("dim") / VALUES).cast("int").alias(n))
    grid = parts(rows, "cs").join(parts(asks, "qs"), keys)  # places that hold both, with the parts each side is cut into
    spread = lambda df, key, own, other: df.join(grid, keys).withColumns({own: F.pmod(F.xxhash64(key), F.col(own + "s")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))}).drop("cs", "qs", "dim")
    left, right = spread(rows, "_id", "c", "q"), spread(asks, "_query", "q", "c").withColumnRenamed("v", "_v")
    types = dict(rows.dtypes)["_id"], dict(asks.dtypes)["_query"]

    def run(key: tuple, c: pa.Table, q: pa.Table) -> pa.Table:
        if not c.num_rows or not q.num_rows:
            return pa.table({"_query": q.column("_query").slice(0, 0), "_id": c.column("_id").slice(0, 0), "similarity": pa.array([], pa.float64())})
        c, q = c.combine_chunks(), q.combine_chunks()
        x, y = _vectors(c.column("v").combine_chunks(), c.num_rows), _vectors(q.column("_v").combine_chunks(), q.num_rows)
        order = np.empty(c.num_rows, np.int64)
        order[pc.sort_indices(c.column("_id")).to_numpy()] = np.arange(c.num_rows)
        at, of, sims = [], [], []
        for lo in range(0, len(y), 256):  # a slice of the queries at a time bounds the product's memory
            s = np.round(x @ y[lo : lo + 256].T, digits)
            i, j = _best(s, order, k)
            at.append(i)
            of.append(j + lo)
            sims.append(s[i, j])
        at, of = pa.array(np.concatenate(at)), pa.array(np.concatenate(of))
        return pa.table({"_query": q.column("_query").take(of), "_id": c.column("_id").take(at), "similarity": np.concatenate(sims)})

    group = ("kind", "place", "c", "q")
    right = right.withColumnsRenamed({x: f"_{x}_" for x in group})
    found = left.groupBy(*group).cogroup(right.groupBy(*[f"_{x}_" for x in group])).applyInArrow(run, f"_query {types[1]}, _id {types[0]}, similarity double")
    if index is not None:
        found = found.distinct()  # a pair may meet in several tables, always at the same similarity
    best = Window.partitionBy("_query").orderBy(F.desc("similarity"), "_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_query").alias(query_id), F.col("_id").alias(id_col), "similarity", F.col("rank").cast("bigint").alias("rank"))


def recall(exact: DataFrame, found: DataFrame, id_col: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """Number of queries and the share of the exact neighbours that were found."""
    hit = exact.select(query_id, id_col).join(found.select(query_id, id_col, F.lit(1).alias("_hit")), [query_id, id_col], "left")
    return hit.agg(F.count_distinct(query_id).alias("queries"), F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("recall"))
