"""Exact deduplication with a cuckoo-filter index of digests, kept in shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_value, free, lower_az, saved

by_value(__name__)

SLOTS = 4
KICKS = 200
#: Digests a shard of the index is planned for.
SHARD_KEYS = 200_000


class CuckooIndex:
    """Live digests: a table of 16-bit fingerprints in two possible buckets each, and beside every slot the entry it stands for.

    A fingerprint that matches is only a hint: the whole digest of the slot's entry decides. Where an insertion
    finds no free slot, the table doubles and is filled again from the stored digests.
    """

    def __init__(self, capacity: int = 64):
        self.entries: dict[int, list] = {}
        self.next = 0
        self.resizes = 0
        self._clear(max(2, 1 << max(1, int(capacity / (SLOTS * 0.8))).bit_length()))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints: list[list[int]] = [[] for _ in range(buckets)]
        self.slots: list[list[int]] = [[] for _ in range(buckets)]

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        one = int.from_bytes(digest[:8], "little") & self.mask
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 ^ mark * 0x9E37 >> 3) & self.mask)

    def find(self, digest: bytes) -> int | None:
        mark, one, two = self._place(digest)
        for b in (one, two):
            for p, k in zip(self.prints[b], self.slots[b]):
                if p == mark and self.entries[k][0] == digest:
                    return k
        return None

    def _put(self, digest: bytes, key: int) -> bool:
        mark, one, two = self._place(digest)
        for b in (one, two):
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.slots[b].append(key)
                return True
        b = two
        for k in range(KICKS):
            i = (mark + k) % SLOTS
            mark, self.prints[b][i] = self.prints[b][i], mark
            key, self.slots[b][i] = self.slots[b][i], key
            b = self._other(b, mark)
            if len(self.prints[b]) < SLOTS:
                self.prints[b].append(mark)
                self.slots[b].append(key)
                return True
        return False

    def _grow(self) -> None:
        buckets = 2 * (self.mask + 1)
        while True:
            self.resizes += 1
            self._clear(buckets)
            if all(self._put(e[0], k) for k, e in self.entries.items()):
                return
            buckets *= 2

    def insert(self, digest: bytes, best: tuple, rows: int) -> None:
        """Add ``rows`` rows of a digest; ``best`` is the largest (id, row) among them."""
        k = self.find(digest)
        if k is not None:
            e = self.entries[k]
            e[1], e[2] = max(e[1], best), e[2] + rows
            return
        k, self.next = self.next, self.next + 1
        self.entries[k] = [digest, best, rows]
        if not self._put(digest, k):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out of the filter and the content; False if it is not there."""
        k = self.find(digest)
        if k is None:
            return False
        mark, one, two = self._place(digest)
        for b in (one, two):
            if k in self.slots[b]:
                i = self.slots[b].index(k)
                del self.slots[b][i], self.prints[b][i]
                break
        del self.entries[k]
        return True


INDEX = "shard int, digest binary, best struct<id:bigint,row:bigint>, rows bigint"


def _shard(n: int):
    return F.pmod(F.hash("digest"), F.lit(n))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own for each row), id, digest (SHA-256 of the text with A-Z lower-cased; null text is empty)."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(lower_az(F.col(text_col)).cast("binary"), 256)).alias("digest"))


def _partials(rows: DataFrame) -> DataFrame:
    """Rows of a digest summed where they are read: a digest has one row for each of 32 parts, whatever its share."""
    best = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.col("row"))
    return rows.groupBy("digest", F.pmod("row", F.lit(32)).alias("part")).agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("rows"))


def _frame(shard: int, index: CuckooIndex) -> pd.DataFrame:
    e = list(index.entries.values())
    return pd.DataFrame({"shard": np.full(len(e), shard, np.int32), "digest": [x[0] for x in e], "best": [{"id": x[1][0], "row": x[1][1]} for x in e], "rows": [x[2] for x in e]})


def _entries(pdf: pd.DataFrame) -> Iterator[tuple]:
    for d, b, n in zip(pdf["digest"], pdf["best"], pdf["rows"]):
        yield bytes(d), (b["id"], b["row"]), int(n)


def build(rows: DataFrame, shards: int) -> DataFrame:
    """The index of a table of (row, id, digest): its live entries with their shard."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(len(pdf) // 2)
        for x in _entries(pdf):
            index.insert(*x)
        return _frame(key[0], index)

    return _partials(rows).withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(one, INDEX)


def update(index: DataFrame, shards: int, insert: DataFrame | None = None, delete: DataFrame | None = None) -> DataFrame:
    """The index after deleting the digests of ``delete`` (a table with ``digest``) and then inserting the rows of ``insert``.

    Digests to delete that are not live are ignored. The index must have been built with the same ``shards``.
    """
    spark = index.sparkSession
    change = "digest binary, best struct<id:bigint,row:bigint>, rows bigint, gone boolean"
    todo = spark.createDataFrame([], change)
    if delete is not None:
        todo = todo.unionByName(delete.select("digest").distinct().select("digest", F.lit(None).cast("struct<id:bigint,row:bigint>").alias("best"), F.lit(0).cast("long").alias("rows"), F.lit(True).alias("gone")))
    if insert is not None:
        todo = todo.unionByName(_partials(insert).select("digest", "best", "rows", F.lit(False).alias("gone")))

    def one(key: tuple, live: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        out = CuckooIndex(len(live) + len(todo))
        for x in _entries(live):
            out.insert(*x)
        for d in todo.loc[todo["gone"], "digest"]:
            out.delete(bytes(d))
        for x in _entries(todo[~todo["gone"]]):
            out.insert(*x)
        return _frame(key[0], out)

    return index.groupBy("shard").cogroup(todo.withColumn("shard", _shard(shards)).groupBy("shard")).applyInPandas(one, INDEX)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (hex).

    Texts are equal when identical after lower-casing A-Z; null is the empty text. The row with the largest id stays;
    a null id counts as lowest, and of rows that repeat an id and text one stays. Only id and text are read, so other
    columns may have any name. An empty table gives no rows.

    The digests are written once; each digest reaches the index in at most 32 pre-summed rows, and the join back has
    plain hash exchanges on both sides, which adaptive execution splits where one digest has many rows.
    """
    rows = saved(digests(docs, id_col, text_col), "digests")
    n = rows.count()
    shards = shards or max(12, -(-n // SHARD_KEYS))
    live = saved(build(rows, shards).select("digest", "best", F.col("rows").alias("group_size")), "cuckoo")
    return rows.join(live, "digest").select(
        F.col("id").alias(id_col),
        F.when(F.col("best.id") != -(1 << 63), F.col("best.id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns.

    Ids that differ tell the rows apart. Only where ids repeat, rows are told apart by id and text (as
    the digest has it), and of rows that repeat both, one is taken.
    """
    own, sha, as_id, as_text = (free(docs, c) for c in ("found_id", "found_sha", "as_id", "as_text"))
    out = saved(exact_dedup(docs, id_col, text_col), "exact").select(F.col(id_col).alias(own), F.col("text_sha256").alias(sha), F.col("kept").alias("stays"))
    gone = saved(out.where(~F.col("stays")).select(own, sha), "gone")
    same = docs[id_col].cast("long").eqNullSafe(F.col(own))
    if out.groupBy(own).count().where("count > 1").isEmpty():
        return docs.join(gone.select(own), same, "left_anti")
    same &= F.sha2(lower_az(docs[text_col]).cast("binary"), 256) == F.col(sha)
    stays = saved(out.where("stays").select(own, sha), "stays")
    twins = saved(stays.alias("s").join(gone.distinct().alias("g"), F.col(f"s.{own}").eqNullSafe(F.col(f"g.{own}")) & (F.col(f"s.{sha}") == F.col(f"g.{sha}")), "left_semi"), "twins")
    alike = docs.join(twins, same, "left_semi").withColumn(as_id, F.col(id_col).cast("long")).withColumn(as_text, F.sha2(lower_az(F.col(text_col)).cast("binary"), 256))
    return docs.join(gone.unionByName(twins).distinct(), same, "left_anti").unionByName(alike.dropDuplicates([as_id, as_text]).drop(as_id, as_text))
