"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.session import scratch_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text a worker takes on at a time, unless one text alone is longer.
SLICE_BYTES = 2 << 20


def by_value(name: str) -> None:
    """Functions of this module travel to the executors themselves, which need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the folder of ``spark.checkpoint.dir`` and read it back: its lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    folder = scratch_folder(spark, label)
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def written(df: DataFrame, label: str) -> DataFrame:
    """``saved``, and the shuffle files go with the write that they were made for, so that steps do not add up on disk."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return saved(df, label)
    finally:
        conf.set(name, before)


def free(df: DataFrame, name: str, *more: str) -> str:
    """A column name that ``df`` does not have, nor one of ``more``, whatever the case."""
    taken = {c.lower() for c in [*df.columns, *more]}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_az(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col.cast("string"), F.lit("")), UPPER, LOWER)


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(0))


def rows_within(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About ``rows`` rows by a hash of the id (all of them where there are fewer); the same ones at every run."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Parts of a batch with at most ``most`` bytes of ``column``, but one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Odd multiplier of the rolling word hash, and tables that mark white space and lower-case A-Z.
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def word_hashes(data: np.ndarray, apart: np.ndarray = SPACE, heads: tuple[int, ...] = ()) -> tuple:
    """Words of UTF-8 bytes with A-Z lower-cased: their 64-bit hashes, first bytes and ends, and hashes of their ``heads``.

    ``apart`` marks the bytes between words (white space, so that words are ``[^\\x20\\x09-\\x0D]+``). For each number of
    bytes in ``heads`` a fourth result has one array of the hash of each word's first bytes, 0 for shorter words.

    A word's hash is a polynomial of its bytes modulo 2^64, evaluated for all words at once, position by position.
    """
    if not len(data):
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, [np.empty(0, np.uint64) for _ in heads]
    white = apart[data]
    edge = np.flatnonzero(np.diff(white.view(np.int8)))
    starts = edge[white[edge]] + 1
    ends = edge[~white[edge]] + 1
    if not white[0]:
        starts = np.concatenate(([0], starts))
    if not white[-1]:
        ends = np.concatenate((ends, [len(data)]))
    length = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out, starts, ends, [out for _ in heads]
    code = LOWERED[data].astype(np.uint64) + np.uint64(1)
    # bytes of a word in steps of its position, for all words that are long enough
    base, order = np.uint64(BASE), np.argsort(-length, kind="stable")
    s, sorted_len = starts[order], length[order]
    acc = np.zeros(len(starts), np.uint64)
    live = len(starts)
    short = min(int(sorted_len[0]), 64)
    firsts = {n: np.zeros(len(starts), np.uint64) for n in heads}
    for k in range(short):
        if k in firsts:
            live = int(np.searchsorted(-sorted_len, -k, side="right"))
            firsts[k][order[:live]] = mix(acc[:live] + np.uint64(k))
        live = int(np.searchsorted(-sorted_len, -k, side="left"))
        acc[:live] = acc[:live] * base + code[s[:live] + k]
    for i in np.flatnonzero(sorted_len > 64):  # few and long: Horner over blocks of 64 bytes
        powers = POWERS
        rest = code[s[i] + 64 : s[i] + sorted_len[i]]
        h = acc[i]
        for at in range(0, len(rest), 64):
            part = rest[at : at + 64]
            h = h * powers[len(part)] + (part * powers[len(part) - 1 :: -1][: len(part)]).sum(dtype=np.uint64)
        acc[i] = h
    out[order] = mix(acc ^ (sorted_len.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    for k in firsts:
        if k >= short:
            live = int(np.searchsorted(-sorted_len, -k, side="right"))
            firsts[k][order[:live]] = mix(acc[:live] + np.uint64(k))
    return out, starts, ends, list(firsts.values())


POWERS = np.array([pow(BASE, k, 1 << 64) for k in range(65)], np.uint64)


def flat_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by a line feed, and where each ends."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), ends


def bitmap(hashes: DataFrame, per: int = 16, most: int = 1 << 30) -> np.ndarray:
    """The bits of the 64-bit ``hashes`` (one column) set in a packed bitmap of ``per`` bits for each, up to ``most``: more would let more pass, no less.

    Tasks set the bits, the driver joins eight bitmaps of bounded size.
    """
    bits = bits_for(hashes, per, most)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([marks_of(batches, bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for r in hashes.select(F.col(hashes.columns[0]).cast("long")).coalesce(8).mapInArrow(marks, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def bits_for(hashes: DataFrame, per: int, most: int) -> int:
    return min(most, max(1 << 16, 1 << (per * hashes.count() - 1).bit_length()))


def marks_of(batches: Iterator[pa.RecordBatch], bits: int) -> np.ndarray:
    hit = np.zeros(bits // 8, np.uint8)
    for b in batches:
        i = b.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
        np.bitwise_or.at(hit, (i >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (i & np.uint64(7)).astype(np.uint8))
    return hit


class SharedBits:
    """The ``bitmap`` of ``hashes`` for tasks to read. Where the folder of ``spark.checkpoint.dir`` is mounted (``file:`` or a plain path) it is a file
    there: tasks write eight bitmaps, the driver joins them slice by slice, workers map the file into memory, and neither the driver's Python
    nor its JVM ever holds a bitmap. Any other folder takes a broadcast."""

    def __init__(self, hashes: DataFrame, label: str, per: int = 16, most: int = 1 << 30):
        spark = hashes.sparkSession
        folder = scratch_folder(spark, label)
        self.path = self.sent = None
        if not folder.startswith(("/", "file:")):
            self.sent = spark.sparkContext.broadcast(bitmap(hashes, per, most))
            return
        folder = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(folder, exist_ok=True)
        bits = bits_for(hashes, per, most)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path = f"{folder}/part-{uuid.uuid4().hex}"
            marks_of(batches, bits).tofile(path)  # a task that is repeated writes another file, and only files of finished tasks are read
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

        parts = [r["path"] for r in hashes.select(F.col(hashes.columns[0]).cast("long")).coalesce(8).mapInArrow(put, "path string").collect()]
        self.path = f"{folder}/bits"
        with open(self.path, "wb") as f:
            for at in range(0, bits // 8, SLICE_BYTES):
                out = np.zeros(min(SLICE_BYTES, bits // 8 - at), np.uint8)
                for p in parts:
                    out |= np.fromfile(p, np.uint8, len(out), offset=at)
                f.write(out.tobytes())
        for p in parts:
            os.remove(p)

    @property
    def value(self) -> np.ndarray:
        return np.memmap(self.path, np.uint8, "r") if self.path else self.sent.value

    def drop(self) -> None:
        """The driver's blocks go, if there are any; files stay like other intermediate tables."""
        if self.sent is not None:
            self.sent.destroy()


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes have their bit set in a packed bitmap."""
    i = h.astype(np.uint64) % np.uint64(8 * len(bits))
    return (bits[(i >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (i & np.uint64(7))).astype(np.uint8)) & 1 == 1


def may_be_in(hashes: DataFrame, column: Column) -> Column:
    """Whether a 64-bit hash may be among ``hashes``: false is certain. Costs one bitmap of bounded size per worker and no exchange."""
    from pyspark.sql.functions import arrow_udf

    shared = hashes.sparkSession.sparkContext.broadcast(bitmap(hashes))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in columns:
            yield pa.array(marked(shared.value, c.to_numpy(zero_copy_only=False)), pa.bool_())

    return arrow_udf(run, "boolean").asNondeterministic()(column)
