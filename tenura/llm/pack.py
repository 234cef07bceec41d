"""Best-fit packing of token sequences: planned over a histogram of lengths, filled by rank within length."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenura.llm.common import by_value, saved, slices, texts_of

by_value(__name__)

PIECES = "doc_id bigint, piece int, start bigint, length int, ids binary, chunk int, place bigint"
#: Rows of the plan that may be broadcast; a longer plan is joined by exchange.
PLAN_ROWS = 200_000
#: White space in a row from which on a text is left to the file's own library; ten times as much still works in the fast form.
LONG_SPACE = re.compile(r"\s{10000}")


def tokenizer(path: str):
    """``encode(texts) -> list of id arrays`` with the vocabulary of a byte-level BPE file, special tokens of the text included.

    The merges are those of the file; they run in the ranked form of the same vocabulary, which gives the same ids several
    times faster. Special tokens of the file are recognised in a text, as the file's own library does. A text with a very
    long run of white space, at which the fast form's pattern gives up, is encoded by the file's own library.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(keep))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)
    own = None

    def encode(text: str) -> np.ndarray:
        nonlocal own
        if not LONG_SPACE.search(text):
            return enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        if own is None:
            import tokenizers

            own = tokenizers.Tokenizer.from_file(path)
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def token_pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of all documents, written once: doc_id, piece, start, length, ids (little-endian 32-bit), chunk, place.

    Null text counts as empty, so every row has at least the end token. Documents longer than ``size`` are cut into pieces
    of ``size`` tokens, the first of which may be shorter. ``place`` counts the pieces of one length in one ``chunk`` (task).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, chunk, seen = tokenizer(path), TaskContext.get().partitionId(), defaultdict(int)
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                    ids = np.append(encode(text), end_id).astype("<u4")
                    at, to, piece = 0, (len(ids) - 1) % size + 1, 0
                    while at < len(ids):
                        rows.append((doc, piece, at, to - at, ids[at:to].tobytes(), chunk, seen[to - at]))
                        seen[to - at] += 1
                        at, to, piece = to, to + size, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW)], [x.split()[0] for x in PIECES.split(", ")])

    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return saved(lean.mapInArrow(run, PIECES), "pieces")


ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]


def plan_best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, ranks, first sequence, offset).

    Sequences that look alike are one run of numbers with the same room. Of a length, as many pieces as there are
    take the run with the least room that holds them, and the rest of the run keeps its room. The work follows the number of
    lengths and runs, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, sequences)
    rooms: list[int] = []
    plan, opened = [], 0

    def add(r: int, first: int, n: int) -> None:
        if r > 0 and n > 0:
            if not room[r]:
                insort(rooms, r)
            heapq.heappush(room[r], (first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):  # no room: open as many sequences as the rest needs
                r, have = size, -(-left // (size // length))
                first, opened = opened, opened + have
            else:
                r = rooms[i]
                first, have = heapq.heappop(room[r])
                if not room[r]:
                    del rooms[i]
            # a sequence that took a piece has the least room of all, so it takes what it can before the next one does
            each = r // length
            full = min(have, left // each)
            rest = left - full * each if have > full else 0  # pieces of one more sequence, fewer than it could take
            for k in range(each if full else 0):  # the k-th piece of each full sequence
                plan.append((length, rank + k * full, full, first, size - r + k * length))
            rank += each * full
            for k in range(rest):
                plan.append((length, rank + k, 1, first + full, size - r + k * length))
            add(r - each * length, first, full)
            if rest:
                add(r - rest * length, first + full, 1)
            add(r, first + full + bool(rest), have - full - bool(rest))
            rank, left = rank + rest, left - each * full - rest
    return plan


def assign(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """``pieces`` (with length, chunk, place) and the ``sequence_id`` and ``offset`` each takes.

    Only counts are planned: at most ``size`` lengths reach the driver. A piece's rank within its length is the number of
    such pieces in earlier chunks and its place in its own, so no length is ever sorted or gathered in one task.
    """
    spark = pieces.sparkSession
    each = pieces.groupBy("length", "chunk").agg((F.max("place") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = saved(each.select("length", "chunk", "n", F.coalesce(before, F.lit(0)).alias("before")), "offsets")
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(counts, size)
    slots = spark.createDataFrame(plan, "length int, rank0 bigint, ranks bigint, first bigint, offset bigint")
    if len(plan) <= PLAN_ROWS:
        slots = F.broadcast(slots)
    ranked = pieces.join(offsets.drop("n"), ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("place"))
    out = ranked.join(slots, (ranked["length"] == slots["length"]) & F.col("rank").between(F.col("rank0"), F.col("rank0") + F.col("ranks") - 1)).drop(slots["length"])
    return out.withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("rank0")).drop("before", "rank", "rank0", "ranks", "first", "chunk", "place")


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids and places: doc_id, piece, start, length, ids, sequence_id, offset.

    Repeated rows are packed as often as they are there, also with equal or null ids; other columns are ignored; an empty
    table gives no rows.
    """
    return assign(token_pieces(docs, path, end_id, size, id_col, text_col), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (the joined pieces in order) and lengths: what a trainer reads. A sequence holds ``size`` tokens at most."""
    part = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(part.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.col("p.length").alias("lengths"))
