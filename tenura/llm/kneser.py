"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted arrays that workers map into memory."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_value, flat_bytes, mix, saved, slices, texts_of, word_hashes
from tenura.session import scratch_folder

by_value(__name__)

#: Bytes of training text that one shard of the word table, and of the pair table, is planned for.
WORD_SHARD, PAIR_SHARD = 64 << 20, 16 << 20
#: Entries a task holds before it passes them on.
HELD = 2 << 20
#: The end of a text as a token.
END = np.uint64(0x452821E638D01377)


@dataclass
class Model:
    """Where the arrays are, and the few numbers that belong to all.

    Words are numbered in the order of their hashes; ``offsets`` has the first number of each word shard.
    ``discounts`` are those of pairs and of words (for counts 1, 2, and 3 or more); ``continuations`` is the number of different
    pairs, ``spare`` the share of the word distribution that its discounts leave to all words alike.
    """

    folder: str
    offsets: np.ndarray
    pair_shards: int
    tokens: int
    discounts: np.ndarray
    continuations: int
    spare: float

    @property
    def words(self) -> int:
        return int(self.offsets[-1])


def shared_path(folder: str) -> str:
    """The folder as a path that every executor can open, made if need be."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files into memory: {folder} must be a mounted folder (file: or a plain path)")
    os.makedirs(url.path, exist_ok=True)
    return url.path


def put(path: str, a: np.ndarray) -> None:
    """Write an array under its name only when it is complete, so a repeated task replaces equal by equal."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(np.ascontiguousarray(a).tobytes())
    os.replace(part, path)


def mapped(path: str, dtype: str) -> np.ndarray:
    return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)


def squeeze(a: np.ndarray, deltas: bool = False) -> bytes:
    """Bytes of an array, its differences if sorted, plane by plane, compressed."""
    import zstandard

    a = np.diff(a, prepend=a.dtype.type(0)) if deltas else a
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes())


def spread(b: bytes, dtype: str, deltas: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    a = np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if deltas else a


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts (1 each if none are given)."""
    if not len(keys):
        return keys.astype("<u8"), np.empty(0, "<u8")
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[head], np.diff(np.append(head, len(keys))).astype("<u8")
    return keys[head], np.add.reduceat(counts[order], head)


class Tally:
    """Counts of keys, handed on by shard whenever they have grown to HELD entries."""

    def __init__(self, shard, shards: int):
        self.shard, self.shards, self.keys, self.counts, self.size = shard, shards, [], [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, c = tally(keys)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)
        if self.size >= HELD:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        k, c = tally(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        s = self.shard(k)
        order = np.argsort(s, kind="stable")
        k, c, s = k[order], c[order], s[order]
        edges = np.searchsorted(s, np.arange(self.shards + 1))
        for i in range(self.shards):
            a, b = edges[i], edges[i + 1]
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([squeeze(k[a:b], True)], pa.binary()), pa.array([squeeze(c[a:b])], pa.binary())], ["shard", "keys", "counts"])


BLOBS = "shard int, keys binary, counts binary"


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [spread(x, "<u8", True) for x in table.column("keys").to_pylist()]
    counts = [spread(x, "<u8") for x in table.column("counts").to_pylist()]
    return tally(np.concatenate(keys), np.concatenate(counts))


def range_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a hash: equal ranges in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's words and one end, and where each text ends."""
    data, ends = flat_bytes(texts)
    h, starts, _, _ = word_hashes(data)
    stops = np.searchsorted(starts, ends)
    return np.insert(h, stops, END), stops + np.arange(1, len(texts) + 1)


class Words:
    """Numbers of words by their hashes."""

    def __init__(self, folder: str, offsets: np.ndarray):
        self.offsets = offsets
        self.shards = [mapped(f"{folder}/words-{i}", "<u8") for i in range(len(offsets) - 1)]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """-1 for words that are not there. Distinct hashes are looked up in order."""
        u, back = np.unique(h, return_inverse=True)
        out = np.full(len(u), -1, np.int64)
        edges = np.searchsorted(range_of(u, len(self.shards)), np.arange(len(self.shards) + 1))
        for i, keys in enumerate(self.shards):
            part = u[edges[i] : edges[i + 1]]
            if len(part) and len(keys):
                at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
                out[edges[i] : edges[i + 1]] = np.where(keys[at] == part, at + self.offsets[i], -1)
        return out[back]


def before(ids: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The token before each; ``start`` for the first of a text."""
    prev = np.concatenate(([start], ids[:-1]))
    prev[np.concatenate(([0], ends[:-1]))] = start
    return prev


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts from the numbers of entries with counts 1 to 4; each lies between 0 and its count."""
    n = np.maximum(n.astype(float), 1e-9)
    y = n[0] / (n[0] + 2 * n[1])
    raw = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.clip(raw, [0.05, 0.05, 0.05], [0.95, 1.9, 2.85])


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count all of ``docs`` and write the model below the folder of ``spark.checkpoint.dir``, which must be a mounted one.

    Words and then pairs of word numbers are counted in the tasks, handed on as compressed sorted arrays by shard and
    merged one shard per task; the number of shards follows the text. Pairs are spread by a hash of the pair, so no
    frequent word meets in one shard; what a shard adds to a word (different words before it, and as a context its total and
    its pairs seen once, twice and more) goes to the word's range as one sum. The driver gets sizes and counts of counts.
    """
    spark = docs.sparkSession
    folder = shared_path(scratch_folder(spark, "kneser"))
    lean = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = lean.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    word_shards, pair_shards = max(4, -(-size // WORD_SHARD)), max(4, -(-size // PAIR_SHARD))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally(lambda k: range_of(k, word_shards), word_shards)
        for whole in batches:
            for batch in slices(whole, "text"):
                yield from held.add(tokens(texts_of(batch, "text"))[0])
        yield from held.out()

    def keep_words(key: tuple, table: pa.Table) -> pa.Table:
        k, c = merged(table)
        put(f"{folder}/words-{key[0].as_py()}", k)
        put(f"{folder}/counts-{key[0].as_py()}", c)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "words": [len(k)], "tokens": [int(c.sum())]})

    for i in range(word_shards):
        put(f"{folder}/words-{i}", np.empty(0, "<u8"))
        put(f"{folder}/counts-{i}", np.empty(0, "<u8"))
    got = saved(lean.mapInArrow(count_words, BLOBS).groupBy("shard").applyInArrow(keep_words, "shard int, words bigint, tokens bigint"), "words").collect()
    sizes = np.zeros(word_shards, np.int64)
    for r in got:
        sizes[r["shard"]] = r["words"]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    n_words = int(offsets[-1])
    if n_words >= 1 << 32:
        raise ValueError("more than 2^32 different words")

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Words(folder, offsets)
        held = Tally(lambda k: range_of(mix(k), pair_shards), pair_shards)
        for whole in batches:
            for batch in slices(whole, "text"):
                h, ends = tokens(texts_of(batch, "text"))
                ids = number(h)
                yield from held.add((ids.astype("<u8") << np.uint64(32)) | before(ids, ends, n_words).astype("<u8"))
        yield from held.out()

    def keep_pairs(key: tuple, table: pa.Table) -> pa.Table:
        k, c = merged(table)
        put(f"{folder}/pairs-{key[0].as_py()}", k)
        put(f"{folder}/times-{key[0].as_py()}", c)
        word, context = (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rows = []  # of five facts: per word the pairs it ends; per context its tokens, and its pairs seen once, twice and more
        for ids, values in ((word, [np.ones(len(k), "<u8"), None, None, None, None]), (context, [None, c, c == 1, c == 2, c >= 3])):
            order = np.argsort(ids, kind="stable")
            head = np.flatnonzero(np.concatenate(([True], np.diff(ids[order]) != 0)))
            sums = np.stack([np.add.reduceat(v.astype("<u8")[order], head) if v is not None else np.zeros(len(head), "<u8") for v in values], 1)
            rows.append((ids[order][head], sums))
        ids, facts = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        shard = np.minimum(np.searchsorted(offsets, ids, side="right") - 1, word_shards - 1)
        out = {"shard": [], "ids": [], "facts": [], "ones": []}
        first = [int((c == i).sum()) for i in (1, 2, 3, 4)]
        for s in np.unique(shard):
            mine = shard == s
            out["shard"].append(int(s))
            out["ids"].append(squeeze(ids[mine].astype("<u8")))
            out["facts"].append(squeeze(facts[mine].astype("<u8").ravel()))
            out["ones"].append(first)
            first = [0, 0, 0, 0]
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "ids": pa.array(out["ids"], pa.binary()), "facts": pa.array(out["facts"], pa.binary()), "ones": pa.array(out["ones"], pa.list_(pa.int64()))})

    def keep_facts(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        n = int(sizes[s]) + (s == word_shards - 1)  # the last shard also has the start of texts as a context
        total = np.zeros((n, 5), "<u8")
        for ids, facts in zip(table.column("ids").to_pylist(), table.column("facts").to_pylist()):
            np.add.at(total, spread(ids, "<u8").astype(np.int64) - offsets[s], spread(facts, "<u8").reshape(-1, 5))
        put(f"{folder}/facts-{s}", total)
        seen = [int((total[:, 0] == i).sum()) for i in (1, 2, 3, 4)] + [int((total[:, 0] >= 3).sum())]
        return pa.table({"shard": pa.array([s], pa.int32()), "seen": pa.array([seen], pa.list_(pa.int64())), "pairs": [int(total[:, 0].sum())]})

    for i in range(pair_shards):
        put(f"{folder}/pairs-{i}", np.empty(0, "<u8"))
        put(f"{folder}/times-{i}", np.empty(0, "<u8"))
    for i in range(word_shards):
        put(f"{folder}/facts-{i}", np.zeros((int(sizes[i]) + (i == word_shards - 1), 5), "<u8"))
    partial = saved(lean.mapInArrow(count_pairs, BLOBS).groupBy("shard").applyInArrow(keep_pairs, "shard int, ids binary, facts binary, ones array<bigint>"), "facts")
    ones = partial.select(*[F.sum(F.col("ones")[i]) for i in range(4)]).first()
    last = partial.groupBy("shard").applyInArrow(keep_facts, "shard int, seen array<bigint>, pairs bigint").collect()
    seen = np.sum([r["seen"] for r in last], 0) if last else np.zeros(5)
    d = np.stack([discounts(np.array([x or 0 for x in ones])), discounts(seen[:4])])
    pairs = sum(r["pairs"] for r in last)
    spare = float(d[1] @ seen[[0, 1, 4]]) / pairs if pairs else 1.0
    return Model(folder, offsets, pair_shards, sum(r["tokens"] for r in got), d, pairs, spare)


class Scorer:
    """The model's arrays, mapped into memory."""

    def __init__(self, m: Model):
        self.m, self.number = m, Words(m.folder, m.offsets)
        self.counts = [mapped(f"{m.folder}/counts-{i}", "<u8") for i in range(len(m.offsets) - 1)]
        self.facts = [mapped(f"{m.folder}/facts-{i}", "<u8").reshape(-1, 5) for i in range(len(m.offsets) - 1)]
        self.pairs = [mapped(f"{m.folder}/pairs-{i}", "<u8") for i in range(m.pair_shards)]
        self.times = [mapped(f"{m.folder}/times-{i}", "<u8") for i in range(m.pair_shards)]

    def _of_words(self, arrays: list, ids: np.ndarray, width: tuple = ()) -> np.ndarray:
        """Rows of per-word arrays for sorted ids, zeros for -1."""
        out = np.zeros((len(ids), *width), np.float64)
        edges = np.searchsorted(ids, self.m.offsets)
        edges[-1] = len(ids)
        for i, a in enumerate(arrays):
            part = ids[edges[i] : edges[i + 1]]
            inside = part - self.m.offsets[i]
            ok = inside < len(a)
            if ok.any():
                out[edges[i] : edges[i + 1]][ok] = a[inside[ok]]
        return out

    def _times(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        shard = range_of(mix(keys), self.m.pair_shards)
        order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
        edges = np.searchsorted(shard[order], np.arange(self.m.pair_shards + 1))
        for i, have in enumerate(self.pairs):
            mine = order[edges[i] : edges[i + 1]]
            if len(mine) and len(have):
                at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
                out[mine] = np.where(have[at] == keys[mine], self.times[i][at], 0)
        return out

    def score(self, texts: list[str]):
        """Per text: tokens, known tokens, log10 of the base model, log10 of this model."""
        m = self.m
        h, ends = tokens(texts)
        ids = self.number(h)
        starts = np.concatenate(([0], ends[:-1]))
        u, back = np.unique(ids, return_inverse=True)
        c = self._of_words(self.counts, u)
        base = np.log10((c + 1) / (m.tokens + m.words + 1))
        d2, d1 = m.discounts
        facts = self._of_words(self.facts, u, (5,))
        cont = facts[:, 0]
        total = max(m.continuations, 1)
        less = np.select([cont == 0, cont == 1, cont == 2], [0, d1[0], d1[1]], d1[2])
        low = np.maximum(cont - less, 0) / total + m.spare / (m.words + 1)
        # pairs of a context and a word, each once
        prev = before(ids, ends, m.words)
        both = (ids >= 0) & (prev >= 0)
        key = (ids.astype("<u8") << np.uint64(32)) | (prev.astype("<u8") & np.uint64(0xFFFFFFFF))
        pair, where = np.unique(key[both], return_inverse=True)
        times = self._times(pair)
        context = (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cu, cback = np.unique(context, return_inverse=True)
        cf = self._of_words(self.facts, cu, (5,))[cback]
        off = np.select([times == 0, times == 1, times == 2], [0, d2[0], d2[1]], d2[2])
        n = np.maximum(cf[:, 1], 1)
        gamma = np.where(cf[:, 1] > 0, (cf[:, 2:] @ d2) / n, 1.0)
        word = (pair >> np.uint64(32)).astype(np.int64)
        p = np.where(cf[:, 1] > 0, (times - off) / n, 0) + gamma * low[np.searchsorted(u, word)]
        logp = np.log10(low[back])
        logp[both] = np.log10(p)[where]
        unknown_after = (ids < 0) & (prev >= 0)
        if unknown_after.any():
            ctx, inv = np.unique(prev[unknown_after], return_inverse=True)
            f = self._of_words(self.facts, ctx, (5,))
            g = np.where(f[:, 1] > 0, (f[:, 2:] @ d2) / np.maximum(f[:, 1], 1), 1.0)
            logp[unknown_after] += np.log10(np.maximum(g, 1e-12))[inv]
        add = lambda x: np.add.reduceat(x, starts) if len(texts) else np.empty(0)
        return ends - starts, add((c > 0).astype(np.int64)[back]), add(base[back]), add(logp)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text) of each row.

    Null text is empty and has one token, its end. Repeated rows get equal results; other columns are not read; a model of
    an empty table gives every token the same probability.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, known, base, full = scorer.score(texts_of(batch, "text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return lean.mapInArrow(run, "id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double").withColumnRenamed("id", id_col)
