"""Repeated passages: content-defined chunks of words, deduplicated by digest; where the chunks of a stretch all repeat, its words are compared exactly.

A gear hash rolls over the words of a text, and a chunk ends where the hash is least among its neighbours. Where chunks end depends on the words
around that place only, so an insertion moves the borders next to it and no others, and a run of equal words is cut as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenura.llm.common import BASE, SPACE, SharedBits, by_value, flat_bytes, free, marked, mix, slices, texts_of
from tenura.llm.common import written as saved

by_value(__name__)

#: Words in a row that make a passage when they repeat.
WORDS = 20
#: Longest run of powers of a base that a task keeps from one batch to the next.
KEPT = 4 << 20

GRAM = "h1 bigint, h2 bigint, id bigint, row bigint, word bigint, start bigint, end bigint"


def window(n: int) -> tuple[int, int]:
    """(words that the gear hash remembers, places among which a cut has the least hash), so that any ``n`` words in a row hold two cuts that are
    theirs whatever stands around them. No cuts (0, 0) for fewer than three words."""
    if n < 3:
        return 0, 0
    k = max(1, min(4, n // 5))
    return k, (n - k) // 2


def gear(h: np.ndarray, k: int) -> np.ndarray:
    """The gear hash after each word: h[i] + h[i - 1] << s + h[i - 2] << 2 s ..., where the shift s drives a word out after ``k`` steps."""
    shift = np.uint64(64 // k)
    out = h.copy()
    for j in range(1, k):
        out[j:] += h[:-j] << (shift * np.uint64(j))
    return mix(out)


def least_places(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` places, the last of its least ones (by the upper 32 bits); hash and place are one number, so one running minimum gives both."""
    last = np.uint64(0xFFFFFFFF)
    key = (v & ~last) | (last - np.arange(len(v), dtype=np.uint64))
    return (last - (sliding(key, width, np.minimum) & last)).astype(np.int64) if len(v) >= width else np.empty(0, np.int64)


class Hashes:
    """64-bit hashes of any byte ranges of one array, equal ranges alike wherever they stand (from sums of the bytes before each place)."""

    def __init__(self, data: np.ndarray, seed: int, known: dict | None = None):
        base, n = (BASE + 2 * seed) | 1, len(data)
        table = mix(np.arange(256, dtype=np.uint64) + np.uint64(256 * seed + 1))
        known = {} if known is None else known
        if len(known.get(seed, ((), ()))[0]) <= n:
            known[seed] = powers(base, n + 1), powers(pow(base, -1, 1 << 64), n + 1)
        ahead, self.back = known[seed]
        if n > KEPT:
            del known[seed]
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(table[data] * ahead[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64: n of them."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def sliding(x: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (np.minimum or np.maximum) over every ``width`` neighbours, in as many steps as ``width`` has bits: spans double, and the last two overlap."""
    span = 1
    while 2 * span <= width:
        x = take(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return take(x[: len(x) - rest], x[rest:]) if rest else x


class Grams:
    """All stretches of ``n`` words of some texts, the chunks the texts are cut into, and a sign of each stretch: the least hash among the stretches of about n / 2 words in it.

    Signs depend on nothing but the stretch, so equal stretches have equal signs, whatever stands around them and however often their words
    repeat. Words are split at white space; stretches are equal if their bytes are, white space between the words included.
    """

    def __init__(self, texts: list[str], n: int, known: dict | None = None):
        self.known = {} if known is None else known
        self.data, edges = flat_bytes(texts)
        white = SPACE[self.data]
        turn = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).view(np.int8)))
        self.starts, self.ends = turn[0::2], turn[1::2]
        self.text = np.searchsorted(edges, self.starts, side="right")
        self.first_word = np.searchsorted(self.text, np.arange(len(texts)))
        self.from_byte, self.n = np.concatenate(([0], edges)), n
        self.m = max(0, len(self.starts) - n + 1)
        self.whole = self.text[: self.m] == self.text[n - 1 : n - 1 + self.m]  # within one text
        self.one = Hashes(self.data, 0, self.known)

    @cached_property
    def short(self) -> np.ndarray:
        """Hashes of all stretches of about n / 2 words."""
        size = max(1, self.n // 2)
        return self.one(self.starts[: len(self.starts) - size + 1], self.ends[size - 1 :])

    @cached_property
    def least(self) -> np.ndarray:
        """The sign of each stretch."""
        return sliding(self.short, self.n - max(1, self.n // 2) + 1, np.minimum) if self.m else np.empty(0, np.uint64)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Last words of the chunks that lie between two cuts of a text, their digests, and the cut of each window of places.

        A cut is the word after which the gear hash is least in some window of places inside one text. Each word counts with
        the white space before it.
        """
        k, width = window(self.n)
        count = len(self.starts)
        none = np.empty(0, np.int64)
        if not k or count < k + width:
            return none, none.astype(np.uint64), none
        before = np.concatenate((self.starts[:1], np.where(self.text[1:] == self.text[:-1], self.ends[:-1], self.starts[1:])))
        v = gear(self.one(before, self.ends), k)
        best = least_places(v, width)  # window j: places j .. j + width - 1
        first = np.maximum(np.arange(len(best)) - (k - 1), 0)
        inside = (np.arange(len(best)) >= k - 1) & (self.text[first] == self.text[np.arange(len(best)) + width - 1])
        cut = best[inside]
        cut = cut[np.concatenate(([True], cut[1:] != cut[:-1]))] if len(cut) else cut  # windows move on, and so do their cuts
        same = self.text[cut[1:]] == self.text[cut[:-1]] if len(cut) else np.empty(0, bool)
        left, right = cut[:-1][same], cut[1:][same]
        return right, self.one(self.ends[left], self.ends[right]), best

    def shared(self, bits: np.ndarray) -> np.ndarray:
        """Stretches whose chunks may all occur again: those between the first and the last cut that belong to the stretch whatever stands around it."""
        k, width = window(self.n)
        m = self.m
        if not k or not m:
            return self.whole
        right, digest, best = self.chunks()
        single = np.zeros(len(self.starts) + 1, np.int64)
        single[right[~marked(bits, digest)] + 1] = 1
        single = np.cumsum(single)  # chunks without a copy that end before each word
        i = np.flatnonzero(self.whole)
        out = np.zeros(m, bool)
        out[i] = single[best[i + self.n - width] + 1] == single[best[i + k] + 1]
        return out

    def anchors(self) -> np.ndarray:
        """Stretches whose sign is at their first or last place: one of any n / 2 + 1 neighbours is, and equal stretches are so alike."""
        m = len(self.least)
        return (self.short[:m] == self.least) | (self.short[len(self.short) - m :] == self.least) if m else self.whole

    def edges(self, own: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Stretches that are no anchors, and whose neighbouring anchor before or after them is not ``good`` or not there."""
        m = len(self.least)
        i = np.arange(m)
        before = np.maximum.accumulate(np.where(own, i, -1))
        after = np.minimum.accumulate(np.where(own, i, m)[::-1])[::-1]
        fine = np.append(good, False)  # place m and -1: no anchor
        text = np.append(self.text[:m], -1)
        between = fine[before] & fine[after] & (text[before] == text[:m]) & (text[after] == text[:m])
        return ~own & ~between

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[at], self.ends[at + self.n - 1]
        return self.one(a, b), Hashes(self.data, 1, self.known)(a, b)


def chunk_digests(docs: DataFrame, n: int) -> DataFrame:
    """h1: the digests of all chunks, one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(Grams(texts_of(batch, "text"), n, known).chunks()[1].view(np.int64))], ["h1"])

    return docs.select("text").mapInArrow(run, "h1 bigint")


def grams(docs: DataFrame, n: int, kind: str, common: SharedBits, also: SharedBits | None = None) -> DataFrame:
    """GRAM rows of stretches of ``n`` words whose chunks all pass the filter ``common`` (a bitmap the workers read).

    Of kind ``anchors``, of kind ``edges`` (beside anchors that do not repeat: one of their chunks is single or they pass ``also``, a filter of single
    ones), of kind ``others`` (no anchors, and pass ``also``) or of kind ``all`` (pass ``also``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        signed, bits = common.value, None if also is None else also.value
        seen, known = TaskContext.get().partitionId() << 33, {}
        for whole in batches:
            for batch in slices(whole, "text"):
                g = Grams(texts_of(batch, "text"), n, known)
                own = g.anchors() & g.whole
                at = np.flatnonzero(g.whole)
                at = at[g.shared(signed)[at]]
                if kind in ("anchors", "others"):
                    at = at[own[at] == (kind == "anchors")]
                h1, h2 = g.digests(at) if len(at) else (np.empty(0, np.uint64), np.empty(0, np.uint64))
                if bits is not None:
                    has = marked(bits, h1)
                    if kind == "edges":
                        good = np.zeros(len(g.least), bool)
                        good[at[~has]] = own[at[~has]]
                        has = g.edges(own, good)[at]
                    at, h1, h2 = at[has], h1[has], h2[has]
                chars = np.concatenate(([0], np.cumsum((g.data & 0xC0) != 0x80)))
                text = g.text[at]
                base = chars[g.from_byte[text]]
                cols = (h1.view(np.int64), h2.view(np.int64), seen + text, at - g.first_word[text], chars[g.starts[at]] - base, chars[g.ends[at + n - 1]] - base)
                h1, h2, row, word, start, end = (pa.array(np.ascontiguousarray(c, np.int64)) for c in cols)
                yield pa.RecordBatch.from_arrays([h1, h2, batch.column("id").take(pa.array(text)), row, word, start, end], [c.split()[0] for c in GRAM.split(", ")])
                seen += batch.num_rows

    return docs.mapInArrow(run, GRAM)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = WORDS) -> DataFrame:
    """One row per passage that occurs more than once: doc_id, start, end (characters), words, first_id, first.

    Every word of every passage of ``least_words`` words or more that stands at two places is found, whatever the words are. Such a passage
    consists of stretches of ``least_words`` words whose digest occurs twice; a row is the union of stretches that overlap and are all first
    occurrences (least id, then place; ``first``: true) or all later ones. A stretch that overlaps its own first occurrence (as in a word
    said over and over) counts as first. ``first_id`` is the document of the first occurrence of the row's first stretch. Texts without a
    repeated passage have no row; those of fewer words, null and empty ones have no stretches. A null id comes before all others. Repeated rows
    are copies of each other like any texts; other columns are not read.

    Texts are cut into chunks of at most nine words or so, whose digests are counted. Equal stretches have equal chunks, so only stretches whose chunks
    all occur twice are looked at, and single text costs one digest for four or five words. Of such stretches the anchors are counted, about one in six, and then those that have a neighbouring anchor without a copy; between two repeated anchors all words are repeated, and
    count as first or later as the anchors do. So a passage of 1.5 times ``least_words`` is always marked by its own copies; a shorter one
    inside longer repeated text may have the mark of that text.

    Copies are counted by partial sums, so a stretch that a third of all texts share is one row per task; the join back leaves out what the
    filter knows to be single, and adaptive execution splits the partitions of common stretches.
    """
    n = max(1, least_words)
    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    common = SharedBits(saved(chunk_digests(lean, n).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "chunks"), "common")

    def counted(rows: DataFrame, label: str) -> DataFrame:
        return saved(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "word")).alias("first")), label)

    anchors = counted(grams(lean, n, "anchors", common), "anchors")
    single = SharedBits(anchors.where("n = 1").select("h1"), "single")
    edges = saved(grams(lean, n, "edges", common, single).select("h1").distinct(), "edges")
    single.drop()
    beside = SharedBits(edges, "beside")
    others = counted(grams(lean, n, "others", common, beside), "others")
    beside.drop()
    repeats = anchors.unionByName(others).where("n > 1").drop("n")
    copies = grams(lean, n, "all", common, SharedBits(repeats.select("h1"), "repeats")).join(repeats, ["h1", "h2"])
    later = ~(F.col("id").eqNullSafe(F.col("first.id")) & F.col("word").between(F.col("first.word"), F.col("first.word") + (n - 1)))
    marks = copies.select("id", "row", "word", "start", "end", later.alias("later"), F.col("first.id").alias("first_id"))
    w = Window.partitionBy("row", "later").orderBy("word")
    starts = F.when(F.lag("word").over(w) + n > F.col("word"), 0).otherwise(1)
    runs = marks.withColumn("new", starts).withColumn("run", F.sum("new").over(w)).groupBy("row", "later", "run").agg(
        F.min("id").alias(id_col), F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word") - F.min("word") + n).alias("words"),
        F.min_by("first_id", "start").alias("first_id"),
    )
    return runs.select(id_col, "start", "end", "words", "first_id", (~F.col("later")).alias("first"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = WORDS) -> DataFrame:
    """``docs`` with the later occurrences of repeated passages cut out of the text. Ids must tell the rows apart."""
    spans = repeated_passages(docs, id_col, text_col, least_words).where(~F.col("first"))
    own, cut_col = free(docs, "passage_id"), free(docs, "passage_cut")
    cut = saved(spans.groupBy(F.col(id_col).alias(own)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut_col)), "cut")
    out = docs.join(cut, docs[id_col].cast("long").eqNullSafe(F.col(own)), "left")
    text = F.col(text_col)
    step = lambda a, s: F.struct(F.concat(a["t"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))).alias("t"), s["end"].alias("at"))
    done = F.aggregate(cut_col, F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")), step, lambda a: F.concat(a["t"], F.substring(text, a["at"].cast("int") + 1, F.length(text))))
    return out.withColumn(text_col, F.when(F.col(cut_col).isNull(), text).otherwise(done)).select(*docs.columns)
