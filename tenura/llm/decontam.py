"""Benchmark decontamination: pigeonhole pieces found exactly, whole items verified by bit-parallel edit distance."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_value, free

by_value(__name__)

#: Characters of benchmark text that one pass over the documents holds; a larger benchmark takes more passes.
BLOCK_CHARS = 4_000_000
#: Characters an item allows one edit for.
CHARS_PER_EDIT = 16
#: Items with fewer characters after normalising are found only as they are, between word borders.
LEAST_CHARS = 24
WORD = re.compile(r"[^\W_]+")


class Spaced(dict):
    """A translation table that makes a space of what is neither letter nor digit, filled as characters turn up."""

    def __missing__(self, code: int) -> str:
        self[code] = c if (c := chr(code)).isalnum() else " "
        return self[code]


def normal(text: str, table: dict | None = None) -> str:
    """Lower-cased words with one space between and around."""
    return f" {' '.join(text.lower().translate(Spaced() if table is None else table).split())} "


def budget(item: str) -> int:
    """Edits an item may differ by."""
    return len(item) // CHARS_PER_EDIT


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): one piece more than edits are allowed, so one of them is unharmed in any match."""
    n = budget(item) + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """An item as bit vectors for Myers' distance; bit i stands for character i."""

    def __init__(self, item: str):
        self.size = len(item)
        self.bits: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.bits[c] |= 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance between the item and a part of ``text``, and where the first such part ends."""
        full, top, bits = (1 << self.size) - 1, 1 << (self.size - 1), self.bits
        plus, minus, score = full, 0, self.size
        least, end = score, 0
        for j, c in enumerate(text, 1):
            eq = bits.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (~(xh | plus) & full)
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (~(xv | up) & full), up & xv
            if score < least:
                least, end = score, j
        return least, end


class Matcher:
    """Finds items in normalised texts.

    Items of LEAST_CHARS characters and more may differ by some edits. Shorter ones must stand there word for word, between the borders of
    words. Items without a letter or digit are looked for in the text with its symbols, word for word between white space (``symbols``).
    """

    def __init__(self, items: list[tuple[int, str]], symbols: list[tuple[int, str]] = ()):
        import ahocorasick

        self.items = [(i, t) for i, t in items if t.strip()]
        self.patterns = [Pattern(t[1:-1]) if len(t) - 2 >= LEAST_CHARS else None for _, t in self.items]
        self.backward = [p and Pattern(t[-2:0:-1]) for p, (_, t) in zip(self.patterns, self.items)]
        self.find = ahocorasick.Automaton()
        at: dict[str, list] = defaultdict(list)
        for n, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t[1:-1]) if self.patterns[n] else [(0, t)]:
                at[piece].append((n, offset))
        for piece, places in at.items():
            self.find.add_word(piece, (len(piece), places))
        if at:
            self.find.make_automaton()
        self.symbols = [(i, re.compile(r"(?<!\S)" + r"\s+".join(map(re.escape, t.split())) + r"(?!\S)")) for i, t in symbols]

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, distance) in the normalised text, the best place of each item."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.items:
            return []
        tried = set()
        for end, (size, places) in self.find.iter(text):
            for n, offset in places:
                start = end - size + 1 - offset
                if (n, start) in tried or found.get(n, (1,))[0] == 0:
                    continue
                tried.add((n, start))
                p = self.patterns[n]
                if p is None:
                    found[n] = (0, start + 1, end)
                    continue
                k = p.size // CHARS_PER_EDIT
                low = max(0, start - k)
                window = text[low : start + p.size + k]
                d, stop = p.best(window)
                if d <= k and (n not in found or d < found[n][0]):
                    _, back = self.backward[n].best(window[:stop][::-1])
                    found[n] = (d, low + stop - back, low + stop)
        return [(self.items[n][0], a, b, d) for n, (d, a, b) in found.items()]

    def symbol_matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, start, end) of the first place of each item of symbols, in the text itself."""
        got = ((i, p.search(text)) for i, p in self.symbols)
        return [(i, m.start(), m.end()) for i, m in got if m]


def _places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normalised text as (first, end) characters of the text itself."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    where = []
    for m in WORD.finditer(low):
        where.append(-1)
        where.extend(range(m.start(), m.end()))
    where.append(-1)
    out = []
    for a, b in spans:
        inside = [w for w in where[a:b] if w >= 0]
        out.append((inside[0], inside[-1] + 1) if inside else (0, 0))
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """(id, text) of the items in blocks that hold about BLOCK_CHARS characters each. Items without text are left out."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield [(r["id"], r["text"]) for r in part.collect()]


MATCH = "array<struct<item_id:bigint,start:bigint,end:bigint,distance:int>>"


def _finder(items: list[tuple[int, str]]):
    from pyspark.sql.functions import arrow_udf

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = Spaced()
        words = [(i, normal(t, table)) for i, t in items]
        matcher = Matcher(words, [(i, t) for (i, t), (_, w) in zip(items, words) if t.strip() and not w.strip()])
        for column in columns:
            out = []
            for text in (x.as_py() or "" for x in column):
                got = matcher.matches(normal(text, table))
                places = _places(text, [(a, b) for _, a, b, _ in got]) if got else []
                out.append([{"item_id": i, "start": s, "end": e, "distance": d} for (i, _, _, d), (s, e) in zip(got, places)] + [{"item_id": i, "start": s, "end": e, "distance": 0} for i, s, e in matcher.symbol_matches(text)])
            yield pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32())])))

    return arrow_udf(run, MATCH).asNondeterministic()


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "contaminated") -> DataFrame:
    """``docs`` with an array ``out`` of the benchmark items found: item_id, start, end (characters of the text), distance.

    Both sides are lower-cased and reduced to words with one space between. An item is found where a part of the text is
    within one edit for each CHARS_PER_EDIT characters of it; of its places the one with the least distance, then the first
    found, is given. Items of under LEAST_CHARS characters are found only word for word, items of symbols alone in the text with its symbols,
    between white space. Null and empty texts hold nothing; null and blank items find nothing; repeated items and rows count as often as they are there. A column named ``out`` is replaced, others stay.
    Each pass over the texts holds one bounded block of items.
    """
    parts = []
    for n, items in enumerate(blocks(benchmark)):
        parts.append(free(docs, f"items{n}", out))
        docs = docs.withColumn(parts[-1], _finder(items)(F.col(text_col).cast("string")))
    return docs.withColumn(out, F.concat(*parts)).drop(*parts)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, start, end, distance."""
    lean = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return find_items(lean, benchmark).select("doc_id", F.explode("contaminated").alias("m")).select("doc_id", "m.*")
