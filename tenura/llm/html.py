"""Main text of web pages: the contiguous region with the greatest sum of word and tag weights."""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_value, rows_within, slices, texts_of

by_value(__name__)

# Element names of the HTML standard by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
# Elements, and words of class, id and role, that hold no main text.
BOILERPLATE = frozenset("nav footer aside form button select option textarea iframe noscript template svg math script style title head dialog menu object audio video canvas".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo promotion related reply replies share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
ROLES = frozenset("banner complementary contentinfo navigation search form dialog alert".split())
LABELLED = frozenset(["article", "main"])

LEXER = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
MARKED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
BUCKETS = 1 << 14


@dataclass
class Page:
    """Events of a page in order: for each, its key, whether it is a word block, words, text, whether it is inside a labelled element, and whether it is boilerplate."""

    keys: list[str] = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    labelled: bool = False


def marks_of(attributes: str) -> tuple[str, bool]:
    """The first mark among the words of class, id and role, or the class itself if there is none; and whether a mark is a whole class, id or role."""
    first, mark, exact = "", "", False
    for name, value in MARKED.findall(attributes):
        value = value.strip("\"'").lower()
        role = ROLES if name.lower() == "role" else frozenset()
        exact = exact or any(t in MARKS or t in role for t in value.split())
        for word in re.split(r"[^a-z]+", value):
            if word in MARKS or word in role:
                mark = mark or "!" + word
        first = first or value
    return mark or ("." + first if first else ""), exact


def read(page: str) -> Page:
    """Split a page into tags and texts. A key names the nearest element that stands for a region, and the element itself.

    A marked element or form that turns out to be a wrapper of the main text (see ``Held``) counts as unmarked, in a second reading.
    """
    held = Held()
    out = parse(page, held, frozenset())
    free = held.wrappers()
    return parse(page, Held(), free) if free else out


@dataclass
class Held:
    """What marked elements and forms of a page hold, by their number, to tell wrappers of the main text from boilerplate.

    An element marked by a part of a class or id ("has-sidebar"), or a form, is a wrapper if it holds more than half of the page's words outside
    of boilerplate elements, or more words of article and main elements than stand outside of marked ones. One marked by a whole class, id or
    role ("comments") is a wrapper only if it holds nine in ten of the words, or if all words of article and main elements are in marked ones.
    """

    words: dict[int, int] = field(default_factory=dict)
    labelled: dict[int, int] = field(default_factory=dict)
    exact: dict[int, bool] = field(default_factory=dict)
    around: dict[int, int] = field(default_factory=dict)  # the next such element around each, 0 if none
    total: int = 0
    outside: int = 0

    def add(self, words: int, inner: int, inner_labelled: int | None) -> None:
        """Count words for the innermost marked element around them; those around that one get them in the end."""
        self.total += words
        if inner:
            self.words[inner] += words
        if inner_labelled == 0:
            self.outside += words
        elif inner_labelled:
            self.labelled[inner_labelled] += words

    def wrappers(self) -> frozenset:
        for k in sorted(self.around, reverse=True):  # inner elements have greater numbers
            if self.around[k]:
                self.words[self.around[k]] += self.words[k]
                self.labelled[self.around[k]] += self.labelled[k]
        return frozenset(
            k for k, exact in self.exact.items()
            if (self.words[k] > 0.9 * self.total or (self.labelled[k] and not self.outside) if exact else 2 * self.words[k] > self.total or self.labelled[k] > self.outside)
        )


def parse(page: str, held: Held, free: frozenset) -> Page:
    """``read`` with the elements numbered in ``free`` taken as unmarked; what marked elements hold is added to ``held``."""
    out = Page()
    # name, region, inside a labelled element, dropped, in a boilerplate element, marked element around (0: none), the same for the labelled one
    stack: list[tuple] = [("", "", False, False, False, 0, None)]
    opened: dict[str, int] = defaultdict(int)  # how many elements of each name are open: what is not open is not looked for
    at, raw, number = 0, "", 0

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e[0]] -= 1
        del stack[i:]

    def event(key: str, words: int, text: str, top: tuple) -> None:
        out.keys.append(key)
        out.words.append(words)
        out.text.append(text)
        out.inside.append(top[2])
        out.dropped.append(top[3])

    def text(piece: str) -> None:
        if piece:
            top = stack[-1]
            decoded = piece if top[0] in ("script", "style") else entities.unescape(piece)
            words = len(decoded.split())
            event(f"w {top[1]} {top[0]}", words, decoded, top)
            if words and not top[4]:
                held.add(words, top[5], top[6])

    for m in LEXER.finditer(page):
        closing, name = m[1], (m[2] or "").lower()
        if raw and not (closing and name == raw):
            continue  # markup inside a script is its text
        text(page[at : m.start()])
        at = m.end()
        if not name:
            continue
        top = stack[-1]
        if not m[4]:
            break  # the page ends inside a tag
        if closing:
            raw = ""
            if name in VOID and name != "br":
                continue
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i][0] == name:
                    cut(i)
                    break
            event(f"/ {top[1]} {name}", 0, "" if name in INLINE else " ", stack[-1])
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[i][0] == "p":
                    cut(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            for i in range(len(stack) - 1, 0, -1) if any(opened[x] for x in same) else ():
                if stack[i][0] in same:
                    cut(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
        top = stack[-1]
        mark, exact = marks_of(m[3]) if m[3] else ("", False)
        site_header = name == "header" and not top[2]
        hard = top[4] or site_header or (name in BOILERPLATE and name != "form")
        around = top[5]
        if mark.startswith("!") and name in ("html", "body", *LABELLED):
            mark = ""  # said of the page
        suspect = (mark.startswith("!") or name == "form") and not hard
        freed = False
        if suspect:
            number += 1
            freed = number in free
            held.exact[number], held.words[number], held.labelled[number], held.around[number] = exact and mark.startswith("!"), 0, 0, around
            around = number
        if freed and mark.startswith("!"):
            mark = ""
        named = (name in BOILERPLATE and not freed) or site_header
        region = name if named else mark or top[1]
        inside = top[2] or name in LABELLED
        out.labelled |= name in LABELLED
        dropped = top[3] or named or mark.startswith("!")
        around_labelled = around if name in LABELLED and top[6] is None else top[6]
        entry = (name, region, inside, dropped, hard, around, around_labelled)
        event(f"< {region} {name}", 0, "" if name in INLINE else " ", entry)
        if name not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(entry)
            opened[name] += 1
            raw = name if name in RAW and name not in ("svg", "math") else ""
    else:
        text(page[at:])
    return out


@dataclass
class Weights:
    """Log-odds of a word, and of a tag, to be main text, by hashed key; 0 where the key was not seen."""

    seen: np.ndarray
    odds: np.ndarray


def bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS


def learn(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", train_pages: int = 4_000) -> Weights:
    """Weights from pages that label their main text by an ``article`` or ``main`` element, about ``train_pages`` of all pages.

    The labelling element itself is no part of any key. Tasks reduce their pages to one count per hashed key, inside and outside.
    """
    lean = rows_within(pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html")), "id", train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, bool], int] = defaultdict(int)
        for whole in batches:
            for batch in slices(whole, "html"):
                for p in map(read, texts_of(batch, "html")):
                    if p.labelled:
                        for key, words, inside in zip(p.keys, p.words, p.inside):
                            if (words or key[0] != "w") and key.rpartition(" ")[2] not in LABELLED:
                                count[bucket(key), inside] += words or 1
        if count:
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in count], "inside": [i for _, i in count], "n": list(count.values())})

    rows = lean.mapInArrow(run, "key long, inside boolean, n long").groupBy("key").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inn"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("out")).collect()
    w = Weights(np.zeros(BUCKETS, bool), np.zeros(BUCKETS))
    for r in rows:
        w.seen[r["key"]] = True
        w.odds[r["key"]] = math.log((r["inn"] + 0.5) / (r["out"] + 0.5))
    return w


def weight(key: str, words: int, weights: Weights) -> float:
    """Words count 1 each where main text is as likely as not or more, and less than 0 in regions learned to be other; tags always cost.

    What is named as boilerplate is left out wherever it stands, so it costs little: an advert does not end an article.
    """
    kind, region, name = key.split(" ", 2)
    b = bucket(key)
    known, odds = weights.seen[b], weights.odds[b]
    other = region in BOILERPLATE or region.startswith("!") or region == "header" or (name in BOILERPLATE and name != "form")
    if kind == "w":
        if other:
            return -0.1 * words
        if known:
            return words * (1.0 if odds > -0.7 else max(-1.0, odds))
        return words * 1.0
    if other:
        return -0.2
    return -0.05 if known and odds > -0.7 else -0.5


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end event of the contiguous region with the greatest sum, found in one pass; the first of equal ones; (0, 0) if no sum is positive."""
    best, first, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, end = total, start, i + 1
    return first, end


def main_text(page: str, weights: Weights) -> str:
    p = read(page)
    first, end = best_region([weight(k, n, weights) for k, n in zip(p.keys, p.words)])
    return " ".join("".join(t for t, d in zip(p.text[first:end], p.dropped[first:end]) if not d or t == " ").split())


def extract(pages: DataFrame, weights: Weights, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with a column ``out``: the main text, white space as single spaces; empty if there is none or html is null or empty.

    Blocks are joined by a space and inline elements are not; character references are decoded. A page that ends inside a
    tag loses that tag. Text of menus, adverts, forms, scripts and the like inside the region is left out. Of equal regions
    the first is taken. Long pages are read whole; repeated rows stay; a column named ``out`` is replaced, others stay.
    """
    from pyspark.sql.functions import arrow_udf

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([main_text(x.as_py() or "", weights) for x in column], pa.string())

    return pages.withColumn(out, arrow_udf(run, "string").asNondeterministic()(F.col(html_col).cast("string")))
