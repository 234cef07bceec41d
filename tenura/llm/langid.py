"""Language spans: script ranges narrow the languages of a word, Viterbi over word scores pays for each switch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_value, mix, slices, texts_of

by_value(__name__)

# First and last code point of each script that is told apart, after the Unicode block list.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF),
    ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FA1F),
]
NAMES = ["other", *dict.fromkeys(s[0] for s in SCRIPTS)]
ORDERS = (1, 2, 3, 4)


@dataclass
class Model:
    """langs; log-probabilities by hashed n-gram and language; log-share of each language; which languages use which script."""

    langs: list[str]
    logp: np.ndarray
    prior: np.ndarray
    uses: np.ndarray
    penalty: float


def script_of() -> np.ndarray:
    """For each code point: 0 if it is no letter, else 1 + the index of its script in NAMES."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.fromiter((chr(c).isalpha() for c in range(0x30000)), bool, 0x30000)
    out[:0x30000][letters] = 1
    for name, first, last in SCRIPTS:
        part = out[first : last + 1]
        part[part > 0] = 1 + NAMES.index(name)
    return out


#: Characters whose n-grams are held at a time, and bytes of text whose word scores are.
PART_CHARS, GROUP_BYTES = 1 << 19, 8 << 20


def words(texts: list[str], scripts: np.ndarray, buckets: int):
    """All words (runs of letters) of the texts, and their n-grams order by order.

    Returns per word: its text's number, first and last character (within the text), letters, script; and an iterator
    of (word, bucket) arrays. The n-grams of a word are those of its characters between two border marks.
    """
    flat = [low if len(low := t.lower()) == len(t) else t for t in texts]
    cp = np.frombuffer("\n".join([*flat, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter((len(t) + 1 for t in flat), np.int64, len(flat))
    begin = np.concatenate(([0], np.cumsum(size)))
    kind = scripts[cp]
    letter = kind > 0
    # every text ends with a line feed, so no run goes from one text to the next and each run has a place after it
    lag = np.concatenate(([False], letter[:-1]))
    start, stop = np.flatnonzero(letter & ~lag), np.flatnonzero(~letter & lag)
    n = stop - start

    def grams() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # the letters of the words and the place after each word, which stands for the closing mark
        use = letter | lag
        char = np.where(letter[use], cp[use], np.uint32(1)).astype(np.uint64)
        word = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        first = np.concatenate(([0], np.cumsum(n + 1)))[:-1]
        within = (np.arange(len(word)) - np.repeat(first, n + 1)).astype(np.int32)
        mul, h = np.uint64(0x9E3779B97F4A7C15), char + np.uint64(7)
        for order in ORDERS:
            if order > 1:
                h = np.concatenate((np.zeros(1, np.uint64), h[:-1]))
                h[within == 0] = 3  # the opening mark
                h = h * mul + char
            ok = (within + 2 >= order) if order > 1 else letter[use]
            yield word[ok], (mix(h[ok] + np.uint64(order)) % np.uint64(buckets)).astype(np.int32)

    text = np.searchsorted(begin, start, side="right") - 1
    return text, start - begin[text], stop - begin[text], n, kind[start].astype(np.int64) - 1, grams() if len(n) else iter(())


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of about PART_CHARS characters each."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= PART_CHARS or i == len(texts) - 1:
            yield at, texts[at : i + 1]
            at, chars = i + 1, 0


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", train_rows: int = 3_000, buckets: int = 1 << 16, penalty: float = 12.0) -> Model:
    """Learn from at most about ``train_rows`` rows of each language, taken by a hash of the id, so that a rare language is learned at any size.

    Tasks reduce their rows to one array of ``buckets`` counts per language; the driver gets the sums, one row per language.
    How common a language is counts over all its rows.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    size = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one number per language
    bound = docs.sparkSession.createDataFrame([(k, int((1 << 30) * min(1.0, train_rows / n))) for k, n in size.items()], "lang string, below bigint")
    rows = known.join(F.broadcast(bound), "lang").where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(17)), F.lit(1 << 30)) < F.col("below")).select("id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scripts, total, seen = script_of(), {}, {}
        for whole in batches:
            for batch in slices(whole, "text"):
                all_langs = np.array(batch.column("lang").to_pylist(), object)
                for first, some in parts(texts_of(batch, "text")):
                    langs = all_langs[first : first + len(some)]
                    text, _, _, n, script, grams = words(some, scripts, buckets)
                    own = {lang: langs[text] == lang for lang in set(langs)}
                    for lang, mine in own.items():
                        seen[lang] = seen.get(lang, 0) + np.bincount(script[mine], n[mine], minlength=len(NAMES))
                        total.setdefault(lang, np.zeros(buckets, np.int64))
                    for owner, gram in grams:
                        for lang, mine in own.items():
                            total[lang] += np.bincount(gram[mine[owner]], minlength=buckets)
        if total:
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "grams": pa.array([total[k].astype("<i8").tobytes() for k in total], pa.binary()), "scripts": pa.array([seen[k].astype("<i8").tobytes() for k in total], pa.binary())})

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros(buckets, np.int64)
        scripts = np.zeros(len(NAMES), np.int64)
        for batch in parts:
            for g, s in zip(batch.column("grams"), batch.column("scripts")):
                grams += np.frombuffer(g.as_buffer(), "<i8")
                scripts += np.frombuffer(s.as_buffer(), "<i8")
        yield pa.RecordBatch.from_pydict({"lang": pa.array([key[0].as_py()], pa.string()), "grams": pa.array([grams.tobytes()], pa.binary()), "scripts": pa.array([scripts.tobytes()], pa.binary())})

    schema = "lang string, grams binary, scripts binary"
    got = sorted(rows.mapInArrow(run, schema).groupBy("lang").applyInArrow(add, schema).collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in got]
    counts = np.array([np.frombuffer(r["grams"], "<i8") for r in got], float).reshape(len(langs), buckets)
    scripts = np.array([np.frombuffer(r["scripts"], "<i8") for r in got], float).reshape(len(langs), len(NAMES))
    logp = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * buckets)) if langs else counts
    share = np.array([max(1.0, size[k] / train_rows) for k in langs]) * counts.sum(1) + 1
    uses = scripts > 0.01 * scripts.sum(1, keepdims=True)
    return Model(langs, np.ascontiguousarray(logp.T, np.float32), np.log(share / share.sum()) if langs else share, uses, penalty)


def viterbi(text: np.ndarray, score: np.ndarray, texts: int, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word: the path with the highest score, less ``penalty`` for each switch; all texts step by step at once."""
    count = np.bincount(text, minlength=texts)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    order = np.argsort(-count, kind="stable")
    count, first = count[order], first[order]
    live = np.searchsorted(-count, -np.arange(count[0] if texts else 0), side="left")
    path = np.empty(len(text), np.int64)
    if not len(text):
        return path
    best = np.empty(len(text), np.int16 if score.shape[1] <= 1 << 15 else np.int32)  # the best language of the word before
    switched = np.empty(score.shape, bool)
    v = score[first[: live[0]]] + prior
    for t in range(1, len(live)):
        m = live[t]
        v = v[:m]
        top = v.argmax(1)
        high = v[np.arange(m), top][:, None] - penalty
        at = first[:m] + t
        best[at] = top
        switched[at] = high > v
        v = np.maximum(v, high) + score[at]
        ended = live[t + 1] if t + 1 < len(live) else 0
        path[first[ended:m] + t] = v[ended:].argmax(1)
    single = slice(live[1] if len(live) > 1 else 0, live[0])
    path[first[single]] = (score[first[single]] + prior).argmax(1)
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        now = path[at]
        path[at - 1] = np.where(switched[at, now], best[at], now)
    return path


def label_texts(texts: list[str], model: Model, scripts: np.ndarray):
    """lang, score and known share per text, and the spans (text, start, end, language number) of all texts."""
    k, got, used = len(model.langs), [], []
    for first, some in parts(texts):
        text, start, stop, n, script, grams = words(some, scripts, model.logp.shape[0])
        score = np.zeros((len(text), k), np.float32)
        for owner, gram in grams:
            g = model.logp[gram]
            for j in range(k):
                score[:, j] += np.bincount(owner, g[:, j], minlength=len(text))
        score /= len(ORDERS)
        fits = model.uses.T[script]
        used.append(fits)
        score = np.where(fits.any(1, keepdims=True), np.where(fits, score, score.min(initial=0.0) - 100), 0).astype(np.float32)
        got.append((text + first, start, stop, n, score))
    text, start, stop, n, score = (np.concatenate(x) for x in zip(*got))
    path = viterbi(text, score, len(texts), model.prior, model.penalty)
    fits = np.concatenate(used)
    letters, own = np.zeros((len(texts), k)), np.zeros((len(texts), k))
    np.add.at(letters, (text, path), n)
    np.add.at(own, (text, path), n * fits[np.arange(len(path)), path])
    total = letters.sum(1)
    pick = letters.argmax(1) if k else np.zeros(len(texts), int)
    lang = ["und" if not s else model.langs[p] for s, p in zip(total, pick)]
    share = np.where(total > 0, own[np.arange(len(texts)), pick] / np.maximum(total, 1), 0.0) if k else total
    known = np.bincount(text, n * fits.any(1), minlength=len(texts)) / np.maximum(total, 1)
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (path[1:] != path[:-1]))) if len(text) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(text)])) - 1 if len(head) else head
    return lang, share, known, (text[head], start[head], stop[tail] if len(head) else head, path[head])


def label(docs: DataFrame, model: Model, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct ``out``: lang, score, known, spans (start, end, lang).

    ``lang`` has the most letters in the spans; score is the share of all letters that are in its spans and in a script it uses;
    ``known`` is the share of letters in scripts that any learned language uses. Null or letterless texts are ``und``
    with score 0 and no spans. Words in a script that no learned language uses follow their neighbours, but add nothing to
    score and known: a text wholly in such scripts has both at 0. Ties go to the first language by name. A column named ``out`` is replaced; others stay; repeated rows stay.
    A model of no language calls every text ``und``.
    """
    from pyspark.sql.functions import arrow_udf

    kind = "struct<lang:string,score:double,known:double,spans:array<struct<start:bigint,end:bigint,lang:string>>>"

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scripts = script_of()
        for column in columns:
            done = []
            whole = pa.RecordBatch.from_arrays([column], ["text"])
            for batch in slices(whole, "text", GROUP_BYTES):
                texts = texts_of(batch, "text")
                if not model.langs:
                    lang, share, known, spans = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), (np.empty(0, np.int64),) * 4
                else:
                    lang, share, known, spans = label_texts(texts, model, scripts)
                names = pa.array([model.langs[p] for p in spans[3]], pa.string())
                items = pa.StructArray.from_arrays([pa.array(spans[1], pa.int64()), pa.array(spans[2], pa.int64()), names], ["start", "end", "lang"])
                borders = np.searchsorted(spans[0], np.arange(len(texts) + 1)).astype(np.int32)
                done.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(share, pa.float64()), pa.array(known, pa.float64()), pa.ListArray.from_arrays(borders, items)], ["lang", "score", "known", "spans"]))
            yield pa.concat_arrays(done) if done else pa.array([], KIND)

    return docs.withColumn(out, arrow_udf(run, kind).asNondeterministic()(F.col(text_col).cast("string")))


KIND = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("known", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))])
