"""Toxicity: a factorization machine over hashed terms, so that pairs of terms count beyond their own weights."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_value, flat_bytes, rows_within, slices, texts_of, word_hashes

by_value(__name__)

#: Hashed terms, and bytes of the word beginnings that are terms beside the words.
TERMS, HEADS = 1 << 20, (4, 5, 6, 7, 8)
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    """Bias, weight and factors of each term; terms whose share of labelled rows may be chance have none."""

    bias: float
    w: np.ndarray
    v: np.ndarray


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of all texts one after the other, and how many each text has.

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; terms are the words and the first
    bytes of longer ones.
    """
    data, ends = flat_bytes(texts)
    h, starts, _, heads = word_hashes(data, APART, HEADS)
    text = np.searchsorted(ends, starts, side="right").astype(np.uint64)
    keys = []
    for n, x in enumerate([h, *heads]):
        has = slice(None) if n == 0 else x != 0
        keys.append((text[has] << np.uint64(20)) | ((x[has] + np.uint64(n)) % np.uint64(TERMS)))
    u = np.unique(np.concatenate(keys))
    return (u & np.uint64(TERMS - 1)).astype(np.int32), np.bincount((u >> np.uint64(20)).astype(np.int64), minlength=len(texts))


def margins(term: np.ndarray, count: np.ndarray, m: Model) -> np.ndarray:
    """bias + sum of weights + sum over pairs of terms of the product of their factors, for each text."""
    text = np.repeat(np.arange(len(count)), count)
    out = m.bias + np.bincount(text, m.w[term], minlength=len(count))
    for f in range(m.v.shape[1]):
        x = m.v[term, f]
        out += 0.5 * (np.bincount(text, x, minlength=len(count)) ** 2 - np.bincount(text, x * x, minlength=len(count)))
    return out


def divergence(n: np.ndarray, hits: np.ndarray, base: float) -> np.ndarray:
    """Nats by which ``hits`` of ``n`` rows differ from the share ``base``."""
    share = hits / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return n * (np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0))


def joint_pairs(each: list[np.ndarray], y: np.ndarray, open_: np.ndarray, evidence: float, block: int = 2048) -> np.ndarray:
    """Pairs of terms in ``open_`` that are toxic together though neither says so alone: two columns of terms.

    The nats of a pair's common rows must pass ``evidence`` and the logarithm of how many more pairs than terms there are to try. Terms
    in too few toxic rows for that are left out, and terms that stand in the same rows count as one.
    """
    base, rows = float(y.mean()), len(each)
    toxic = np.flatnonzero(y > 0)
    flat, text = np.concatenate(each), np.repeat(np.arange(rows), [len(t) for t in each])
    hits = np.bincount(flat[y[text] > 0], minlength=TERMS)
    cand = np.flatnonzero(open_ & (hits >= evidence / -np.log(base)))
    if len(cand) < 2:
        return np.empty((0, 2), np.int64)
    need = evidence + np.log(len(cand) / 2)
    least = max(1, int(np.ceil(need / -np.log(base))))
    cand = cand[hits[cand] >= least]
    place = np.full(TERMS, -1)
    place[cand] = np.arange(len(cand))
    has = place[flat] >= 0
    bits = np.zeros((len(cand), -(-rows // 8)), np.uint8)
    np.bitwise_or.at(bits, (place[flat[has]], text[has] >> 3), (128 >> (text[has] & 7)).astype(np.uint8))
    bits, kept = np.unique(bits, axis=0, return_index=True)
    cand = cand[kept]
    found = [np.empty((0, 2), np.int64)]
    dense = lambda at: np.unpackbits(bits[at : at + block], axis=1)[:, toxic].astype(np.float32)
    for a in range(0, len(cand), block):
        left = dense(a)
        for b in range(a, len(cand), block):
            both = left @ dense(b).T
            i, j = np.nonzero(both >= least)
            i, j, k = i[i + a < j + b] + a, j[i + a < j + b] + b, both[i, j][i + a < j + b]
            for at in range(0, len(i), 20_000):
                p, q = i[at : at + 20_000], j[at : at + 20_000]
                n = np.bitwise_count(bits[p] & bits[q]).sum(1, dtype=np.int64)
                yes = (k[at : at + 20_000] > base * n) & (divergence(n, k[at : at + 20_000], base) >= need)
                found.append(np.stack([cand[p[yes]], cand[q[yes]]], 1))
    return np.concatenate(found)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", train_rows: int = 8_000, factors: int = 4, epochs: int = 20, evidence: float = 10.0, seed: int = 7) -> Model:
    """Learn from the documents of at most about ``train_rows`` rows of ``labels`` (id, label), taken by a hash of the id.

    Tasks turn whole texts into hashed terms; the driver gets only the terms of that bounded number of rows and fits by
    mini-batch AdaGrad on the logistic loss with weight decay. A term takes part if the share of label 1 among its rows
    differs from that of all rows by ``evidence`` nats (rows times divergence), so that long clean texts do not add up noise, or if
    it has a pair with another such term whose rows together say so (``joint_pairs``). Rows with a null label or id are left out; where an id has
    several labels, the highest counts.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    few = F.broadcast(rows_within(known, "id", train_rows))  # as many rows as the parameter says
    lean = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(few, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                t, n = terms(texts_of(batch, "text"))
                edges = np.concatenate(([0], np.cumsum(n)))
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), pa.array([t[a:b].astype("<i4").tobytes() for a, b in zip(edges, edges[1:])], pa.binary())], ["id", "y", "terms"])

    rows = lean.mapInArrow(run, "id string, y int, terms binary").collect()
    rows.sort(key=lambda r: (r["id"] or "", r["terms"]))
    y = np.array([float(r["y"] > 0) for r in rows])
    each = [np.frombuffer(r["terms"], "<i4") for r in rows]
    rng = np.random.default_rng(seed)
    m = Model(0.0, np.zeros(TERMS, np.float32), np.zeros((TERMS, factors), np.float32))
    if not len(y) or y.min() == y.max():
        m.bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return m
    df = np.bincount(np.concatenate(each), minlength=TERMS)
    hits = np.bincount(np.concatenate([t for t, l in zip(each, y) if l]), minlength=TERMS)
    nats = divergence(df, hits, y.mean())
    single = nats >= evidence
    pairs = joint_pairs(each, y, ~single & (df > 0), evidence)
    used = np.flatnonzero(single | (np.bincount(pairs.ravel(), minlength=TERMS) > 0))
    known = np.zeros(TERMS, bool)
    known[used] = True
    each = [t[known[t]] for t in each]
    m.v[used] = rng.normal(0, 0.01, (len(used), factors))
    m.v[pairs] += rng.choice([-0.5, 0.5], (len(pairs), 1, factors))  # a start from which the product of a pair's factors can grow
    m.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    gw, gv, gb, decay = np.full(TERMS, 1e-4), np.full((TERMS, factors), 1e-4), 1e-4, 1e-4
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            pick = order[at : at + 64]
            count = np.array([len(each[i]) for i in pick])
            t = np.concatenate([each[i] for i in pick])
            text = np.repeat(np.arange(len(pick)), count)
            x = m.v[t]
            s = np.stack([np.bincount(text, x[:, f], minlength=len(pick)) for f in range(factors)], 1)
            z = m.bias + np.bincount(text, m.w[t], minlength=len(pick)) + 0.5 * ((s * s).sum(1) - np.bincount(text, (x * x).sum(1), minlength=len(pick)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            u, back = np.unique(t, return_inverse=True)
            dw = np.bincount(back, g[text]) + decay * m.w[u]
            dv = np.stack([np.bincount(back, g[text] * (s[text, f] - x[:, f])) for f in range(factors)], 1) + decay * m.v[u]
            gw[u] += dw * dw
            gv[u] += dv * dv
            gb += g.sum() ** 2
            m.w[u] -= 0.1 * dw / np.sqrt(gw[u])
            m.v[u] -= 0.02 * dv / np.sqrt(gv[u])
            m.bias -= 0.1 * g.sum() / np.sqrt(gb)
    return m


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out`` from 0 to 1. Null and empty texts have no terms and get the score of the bias alone.

    Whole texts are read, however long; equal texts get equal scores; a column named ``out`` is replaced, others stay.
    The model, of fixed size, goes to the executors once.
    """
    from pyspark.sql.functions import arrow_udf

    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))  # plain arrays: executors need not know the class

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = SimpleNamespace(**dict(zip(("bias", "w", "v"), shared.value)))
        for column in columns:
            done = [np.empty(0)]
            for batch in slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
                z = margins(*terms(texts_of(batch, "text")), m)
                done.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.array(np.concatenate(done), pa.float64())

    return docs.withColumn(out, arrow_udf(run, "double").asNondeterministic()(F.col(text_col).cast("string")))
