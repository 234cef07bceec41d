"""The Jaccard join, whitening and fill-in-middle against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.llm import fim, metric, queries, whiten

DOC = "doc_id bigint, text string, cls bigint, region string, digest string"


def sets_of(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def edited(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        k = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.6:
            w[k] = f"n{rng.randrange(10**6)}"
        elif kind < 0.8:
            del w[k]
        else:
            w.insert(k, f"i{rng.randrange(10**6)}")
    return w


def corpus(seed):
    """Groups around a text at all similarities, short texts, a passage in most texts, copies, blanks."""
    rng = random.Random(seed)
    out = []
    passage = [f"p{k}" for k in range(60)]
    for g in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 80, 200]))]
        out += [" ".join(edited(rng, base, rng.randrange(0, 9))) for _ in range(25)]
    short = [f"s{k}" for k in range(14)]
    out += [" ".join(short[rng.randrange(3) : rng.randrange(4, 15)]) for _ in range(40)]
    out += [" ".join(passage + [f"o{rng.randrange(300)}" for _ in range(rng.randrange(0, 14))]) for _ in range(40)]
    out += ["", None, " \n\t", "one", "One", "two words", "x" * 30_000, "w " * 5_000, out[0], out[0].upper(), "é ü ß ñ", "É Ü ß ñ"]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


def classes(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -9, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -9) for r in df.collect())


def brute(rows, words, least):
    sets = {i: sets_of(t, words) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return sorted((i, len(sets[i]), root[i]) for i in sets)


@pytest.mark.parametrize("small", [False, True])
def test_join_links_what_brute_force_links(spark, monkeypatch, small):
    if small:  # regions are cut around pivots, over several levels, and compared in blocks
        for name, value in {"LEAF_ROWS": 6, "LEAF_SHINGLES": 2_000, "PIVOTS": 3, "LEVELS": 2, "COLUMNS": 7}.items():
            monkeypatch.setattr(metric, name, value)
    rows = corpus(5 + small)
    df = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], DOC).repartition(3)
    assert classes(metric.jaccard_classes(df)) == brute(rows, 4, 85)
    if not small:
        assert classes(metric.jaccard_classes(df, words=2, least=60)) == brute(rows, 2, 60)


def test_parts_are_shared_by_all_similar_sets():
    rng = np.random.default_rng(2)
    for least in (60, 85):
        levels = metric.levels_of(least)
        for _ in range(1500):
            n = int(rng.integers(1, 400))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop, add = rng.integers(0, n + 1, 2) * rng.random() * 0.3
            y = np.union1d(x[int(drop) :], rng.integers(0, 2**63, int(add)).astype(np.uint64))
            both = len(np.intersect1d(x, y))
            if not len(y) or 100 * both < least * (len(x) + len(y) - both):
                continue
            assert len(np.setxor1d(x, y)) <= min(metric.allowed(len(x), least), metric.allowed(len(y), least))
            keys = [{(lev, k if lev >= 0 else 0, int(d)) for lev, p in metric.posted_parts(s, least, levels) for k, d in enumerate(p) if d} for s in (x, y)]
            assert keys[0] & keys[1]


def test_cells_hold_every_similar_pair(spark):
    """Each pair within reach meets in the region of one's nearest pivot, or one of them is a pivot."""
    rng = random.Random(8)
    base = [rng.randrange(2**60) for _ in range(60)]
    sets = {k: np.unique(np.array(rng.sample(base, rng.randrange(40, 61)) + [rng.randrange(2**60) for _ in range(rng.randrange(6))], np.uint64)) for k in range(120)}
    frame = spark.createDataFrame([(k, len(s), bytearray(s.astype("<u8").tobytes())) for k, s in sets.items()], "cls bigint, n bigint, set binary")
    members = frame.select(F.lit(1).cast("bigint").alias("region"), "cls", (F.col("cls") % 5 != 0).alias("home"), "n", F.lit(120).cast("bigint").alias("size"), F.lit(7000).cast("bigint").alias("shingles"))
    cells = metric.around_pivots(members, frame, 85, 0).collect()
    linked = {frozenset((r["cls"], r["pivot"])) for r in cells if r["linked"]}
    home = {r["cls"]: r["pivot"] for r in cells if r["cell"] and r["home"]}
    inside = {(r["cls"], r["pivot"]) for r in cells if r["cell"]}
    pivots = {k for k in sets if k % 5 and k not in home}
    assert pivots and len(inside) < 120 * len(pivots)
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and (a % 5 or b % 5):
                if a in pivots or b in pivots:
                    assert frozenset((a, b)) in linked
                else:
                    assert any(x in home and (y, home[x]) in inside for x, y in ((a, b), (b, a)))


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(None, long), (None, "alone here once more"), (7, long + " tail"), (7, "other text of some words"), (3, long), (3, long), (9, None), (9, "")]
    got = classes(metric.jaccard_classes(spark.createDataFrame([(*r, 1, None, None) for r in rows], DOC)))
    assert got == sorted([(-9, 297, 3), (-9, 1, -9), (7, 298, 3), (7, 2, 7), (3, 297, 3), (3, 297, 3), (9, 0, 9), (9, 0, 9)])
    empty = metric.jaccard_classes(spark.createDataFrame([], DOC))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


# whitening

VEC = "vec_id bigint, embedding array<float>, weight string, x string, component string"


def whitened(x, w=None, k=8):
    w = np.ones(len(x), int) if w is None else w
    n, s = int(w.sum()), w @ x
    c = x - s / n
    v = (c * w[:, None]).T @ c / n
    e, u = np.linalg.eigh(v)
    o = np.argsort(-e)[:k]
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, dev, c @ u[:, o] / np.sqrt(e[o]), e[o] / np.trace(v)


def vector_rows(seed=1, n=300, dim=12):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, dim)) * np.linspace(0.2, 3, dim)).astype(np.float32)
    v[n // 3 : 2 * n // 3] = v[0]  # a third of all rows is one vector
    return v


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening_matches_brute_force(spark, weights):
    v = vector_rows()
    odd = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0] * 5), (906, [3e38] * 12), (None, v[1].tolist()), (0, v[5].tolist())]
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + odd
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], VEC).repartition(5)
    out = whiten.whiten(df, weights=weights).collect()
    kept = [(i, np.floor(1024 * np.array(r, np.float64)).astype(np.int64) + 100_000) for i, r in rows if i not in range(900, 907)]
    x = np.array([r for _, r in kept])
    if weights == "count":
        n, dev, z, share = whitened(x)
        of = {}
        for (i, r), d, p in zip(kept, dev, z):
            of.setdefault((i, d), []).append(np.abs(p))
    else:
        u, back = np.unique(x, axis=0, return_inverse=True)
        n, dev, z, share = whitened(u)
        of = {}
        for (i, _), b in zip(kept, back.ravel()):
            of.setdefault((i, dev[b]), []).append(np.abs(z[b]))
    assert len(out) == 8 * len(kept) and {r["n"] for r in out} == {n}
    for r in out:
        assert any(abs(p[r["component"] - 1] - abs(r["whitened"])) < 1e-8 for p in of[(r["vec_id"], int(r["deviation"]))])
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_whitening_of_degenerate_tables(spark):
    df = lambda rows: spark.createDataFrame([(i, r, "a", "b", "c") for i, r in rows], VEC)
    assert whiten.whiten(df([])).count() == 0
    assert whiten.whiten(df([(1, None), (2, [])])).count() == 0
    assert whiten.whiten(df([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance, no component
    line = whiten.whiten(df([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])])).collect()  # one dimension of two
    assert sorted((r["vec_id"], r["component"]) for r in line) == [(1, 1), (2, 1), (3, 1)]
    assert max(abs(abs(r["whitened"]) - w) for r, w in zip(sorted(line), [1.5**0.5, 0, 1.5**0.5])) < 1e-9
    huge = whiten.whiten(df([(k, [float(k) * 2**33, 1.0 * (k % 2)]) for k in range(6)])).collect()
    x = np.array([[k * 2**33 * 1024 + 100_000, 1024 * (k % 2) + 100_000] for k in range(6)], object)
    want = [sum((6 * a - b) ** 2 for a, b in zip(r, x.sum(0))) for r in x]
    assert {int(r["deviation"]) for r in huge} == set(want)


def test_op12_returns_the_stated_columns(spark):
    out = queries.op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    kinds = dict(out.dtypes)
    assert [kinds[c] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    rows = out.collect()
    assert max(r["identity_error"] for r in rows) < 1e-4 and all(str(r["deviation"]) == r["deviation_digits"] for r in rows)


# fill-in-middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(i, text):
    text = text or ""
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = TOKEN.findall(text)
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_texts_are_cut_moved_and_restored(spark):
    rng = random.Random(4)
    bits = ["a", "É", "日本", "😀", " ", "\n", "\t\x0b", " ", "<", "P>", "S", "<P", ">", "word", "\x00", "M>", "ñ", "\xa0"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(0, 40))) for _ in range(400)] + ["", None, " ", "é" * 50_000, "w 😀 " * 40_000, " lead", "trail \n", "has <P> in it", "<S>", "a <M>"]
    rows = [(None if k == 17 else k % 380, t, f"f{k}") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string").repartition(4)
    out = fim.transform(df).withColumn("back", fim.restore(F.col("fim.form"), F.col("fim.output"))).collect()
    assert len(out) == len(rows) and {r["form"] for r in out} == {r[2] for r in rows}
    seen = set()
    for r in out:
        f = r["fim"]
        assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == by_hand(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
        if f["form"] != "plain":
            raw = r["text"].encode()
            assert len(raw[: f["prefix_bytes"]].decode()) == f["prefix_chars"] and len(raw[f["prefix_bytes"] :][: f["middle_bytes"]].decode()) == f["middle_chars"]
        seen.add(f["form"])
    assert seen == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


def test_sparse_index_converts_both_ways():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choices("abc é日😀\n", k=rng.randrange(0, 60)))
        raw = text.encode()
        index = fim.Exceptions(np.frombuffer(raw, np.uint8))
        at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
        assert index.chars(at).tolist() == list(range(len(text) + 1))
        assert index.bytes(np.arange(len(text) + 1)).tolist() == at.tolist()
        assert len(index.at) == sum(ord(c) > 127 for c in text)
