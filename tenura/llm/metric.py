"""Jaccard join of word n-gram sets in their metric space: pivots, Voronoi regions, windows from the triangle inequality, exact leaves.

The distance is 1 - intersection / union, a metric. Documents first meet under *parts*: the shingle space is cut into parts
by a hash, and two similar sets differ in at most as many parts as shingles, so they agree on one of any larger number of parts.
Documents that agree on a part form a region around a pivot. Regions that hold more than one component and do not fit a task are cut again
around pivots of their own; in a task all distances come from a product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import BASE, bitmap, by_value, flat_bytes, marked, may_be_in, mix, slices, texts_of, word_hashes
from tenura.llm.common import written as saved
from tenura.llm.near import components

by_value(__name__)

#: Words of a shingle, and the least similarity in hundredths.
WORDS, LEAST = 4, 85
#: Sizes of sets that are cut into the same number of parts lie within this factor.
GROWTH = 1.6
#: Parts for each part that two similar sets can differ in.
SPARE = 1.25
#: Bytes of a part's digest.
DIGEST = 5
#: Documents, and shingles of theirs, that one task compares at a time.
LEAF_ROWS, LEAF_SHINGLES = 1024, 1 << 20
#: Pivots that a region too large for a task is cut around, and levels of regions after which the rest is compared in blocks.
PIVOTS, LEVELS = 16, 4
#: Shingles per column block of a leaf's matrix.
COLUMNS = 8192


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; its whole sequence if it has fewer words, none without any."""
    data, ends = flat_bytes(texts)
    h, starts, _, _ = word_hashes(data)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    base, n = np.uint64(BASE), len(h)
    s = np.zeros(max(0, n - words + 1), np.uint64)
    for j in range(words if len(s) else 0):
        s = s * base + h[j : n - words + 1 + j]
    s = mix(s)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        else:  # another mixing for each length: no clash with whole shingles
            part = np.zeros(1, np.uint64)
            for x in h[a:b]:
                part = part * base + x
            out.append(mix(part + np.uint64(b - a)) if b > a else part[:0])
    return out


def set_digest(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    k = mix(s + np.uint64(BASE))
    return np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), (k ^ (k >> np.uint64(17))).sum(dtype=np.uint64)], "<u8").tobytes()


def allowed(n: int, least: int) -> int:
    """Shingles that lie in one set only, at most, for a set of n and any similar one (which has n * 100 / least at most)."""
    return (100 - least) * (n + n * 100 // least) // (100 + least)


def levels_of(least: int) -> list[tuple[int, int]]:
    """(least size, number of parts) of each level of sizes. A level's parts exceed what its largest sets may differ in."""
    out, low = [], 1
    while low < 1 << 44:
        high = max(low + 1, ceil(low * GROWTH))
        widest = high * 100 // least  # sets of this level meet those of the next one that are not much larger
        out.append((low, ceil(SPARE * (allowed(widest, least) + 2))))
        low = high
    return out


def parts_of(s: np.ndarray, level: int, parts: int) -> np.ndarray:
    """Digests (low DIGEST bytes) of the set's shingles in each part; 0 for an empty part."""
    where = ((s >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    total = np.zeros(parts, np.uint64)
    np.add.at(total, where, mix(s + np.uint64(level)))
    d = mix(total) & np.uint64((1 << 8 * DIGEST) - 1)
    d[d == 0] = 1
    d[np.bincount(where, minlength=parts) == 0] = 0
    return d


def posted_parts(s: np.ndarray, least: int, levels: list[tuple[int, int]]) -> list[tuple[int, np.ndarray]]:
    """(level, parts) under which a set can meet every similar one: its own level, and the one below if a set there can be similar.

    If too few parts of a level hold a shingle (no more than the set may differ in), the parts do not suffice for it: it
    is then posted under each shingle besides (level -1 - level). Two similar sets that both do so share shingles.
    """
    n = len(s)
    own = int(np.searchsorted([low for low, _ in levels], n, side="right")) - 1
    out = []
    for level in {own, max(own - 1, 0)}:
        if level == own or 100 * (levels[own][0] - 1) >= least * n:
            p = parts_of(s, level, levels[level][1])
            out.append((level, p))
            if np.count_nonzero(p) <= allowed(n, least):
                out.append((-1 - level, np.unique(s & np.uint64((1 << 8 * DIGEST) - 1) | np.uint64(1))))
    return out


def tag(level: int) -> int:
    """0 to 3, different for the levels that one set is posted under."""
    return (level & 1) if level >= 0 else 2 + ((-1 - level) & 1)


def set_rows(docs: DataFrame, id_col: str, text_col: str, least: int, words: int) -> DataFrame:
    """row, id, set digest, n, parts (level, number, digests) and their number by tag; nothing of the text itself."""
    levels = levels_of(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                sets = shingles(texts_of(b, "text"), words)
                blobs, held = [], []
                for s in sets:
                    blob, full = [], [0] * 4
                    for level, p in posted_parts(s, least, levels) if len(s) else []:
                        full[tag(level)] = int(np.count_nonzero(p))
                        blob += [np.array([level, len(p)], "<i4").tobytes(), p.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :DIGEST].tobytes()]
                    blobs.append(b"".join(blob))
                    held.append(full)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(blobs, pa.binary()), pa.array(held, pa.list_(pa.int32()))],
                    ["id", "digest", "n", "parts", "held"],
                )

    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = lean.mapInArrow(run, "id bigint, digest binary, n bigint, parts binary, held array<int>")
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def tokens_of(classes: DataFrame) -> DataFrame:
    """(token, cls): a token is a part (or shingle) of a level with its digest; its two low bits are the level's tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "parts"):
                got, size = [np.empty(0, np.uint64)], []
                for blob in b.column("parts").to_pylist():
                    raw, at, n = np.frombuffer(blob, np.uint8), 0, 0
                    while at < len(raw):
                        level, m = (int(x) for x in np.frombuffer(blob, "<i4", 2, at))
                        wide = np.zeros((m, 8), np.uint8)
                        wide[:, :DIGEST] = raw[at + 8 : at + 8 + m * DIGEST].reshape(m, DIGEST)
                        d = wide.view("<u8").ravel()
                        full = np.flatnonzero(d)
                        place = full if level >= 0 else np.zeros(len(full), np.int64)
                        t = mix(mix(d[full]) + place.astype(np.uint64) * np.uint64(BASE) + np.uint64(level + (1 << 20)))
                        got.append(np.unique(t & ~np.uint64(3) | np.uint64(tag(level))))
                        n += len(got[-1])
                        at += 8 + m * DIGEST
                    size.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64)), pa.array(np.repeat(b.column("cls").to_numpy(), size))], ["token", "cls"])

    return classes.select("cls", "parts").mapInArrow(run, "token bigint, cls bigint")


def lists(classes: DataFrame, least: int) -> DataFrame:
    """(cls, token, weight): tokens that two classes at least share, for each class and level only so many of the rarest that similar sets share one of them.

    Of the tokens that two similar sets have in common, the rarest comes after those of either that the other does not
    have, and these are no more than ``allowed``. Tokens of one class alone come first in that order; they lead nowhere and only shorten the
    rest. ``weight`` is how many classes share the level's tokens, all told.
    """
    tokens = tokens_of(classes)
    common = saved(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "tokens")
    kind = F.col("token").bitwiseAND(F.lit(3)).cast("int")
    mine = tokens.join(common, "token").groupBy("cls", kind.alias("tag")).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"), F.sum("df").alias("weight"))
    differ = F.expr(f"(100 - {least}) * (n + (n * 100) div {least}) div (100 + {least})")
    most = (differ + 1 - (F.col("held")[F.col("tag")] - F.size("t"))).cast("int")
    rare = mine.join(classes.select("cls", "n", "held"), "cls").withColumn("most", most).where("most > 0")
    return saved(rare.select("cls", "weight", F.explode(F.slice("t", F.lit(1), F.col("most")))).select("cls", "weight", F.col("col.token").alias("token")), "lists")


def first_pivots(posted: DataFrame) -> DataFrame:
    """(pivot, cls): each class with the pivots of its lists. A list's pivot is its member of the greatest weight: of a group of
    copies the text that most were made from, so that one pivot leads most of the group's lists."""
    best = F.max(F.struct("weight", (-F.col("cls")).alias("minus")))
    heads = posted.groupBy("token").agg(best.alias("m"), F.count(F.lit(1)).alias("df")).where("df > 1").select("token", (-F.col("m")["minus"]).alias("pivot"))
    return saved(posted.join(heads, "token").where("cls != pivot").select("pivot", "cls").distinct(), "pivots")


def one_of_each(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The row of each class that stands for it (its least): (cls, id, digest, n, parts, held).

    Rows whose digest is no copy's need no join: a bitmap of the digests that occur twice tells them. Only the others are moved to leave out the copies.
    """
    twice = saved(reps.where("n > 1").select(F.xxhash64("digest").alias("h")), "twice")
    sure = rows.where("n > 0").withColumn("copy", may_be_in(twice, F.xxhash64("digest")))
    some = sure.where("copy").join(reps.select(F.col("cls").alias("row")), "row", "left_semi")
    return saved(sure.where("NOT copy").unionByName(some).drop("copy").withColumnRenamed("row", "cls"), "members")


def picked_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(cls, n, set) of the classes in ``wanted``: a bitmap picks documents by id where they are read, a join on id and digest makes it exact.

    Rows that repeat an id and its text give their set as often; what is made of sets does not change by that.
    """
    need = saved(classes.join(wanted, "cls", "left_semi").select("cls", "id", "digest", "n"), "wanted")
    bits = bitmap(need.select(F.coalesce("id", F.lit(0)).alias("id")))
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ids = pc.fill_null(whole.column("id"), 0).to_numpy()
            some = whole.filter(pa.array(marked(shared.value, ids), pa.bool_()))
            for b in slices(some, "text"):
                sets = shingles(texts_of(b, "text"), words)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["_id", "_digest", "set"])

    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = lean.mapInArrow(run, "_id bigint, _digest binary, set binary")
    return saved(found.join(need, (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("id"))).select("cls", "n", "set"), "sets")


def _set(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), "<u8")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of their incidence matrices, COLUMNS shingles at a time."""
    out = np.zeros((len(left), len(right)), np.float32 if max(map(len, left + right), default=0) < 1 << 24 else np.float64)
    if not len(left) or not len(right):
        return out.astype(np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    ca, cb = np.searchsorted(both, a), np.searchsorted(both, b)
    ha, hb = (np.flatnonzero((c < len(both)) & (both[np.minimum(c, len(both) - 1)] == x)) if len(both) else c[:0] for c, x in ((ca, a), (cb, b)))
    ra, ca, rb, cb = ra[ha], ca[ha], rb[hb], cb[hb]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    for at in range(0, len(both), COLUMNS):
        m = []
        for rows, cols, size in ((ra, ca, len(left)), (rb, cb, len(right))):
            lo, hi = np.searchsorted(cols, [at, at + COLUMNS])
            part = np.zeros((size, min(COLUMNS, len(both) - at)), out.dtype)
            part[rows[lo:hi], cols[lo:hi] - at] = 1
            m.append(part)
        out += m[0] @ m[1].T
    return out.astype(np.int64)


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links: fewer than there are rows, with the same components."""
    free, a, b = np.ones(len(near), bool), [], []
    for start in range(len(near)):
        if not free[start]:
            continue
        free[start] = False
        todo = [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & free)
            free[new] = False
            a += [at] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def leaf_links(leaves: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """(a, b): links that connect what is similar in each leaf, a (region, i, j) with members (cls, home, part); pairs of a home
    member of part i with any of part j, and the reverse."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        cls, home, part = (table.column(c).to_numpy() for c in ("cls", "home", "part"))
        each = [_set(x) for x in table.column("set")]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        both = shared_counts([each[x] for x in left], [each[x] for x in right])
        n = np.array([len(x) for x in each])
        some = 100 * both >= least * (n[left][:, None] + n[right][None, :] - both)
        some &= home[left][:, None] | home[right][None, :]
        near = np.zeros((len(cls), len(cls)), bool)
        near[np.ix_(left, right)] = some
        near |= near.T
        a, b = forest(near)
        return pa.table({"a": cls[a].astype(np.int64), "b": cls[b].astype(np.int64)})

    members = leaves.join(sets.select("cls", "set"), "cls")
    return members.groupBy("region", "i", "j").applyInArrow(run, "a bigint, b bigint")


def blocks(members: DataFrame) -> DataFrame:
    """The members of regions (with ``size`` and ``shingles``) as leaves: parts of bounded size, and each pair of parts one leaf."""
    m = F.greatest(F.ceil(F.col("size") / (LEAF_ROWS // 2)), F.ceil(F.col("shingles") / (LEAF_SHINGLES // 2))).cast("int")
    whole = (F.col("size") <= LEAF_ROWS) & (F.col("shingles") <= LEAF_SHINGLES)
    cut = members.withColumn("m", F.when(whole, 1).otherwise(m)).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int"))
    each = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return each.select("region", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "cls", "home")


def around_pivots(members: DataFrame, sets: DataFrame, least: int, level: int) -> DataFrame:
    """Members of large regions with pivots of these: (region, cls, pivot, linked, cell, home, n).

    Up to PIVOTS home members of a region become pivots, and every member's distance to each of them is worked out on whole
    sets. A home member belongs to its nearest pivot (``cell`` and ``home``). It can be similar to members of other regions only if
    these are no farther from that pivot than from their nearest one by twice the greatest distance of similar sets:
    such members come to the region as guests (``cell`` without ``home``).
    """
    rank = F.when(F.col("cls") == F.col("region"), -(1 << 63)).otherwise(F.xxhash64("cls", F.lit(level)))  # the one that a first region is named after
    first = members.where("home").groupBy("region", F.pmod(rank, F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct(rank.alias("rank"), "cls")).alias("p"))
    parts = F.greatest(F.ceil(F.col("size") / (LEAF_ROWS // 2)), F.ceil(F.col("shingles") / LEAF_SHINGLES)).cast("int")
    regions = members.groupBy("region").agg(F.max(parts).alias("parts"))
    pivots = first.select("region", F.col("p.cls").alias("cls")).join(regions, "region").join(sets, "cls").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    far = 2 * (100 - least) / 100 + 1e-9

    def run(key: tuple, table: pa.Table, heads: pa.Table) -> pa.Table:
        cls, home, n = (table.column(c).to_numpy() for c in ("cls", "home", "n"))
        heads = heads.sort_by("pivot")
        pivot = heads.column("pivot").to_numpy()
        x, p = [_set(s) for s in table.column("set")], [_set(s) for s in heads.column("head")]
        both = shared_counts(x, p)
        union = n[:, None] + np.array([len(s) for s in p])[None, :] - both
        d = 1 - both / np.maximum(union, 1)
        nearest = d.argmin(1)
        own = np.zeros(d.shape, bool)
        own[np.arange(len(cls)), nearest] = home
        cell = own | (d <= d.min(1)[:, None] + far)
        linked = 100 * both >= least * union
        out = (cell & ~np.isin(cls, pivot)[:, None]) | (linked & (cls[:, None] != pivot[None, :]))
        r, c = np.nonzero(out)
        cell &= ~np.isin(cls, pivot)[:, None]
        return pa.table({"region": np.full(len(r), key[0].as_py()), "cls": cls[r], "pivot": pivot[c], "linked": linked[r, c] & (cls[r] != pivot[c]), "cell": cell[r, c], "home": own[r, c], "n": n[r]})

    spread = members.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(-1)), parts).cast("int")).join(sets.select("cls", "set"), "cls").select("region", "part", "cls", "home", "n", "set")
    heads = pivots.select(F.col("region").alias("of"), F.col("part").alias("at"), F.col("cls").alias("pivot"), F.col("set").alias("head"))
    both = spread.groupBy("region", "part").cogroup(heads.groupBy("of", "at"))
    return saved(both.applyInArrow(run, "region bigint, cls bigint, pivot bigint, linked boolean, cell boolean, home boolean, n bigint"), "cells")


def region_join(open_: DataFrame, sets: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """(id, root) after all pairs of home members, and of home members and guests, of the regions (region, cls, home) are compared where needed.

    A region whose members are all in one component needs nothing more. One that fits a task is a leaf. A larger one is
    cut around pivots; where that makes no more than twice its rows, its cells are the regions of the next level, else (and after LEVELS levels) it is
    compared in pairs of blocks.
    """
    level, roots = 0, nodes.withColumn("root", F.col("id"))
    links = nodes.sparkSession.createDataFrame([], "a bigint, b bigint")
    while True:
        known = open_.join(roots.select(F.col("id").alias("cls"), "root"), "cls").join(sets.select("cls", "n"), "cls")
        facts = known.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").drop("r0", "r1")
        members = saved(known.join(facts, "region").select("region", "cls", "home", "n", "size", "shingles"), "members")
        if members.isEmpty():
            return roots
        whole = F.col("size").between(0, LEAF_ROWS) & F.col("shingles").between(0, LEAF_SHINGLES)
        large = members.where(~whole)
        todo, next_ = members.where(whole), None
        if level == LEVELS:
            todo = members
        elif not large.isEmpty():
            cells = around_pivots(large, sets, least, level)
            links = links.unionByName(cells.where("linked").select(F.col("pivot").alias("a"), F.col("cls").alias("b")))
            rows = cells.where("cell").groupBy("region").agg(F.count(F.lit(1)).alias("rows"))
            apart = saved(rows.join(large.select("region", "size").distinct(), "region").where("rows <= 2 * size").select("region"), "apart")
            todo = todo.unionByName(large.join(apart, "region", "left_anti"))
            next_ = cells.where("cell").join(apart, "region", "left_semi").select(F.xxhash64("region", "pivot").alias("region"), "cls", "home")
        links = saved(links.unionByName(leaf_links(blocks(todo), sets, least)), "links")
        roots = saved(components(nodes, links), "roots")
        if next_ is None:
            return roots
        open_, level = next_, level + 1


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """One row per input row: id, n_shingles, component_id.

    Words are runs of other than white space after lower-casing A-Z; a set holds the distinct shingles of ``words`` words, or the
    whole sequence where there are fewer. Pairs with 100 * intersection >= ``least`` * union are linked; component_id is the least id
    that links reach, itself included. Texts without words (null, empty, blank) have empty sets and link with nothing. Rows
    with a null id take part, but give no id: their component_id is the least id reachable, or null. Rows that repeat an
    id stay, each with its own set. Only id and text are read, so other columns may have any name. An empty table gives no rows.

    The join is exact: no pair is lost to a signature, a cap or a sample. Equal sets are one class from the start. What is
    compared are classes that agree on a part (see the module), inside the region of a pivot that both have.
    """
    rows = set_rows(docs, id_col, text_col, least, words)
    known = rows.where("n > 0")
    reps = saved(known.groupBy("digest").agg(F.min("row").alias("cls"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")), "classes")
    classes = one_of_each(rows, reps)
    pairs = first_pivots(lists(classes, least))
    nodes = saved(pairs.select("cls").union(pairs.select("pivot")).distinct().withColumnRenamed("cls", "id"), "nodes")
    sets = picked_sets(docs, classes, nodes.withColumnRenamed("id", "cls"), id_col, text_col, words)
    # a first region is a pivot and the classes that it leads
    around = pairs.select(F.col("pivot").alias("region"), "cls").union(pairs.select("pivot", "pivot").distinct())
    roots = region_join(around.withColumn("home", F.lit(True)), sets, nodes, least)
    of = reps.join(roots.select(F.col("id").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = saved(of.join(ids, "root").select("digest", "component_id"), "components")
    out = rows.join(found, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
