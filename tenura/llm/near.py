"""Near-duplicate documents: an inverted join over MinHash coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import BASE, by_value, flat_bytes, free, mix, saved, slices, texts_of, word_hashes

by_value(__name__)

#: Words of a shingle, and the least similarity in hundredths.
WORDS, LEAST = 5, 75
#: Coordinates that documents are posted under. Of these, similar documents share SHARED at least (a binomial with 0.75
#: falls below once in 10^9), so POSTED - SHARED + 1 of them, whichever all agree on, must hold a shared one.
POSTED, SHARED = 64, 26
#: Coordinates of the longer signature by which members of a list are compared, and how many of them must agree for a
#: pair to be verified (similar ones have fewer once in 10^9).
COORDINATES, MATCHES = 384, 237
#: Parts of the hash range in which the shared shingles of two sets are compared by number.
PARTS = 128
#: Members of a list that one task compares with each other.
BLOCK = 2048
#: Bits of the filter that picks the documents whose sets are needed, at most.
FILTER_BITS = 1 << 26


def multipliers(n: int) -> np.ndarray:
    """Odd numbers from a fixed rule."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def shingles(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A digest of each text's word sequence (two 64-bit numbers) and its sorted distinct shingle hashes; no words: an empty set.

    A text of fewer than WORDS words has its whole sequence as its only shingle.
    """
    data, ends = flat_bytes(texts)
    h, starts, _, _ = word_hashes(data)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    base = np.uint64(BASE)
    n = len(h)
    s = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for j in range(WORDS):
        s = s * base + h[j : n - WORDS + 1 + j] if len(s) else s
    s = mix(s)
    sets, digests = [], np.zeros((len(texts), 2), np.uint64)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if b - a >= WORDS:
            sets.append(np.unique(s[a : b - WORDS + 1]))
        elif b > a:
            sets.append(np.array([_sequence(h[a:b])[0]], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
        digests[i] = _sequence(h[a:b])
    return digests, sets


def _sequence(h: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two independent hashes of a sequence of word hashes."""
    k = np.arange(1, len(h) + 1, dtype=np.uint64)
    a = mix(h + k * np.uint64(BASE)).sum(dtype=np.uint64)
    b = mix((h ^ np.uint64(0x5851F42D4C957F2D)) + k * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return a, b


def signature(s: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The least value of each coordinate over a set, 32 bits."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (odd[:, None] * s[None, at : at + 2048]).min(1))
    return (low >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, sequence digest, n_shingles and signature of each row; nothing of the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = multipliers(POSTED)
        for whole in batches:
            for batch in slices(whole, "text"):
                digests, sets = shingles(texts_of(batch, "text"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([d.tobytes() for d in digests], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s, odd).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["id", "words", "n", "sig"],
                )

    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return saved(lean.mapInArrow(run, "id bigint, words binary, n bigint, sig binary"), "signatures")


def posts(classes: DataFrame) -> DataFrame:
    """(token, id, df): the posts from which come those that a similar pair must share one of.

    A token is a coordinate and its value. Tokens that one class alone has are the rarest: they come first in every
    class's order and lead nowhere, so they only shorten the rest. Of the others the rarest are taken until, with
    the rarest before them, POSTED - SHARED + 1 are reached: the most common tokens of a class are never posted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.arange(POSTED, dtype=np.uint64) << np.uint64(32)
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u4").reshape(-1, POSTED)
                yield pa.RecordBatch.from_arrays([pa.array((sig | mark).astype(np.int64).ravel()), pa.array(np.repeat(b.column("id").to_numpy(), POSTED))], ["token", "id"])

    tokens = classes.select("id", "sig").mapInArrow(run, "token bigint, id bigint")
    common = saved(tokens.groupBy("token").count().where("count > 1").withColumnRenamed("count", "df"), "tokens")
    return tokens.join(common, "token")


def prefixes(classes: DataFrame) -> DataFrame:
    """id, the tokens it is posted under, and its weight: how many classes share its tokens, all told."""
    of = posts(classes).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"), F.sum("df").alias("weight"))
    most = F.lit(POSTED - SHARED + 1) - (F.lit(POSTED) - F.size("t"))  # the tokens of its own come first
    return of.where(most > 0).select("id", F.slice("t", F.lit(1), most)["token"].alias("tokens"), "weight")


def leaders(posted: DataFrame) -> DataFrame:
    """(a, b): each posted class with the one that leads most of its lists.

    A list is led by its member of the greatest weight: the text that most copies were made from, not one of the edited ones.
    """
    lists = posted.select("id", "weight", F.explode("tokens").alias("token"))
    best = F.max(F.struct("weight", (-F.col("id")).alias("minus")))
    first = lists.groupBy("token").agg(best.alias("m"), F.count(F.lit(1)).alias("df")).where("df > 1").select("token", (-F.col("m")["minus"]).alias("a"), F.col("m")["weight"].alias("w"))
    pairs = lists.join(first, "token").where("a != id").groupBy("id", "a").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"))
    return pairs.groupBy("id").agg(F.max(F.struct("n", "w", "a")).alias("m")).select(F.col("m")["a"].alias("a"), F.col("id").alias("b"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar: 100 * intersection >= LEAST * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= LEAST * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the documents in ``ids``: a filter of bounded size picks them where they are read, a join removes what it let through."""
    spark = docs.sparkSession
    n = ids.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(bits, bool)
        for b in batches:
            hit[mix(b.column("id").to_numpy().astype(np.uint64)) % np.uint64(bits)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(hit).tobytes()], pa.binary())], ["bits"])

    wanted = np.zeros(bits // 8, np.uint8)
    for r in ids.coalesce(8).mapInArrow(marks, "bits binary").toLocalIterator():
        wanted |= np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.unpackbits(shared.value).astype(bool)
        for whole in batches:
            known = whole.filter(pc.is_valid(whole.column("id")))
            some = known.filter(pa.array(hit[mix(known.column("id").to_numpy().astype(np.uint64)) % np.uint64(bits)], pa.bool_()))
            for batch in slices(some, "text"):
                _, sets = shingles(texts_of(batch, "text"))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["id", "set"])

    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return saved(lean.mapInArrow(run, "id bigint, set binary").join(ids, "id", "left_semi"), "sets")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least id that each node reaches. Labels flow along edges and jump to their label's label until none changes."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = label.join(near, "id").select("id", "root", F.least("root", "near").alias("next"))
        jump = step.join(label.select(F.col("id").alias("next"), F.col("root").alias("far")), "next", "left")
        new = saved(jump.select("id", F.col("root").alias("was"), F.least("next", F.coalesce("far", "next")).alias("root")), "labels")
        if new.where("was != root").isEmpty():
            return nodes.join(new.drop("was"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        label = new.drop("was")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(id, shared): for each of PARTS parts of the hash range, how many shingles of the set are also in a set of another component (root).

    The intersection with any of those is at most the sum of the smaller numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "set"):
                each = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column("set")]
                size = [len(x) for x in each]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(c).to_numpy(), size)) for c in ("id", "root")] + [pa.array(np.concatenate(each))], ["id", "root", "shingle"])

    each = sets.mapInArrow(run, "id bigint, root bigint, shingle bigint")
    apart = saved(each.groupBy("shingle").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("shingle"), "apart")
    part = F.shiftrightunsigned("shingle", 5).bitwiseAND(F.lit(PARTS - 1)).cast("smallint")
    found = each.join(apart, "shingle").groupBy("id").agg(F.collect_list(part).alias("parts"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = [np.bincount(x.values.to_numpy(), minlength=PARTS).astype("<u4").tobytes() for x in b.column("parts")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pc.list_value_length(b.column("parts")).cast(pa.int64()), pa.array(size, pa.binary())], ["id", "all", "shared"])

    return found.mapInArrow(counted, "id bigint, all bigint, shared binary")


def long_signatures(sets: DataFrame) -> DataFrame:
    """(id, sig): the lowest bytes of COORDINATES least values; equal values have equal bytes, so none that agree are missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = multipliers(COORDINATES)
        for b in batches:
            sig = [signature(np.frombuffer(x.as_buffer(), "<u8"), odd).astype(np.uint8).tobytes() for x in b.column("set")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sig, pa.binary())], ["id", "sig"])

    return sets.mapInArrow(run, "id bigint, sig binary")


def remaining(posted: DataFrame, classes: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of classes in one list, still in different components, that may be similar.

    Lists whose members are all in one component need nothing more. In the others, blocks of members are compared inside a
    task; a list longer than a block is spread over pairs of blocks. A pair comes out if its sizes fit, if their
    shingles that are in sets of other components are many enough in each part of the hash range, and if MATCHES coordinates
    agree; of the lists that a pair has in common, the one with the least token gives it.
    """
    lists = posted.select("id", F.explode("tokens").alias("token"))
    open_lists = lists.join(roots, "id").groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m")).where("r0 != r1")
    few = open_lists.select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    members = saved(lists.join(few, "token").join(roots, "id").select("token", "id", "root", "blocks", part.alias("part")), "members")
    sets = sets.join(members.select("id", "root").distinct(), "id")
    able = shared_sizes(sets)
    able = able.join(classes.select("id", "n"), "id").where(F.col("all") * 100 >= F.col("n") * LEAST).drop("all")
    facts = saved(long_signatures(sets).join(able, "id").join(posted.select("id", "tokens"), "id"), "facts")
    # block i meets every block j >= i once; a member of block p goes to (p, j) for j >= p and to (i, p) for i < p
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = members.join(facts.select("id"), "id").select("token", "id", "root", "part", other.alias("o"))
    ready = cells.select("token", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "id", "root").join(facts, "id")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        ids, root, part, n = (table.column(c).to_numpy() for c in ("id", "root", "part", "n"))
        shared = np.frombuffer(b"".join(table.column("shared").to_pylist()), "<u4").reshape(len(ids), -1)
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
        token, tokens = key[0].as_py(), table.column("tokens").combine_chunks()
        size = np.diff(tokens.offsets.to_numpy())
        grid = np.full((len(ids), size.max(initial=1)), np.iinfo(np.int64).min)  # a number that is no token
        grid[np.arange(grid.shape[1]) < size[:, None]] = tokens.flatten().to_numpy()
        a, b = [], []
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        if (root == root[0]).all():
            left = left[:0]
        for x in left:
            y = right[(root[right] != root[x]) & (100 * np.minimum(n[right], n[x]) >= LEAST * np.maximum(n[right], n[x]))]
            if i == j:
                y = y[y > x]
            if len(y):
                most = np.minimum(shared[y], shared[x]).sum(1, dtype=np.int64)
                y = y[100 * most >= LEAST * (n[y] + n[x] - most)]
            if len(y):
                y = y[(sig[y] == sig[x]).sum(1) >= MATCHES]
                common = np.isin(grid[y], grid[x, : size[x]])
                y = y[np.where(common, grid[y], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max) == token]
                a.extend([ids[x]] * len(y))
                b.extend(ids[y])
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return ready.groupBy("token", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Words are runs of other than white space after lower-casing A-Z; a set holds the distinct five-word shingles, or the
    whole sequence where there are fewer words. Documents without words (null, empty, blank) have empty sets and link
    with nothing. Pairs with 100 * intersection >= 75 * union are linked, directly or over others: component_id is the
    least id reachable, kept marks it. Equal word sequences are one class from the start, which carries the least id.
    A row with a null id links with nothing and gets null for component_id and kept; rows that repeat an id and its text are
    alike; where an id repeats with different texts, one of them stands for it. Other columns are not read. An empty
    table gives no rows.

    A first round verifies each posted class with one leader, which joins most of a group of copies by as many pairs as it
    has members. A second verifies what the signatures still allow between different components. Links are always
    confirmed on whole sets.
    """
    rows = signatures(docs, id_col, text_col)
    known = rows.where("id IS NOT NULL AND n > 0")
    reps = saved(known.groupBy("words").agg(F.min("id").alias("rep")), "reps")
    first = known.join(reps, "words").where("id = rep").groupBy("id").agg(F.max(F.struct("words", "n", "sig")).alias("c"))
    classes = saved(first.select("id", "c.n", "c.sig"), "classes")
    posted = saved(prefixes(classes), "posted")
    nodes = posted.select("id")
    sets = shingle_sets(docs, nodes, id_col, text_col)
    links = saved(confirmed(leaders(posted), sets), "links")
    roots = saved(components(nodes, links), "roots")
    more = saved(remaining(posted, classes, roots, sets), "more")
    if not more.isEmpty():
        roots = saved(components(nodes, links.unionByName(confirmed(more, sets))), "roots")
    words = reps.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("words", F.coalesce("root", "rep").alias("component_id"))
    out = rows.join(words, "words", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is its component's, with all their columns. Rows without an id stay."""
    out = near_duplicates(docs, id_col, text_col)
    name = free(docs, "gone_id")
    gone = saved(out.where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
