import numpy as np
import pytest
from pyspark.sql import functions as F

from tenura.functions import text as tx
from tenura.operators import similar, text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize("raw,tokens", [
    ("id 123.456.789-01 here", 1), ("id 12345678901", 1), ("mail a.b@mail.corp.example.com now", 1), ("call (11) 98765-4321", 1),
    ("123.456.789-01, x@y.io and (21) 3333-4444", 3), ("nothing to see", 0)])
def test_masking(spark, raw, tokens):
    assert one(spark, raw, tx.mask_text).count("[REDACTED]") == tokens


def test_token_is_literal(spark):
    assert one(spark, "x@y.io", lambda c: tx.mask_text(c, r"$1\n")) == r"$1\n"


def test_name_pattern_ignores_case(spark):
    assert one(spark, "name: foo bar", tx.leaks) and not one(spark, "a name", tx.leaks)


@pytest.mark.parametrize("sql,rule", [
    ("select 1", None), ("  WITH a AS (SELECT 1) SELECT * FROM a", None), ("SELECT * FROM (SELECT 1) x", None),
    ("drop table x", "sql_safety: DROP TABLE"), ("update m set a = 1", "sql_safety: UPDATE.*SET"), ("TRUNCATE x", "sql_readonly"),
    ("CREATE TABLE x (a int)", "sql_readonly"), ("SELECT 1; DELETE FROM x", "sql_safety: DELETE FROM")])
def test_sql_gate(spark, sql, rule):
    assert one(spark, sql, tx.sql_rule) == rule


def test_confidence_equal_to_the_threshold_passes(spark):
    df = spark.createDataFrame([(0.6,), (0.59,)], "confidence double")
    assert [r["is_confident"] for r in text.confidence_gate(df, "no").collect()] == [True, False]


@pytest.mark.parametrize("q,kind", [("What should we do, and why?", "prescriptive"), ("Why did it fall", "diagnostic"),
                                    ("How many are there", "factual"), ("Hello", "conversational")])
def test_intent_precedence(spark, q, kind):
    assert one(spark, q, tx.intent)["query_type"] == kind


@pytest.mark.parametrize("q,found", [("member MEM_12 please", "MEM_12"), ("Member_ID: ab-9", "ab-9"), ("about mem_77", "mem_77"), ("no one", None)])
def test_member_id(spark, q, found):
    assert one(spark, q, tx.member_id_in) == found


def test_top_similar_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8)).astype(np.float32)
    vecs = np.concatenate([base, base[:20]])  # exact copies make ties
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base[:3])], "query_id long, embedding array<float>")
    got = {}
    for r in text.top_similar(corpus, queries, 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for q in range(3):
        sims = np.round(unit.astype(float) @ unit[q].astype(float), 6)
        want = sorted(range(len(vecs)), key=lambda i: (-sims[i], i))[:4]
        assert [i for _, i in sorted(got[q])] == want


def test_query_blocks_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    corpus = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "vec_id long, embedding array<double>")
    queries = corpus.limit(9).withColumnRenamed("vec_id", "query_id")
    rows = lambda: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in text.top_similar(corpus, queries, 3).collect())
    whole = rows()
    monkeypatch.setattr(similar, "VALUES", 20)  # both sides are cut into many parts
    assert rows() == whole


def brute_similar(corpus, queries, k):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1.0)
    out = []
    for q, v in queries:
        sims = sorted((-round(float(unit(v) @ unit(x)), 9), i) for i, x in corpus)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sims)]
    return sorted(out)


def test_index_finds_neighbours_and_exact_mode_is_exact(spark):
    """Clustered vectors: few buckets hold the neighbours; found similarities are exact, recall is measured against the exact way."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.15 * rng.normal(size=24)).tolist()) for i in range(1200)] + [(5000, [0.0] * 24), (5001, None), (5002, []), (5003, [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    asked = [(f"q{i}", rows[i][1]) for i in range(0, 1200, 37)]
    queries = spark.createDataFrame([*asked, ("none", None)], "query_id string, embedding array<double>")
    exact = similar.top_similar(corpus, queries, 10)
    want = brute_similar([r for r in rows if r[1] is not None and len(r[1]) == 24], asked, 10)
    assert [(a, b, c) for a, b, c, _ in sorted((r["query_id"], r["rank"], r["vec_id"], r["similarity"]) for r in exact.collect())] == [w[:3] for w in want]
    found = similar.top_similar(corpus, queries, 10, index=similar.Hyperplanes(tables=3, bits=8, probes=24))
    got = similar.recall(exact, found).first()
    assert got["queries"] == len(asked) and got["recall"] >= 0.9
    known = {(w[0], w[2]): w[3] for w in want}
    assert all(abs(known[r["query_id"], r["vec_id"]] - r["similarity"]) < 1e-9 for r in found.collect() if (r["query_id"], r["vec_id"]) in known)
    whole = similar.top_similar(corpus, queries, 10, index=similar.Hyperplanes(tables=1, bits=4, probes=16))  # every bucket: as good as exact
    assert similar.recall(exact, whole).first()["recall"] == 1.0


def test_probes_come_in_the_order_of_their_cost():
    h = similar.Hyperplanes(tables=2, bits=5, probes=6)
    x = np.random.default_rng(1).normal(size=(20, 7))
    own, probed, sides = h.buckets(x), h.probed(x), h.sides(x)
    for i in range(20):
        for t in range(2):
            cost = lambda b: sum(abs(sides[i, t, k]) for k in range(5) if (b ^ own[i, t]) >> k & 1)  # noqa: B023, E731
            assert own[i, t] in probed[i, t] and len(set(probed[i, t])) == 6
            assert max(cost(b) for b in probed[i, t]) <= min(cost(b) for b in range(32) if b not in probed[i, t]) + 1e-12


def test_erasure_rewrites_only_the_partitions_it_must(spark, tmp_path):
    path = str(tmp_path / "memory")
    rows = [(f"s{i % 40}", f"text {i}", "chat" if i % 3 else "note") for i in range(400)]
    df = spark.createDataFrame(rows, "session_id string, content string, memory_type string")
    text.store_memory(df, path, 8)
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "memory").rglob("*.parquet")}
    before = files()
    gone = spark.createDataFrame([("s3",), ("s11",), ("nobody",), (None,)], "session_id string")
    counts = {r["session_id"]: r["deleted"] for r in text.erase_in_store(spark, path, gone, 8).collect()}
    assert counts == {"s3": 10, "s11": 10}
    after = files()
    kept = {(r["session_id"], r["content"], r["memory_type"]) for r in spark.read.parquet(path).collect()}
    assert kept == {r for r in rows if r[0] not in ("s3", "s11")}
    folder = lambda f: f.rsplit("/", 1)[0]
    import zlib
    hit = {f"memory_type={t}/session_bucket={zlib.crc32(s.encode()) % 8}" for s in ("s3", "s11") for t in ("chat", "note")}
    assert {f for f in before if folder(f) not in hit} == {f for f in after if folder(f) not in hit}
    assert all(before[f] == after[f] for f in after if folder(f) not in hit) and not set(before) & {f for f in after if folder(f) in hit}


def test_a_partition_that_empties_goes(spark, tmp_path):
    path = str(tmp_path / "memory")
    text.store_memory(spark.createDataFrame([("a", "x", "chat"), ("b", "y", "chat")], "session_id string, content string, memory_type string"), path, 64)
    text.erase_in_store(spark, path, spark.createDataFrame([("a",)], "session_id string"), 64)
    assert [r["content"] for r in spark.read.parquet(path).collect()] == ["y"]
    assert text.erase_in_store(spark, path, spark.createDataFrame([("zz",)], "session_id string"), 64).count() == 0


def test_last_messages_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("s"), F.col("id").alias("turn"))
    plan = text.last_messages(df, "s", "turn", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.rindex("Exchange hashpartitioning")


def test_blank_answers_and_empty_expectations(spark):
    df = spark.createDataFrame([("  ", [], [], ["x"]), ("ok", [], ["a"], ["a", "b"]), ("Big Gym", ["gym"], ["a", "b"], ["b"])],
                               "answer string, expected_contains array<string>, expected_tools array<string>, actual_tools array<string>")
    got = [(r["task_success"], r["tool_accuracy"]) for r in text.score_responses(df).collect()]
    assert got == [(False, 1.0), (True, 1.0), (True, 0.5)]
