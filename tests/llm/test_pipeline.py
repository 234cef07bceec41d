"""The registered queries against their SQL, and the pipeline's stages against brute force."""

import collections
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from check import rows_of
from tenura.llm import decontam, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_registered_queries_are_whole():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) for n in range(1, 11)] == [1] * 10


def test_stages_equal_brute_force(spark):
    from tests_support import brute_components, low

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for d in list(texts):
        if not re.search(r"[^\W\d_]", texts[d] or ""):
            del texts[d]
    last = {}
    for d in sorted(texts):
        last[low(texts[d])] = d
    texts = {d: texts[d] for d in last.values()}
    near = brute_components(texts)
    texts = {d: t for d, t in texts.items() if near[d][1] == d}
    items = [decontam.normal(r.text)[1:-1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {d for d, t in texts.items() if any(i in decontam.normal(t) for i in items)}
    got = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in got}
    assert kept <= set(texts) - exact and len(kept) >= len(texts) - 2 * len(exact) - 2
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, "the same of the and that", "en", 1.5), (2, "THE same of the and that", None, None), (3, None, "en", 0.0), (4, "", "en", 0.0), (5, "12 !", "de", 0.0), (6, "the " * 20_000, "en", 1.0), (None, "no id at all here", "en", 2.0), (6, "the " * 20_000, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, language string, contaminated double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 2, 6]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 22
