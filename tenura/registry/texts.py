"""Personal data, query logs, conversations, responses and vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tenura.config import BLOCKED_SQL
from tenura.functions import text as tx
from tenura.operators import similar, text
from tenura.registry.base import M360, VIS, ACT, R, member_360, query
from tenura.session import checkpointed, scratch_folder
from tenura.sources import catalog

NAME_SQL = tx.NAME.replace("(?iu)", "(?i)")


def masked(col: str) -> str:
    for p in (tx.NATIONAL_ID, tx.EMAIL, tx.PHONE):
        col = f"regexp_replace({col}, '{p}', '[REDACTED]', 'g')"
    return col


def has(col: str, p: str) -> str:
    return f"regexp_matches({col}, '{p}')"


def documents(t):
    return catalog.spread(t.base("documents").select("doc_id", "text"))


@query("txt1_mask_text", f"SELECT doc_id, {masked('text')} AS text FROM documents")
def _(t):
    return text.mask_column(documents(t), "text")


@query("txt2_mask_columns", "SELECT member_id, location_id, plan_type, '[REDACTED]' AS name FROM members")
def _(t):
    return text.mask_fields(t.members.select("member_id", "location_id", "plan_type", "name"), ["name", "cpf"])


@query("txt3_check_output", f"""SELECT doc_id, concat_ws(',', CASE WHEN {has('text', tx.NATIONAL_ID)} THEN 'cpf' END, CASE WHEN {has('text', tx.EMAIL)} THEN 'email' END,
CASE WHEN {has('text', tx.PHONE)} THEN 'phone' END) AS leaks, {masked('text')} AS clean_text FROM documents""")
def _(t):
    out = text.check_output(documents(t), "text")
    return out.select("doc_id", F.array_join("leaks", ",").alias("leaks"), "clean_text")


@query("txt4_leak_flag", f"SELECT doc_id, {has('text', tx.NATIONAL_ID)} OR {has('text', tx.EMAIL)} OR {has('text', tx.PHONE)} OR {has('text', NAME_SQL)} AS pii_leaked FROM documents")
def _(t):
    return text.flag_leaks(documents(t), "text").drop("text")


# A query log written from the event stream.
SQL_LOG = """sqllog AS (SELECT event_id, CASE event_type WHEN 'click' THEN '  select count(*) from visits where member_id = ' || CAST(user_id AS VARCHAR)
  WHEN 'view' THEN 'with m as (select * from members) select * from m' WHEN 'error' THEN 'drop table members_' || CAST(user_id AS VARCHAR)
  WHEN 'purchase' THEN 'Update members set location_id = ' || CAST(user_id AS VARCHAR) ELSE 'truncate visits' END AS q FROM events)"""


def sql_log(t):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    return t.base("events").select("event_id", F.when(kind == "click", F.concat(F.lit("  select count(*) from visits where member_id = "), user))
                                   .when(kind == "view", "with m as (select * from members) select * from m")
                                   .when(kind == "error", F.concat(F.lit("drop table members_"), user))
                                   .when(kind == "purchase", F.concat(F.lit("Update members set location_id = "), user)).otherwise("truncate visits").alias("q"))


RULE = "CASE " + " ".join(f"WHEN regexp_matches(upper(trim(q)), '{p}') THEN 'sql_safety: {p}'" for p in BLOCKED_SQL) + \
    " WHEN NOT (upper(trim(q)) LIKE 'SELECT%' OR upper(trim(q)) LIKE 'WITH%') THEN 'sql_readonly' END"


@query("txt5_audit_sql", f"SELECT event_id, {RULE} AS rule, {RULE} IS NULL AS allowed FROM sqllog", SQL_LOG)
def _(t):
    return text.audit_sql(sql_log(t), "q").drop("q")


@query("txt6_row_cap", "SELECT member_id, tenure_days, visit_count_30d FROM m360 ORDER BY tenure_days DESC, member_id LIMIT 1000", VIS, ACT, M360)
def _(t):
    return text.cap_rows(member_360(t).select("member_id", "tenure_days", "visit_count_30d"), [F.desc("tenure_days"), "member_id"])


@query("txt7_confidence_gate", "SELECT member_id, churn_probability, churn_probability >= 0.6 AS is_confident, CASE WHEN churn_probability < 0.6 THEN 'not sure' END AS fallback FROM scored")
def _(t):
    return text.confidence_gate(t.scored, "not sure", "churn_probability")


def intent_sql(col: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({col}), {chr(39)}{w}{chr(39)})' for w in ws)} THEN {{{i}}}" for i, (_, _, ws) in enumerate(tx.INTENTS))
    names = "CASE " + cases.format(*[f"'{n}'" for n, _, _ in tx.INTENTS]) + " ELSE 'conversational' END"
    conf = "CASE " + cases.format(*[f"CAST({c} AS DOUBLE)" for _, c, _ in tx.INTENTS]) + " ELSE CAST(0.6 AS DOUBLE) END"
    return f"{names} AS query_type, {conf} AS confidence"


@query("txt8_intent", f"SELECT conv_id, turn, {intent_sql('text')} FROM conversations")
def _(t):
    return text.classify_intent(t.base("conversations"), "text").select("conv_id", "turn", "query_type", "confidence")


@query("txt8_intent_documents", f"SELECT doc_id, {intent_sql('text')} FROM documents")
def _(t):
    return text.classify_intent(documents(t), "text").select("doc_id", "query_type", "confidence")


MENTION = """mention AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Status of Member_ID: M-' || user_id || ' please' WHEN 'view' THEN 'see mem_' || user_id || '!'
  WHEN 'error' THEN 'member ' || user_id ELSE 'no id in here ' || user_id END AS q FROM events)"""


@query("txt9_member_id", r"""SELECT event_id, COALESCE(NULLIF(regexp_extract(q, '(?i)member[_\s]?(?:id)?[:\s]+([A-Za-z0-9_-]+)', 1), ''), NULLIF(regexp_extract(q, '(?i)(mem_[0-9]+)', 1), '')) AS found_member_id FROM mention""", MENTION)
def _(t):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    q = (F.when(kind == "click", F.concat(F.lit("Status of Member_ID: M-"), user, F.lit(" please"))).when(kind == "view", F.concat(F.lit("see mem_"), user, F.lit("!")))
         .when(kind == "error", F.concat(F.lit("member "), user)).otherwise(F.concat(F.lit("no id in here "), user)))
    return text.extract_member_id(t.base("events").select("event_id", q.alias("q")), "q").drop("q")


@query("txt10_last_messages", """SELECT conv_id, turn, role, text, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3""")
def _(t):
    return text.last_messages(t.base("conversations"), "conv_id", "turn", 3)


CENT = """cent AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY i) AS c FROM (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT UNNEST(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1),
sims AS (SELECT query_id, vec_id, label, ROUND(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 9) AS s FROM embeddings JOIN cent ON TRUE)"""


def label_queries(t):
    return text.centroids(t.base("embeddings"), "label").select(F.col("label").cast("bigint").alias("query_id"), F.col("label"), "embedding")


@query("txt11_top_similar", "SELECT query_id, vec_id, s AS similarity, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM sims) WHERE rank <= 5", CENT)
def _(t):
    return text.top_similar(t.base("embeddings"), label_queries(t), 5)


@query("txt11_top_similar_by_type", "SELECT query_id, vec_id, s AS similarity, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM sims WHERE label = query_id) WHERE rank <= 5", CENT)
def _(t):
    return text.top_similar(t.base("embeddings"), label_queries(t), 5, type_col="label")


HUNDREDTH = """nb AS (SELECT a.vec_id AS query_id, b.vec_id, ROUND(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS s
  FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
top AS (SELECT query_id, vec_id, s AS similarity, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM nb) WHERE rank <= 10)"""


def every_hundredth(t):
    """The stated query set: every row whose id is divisible by 100, against all rows."""
    e = t.base("embeddings")
    return e, e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")


@query("txt11_neighbours", "SELECT * FROM top", HUNDREDTH)
def _(t):
    return similar.top_similar(*every_hundredth(t), 10)


@query("txt11_index_recall", "SELECT COUNT(DISTINCT query_id) AS queries, 10::BIGINT AS k, TRUE AS recall_reached, TRUE AS similarities_exact FROM top", HUNDREDTH)
def _(t):
    exact = similar.top_similar(*every_hundredth(t), 10)
    found = checkpointed(similar.top_similar(*every_hundredth(t), 10, index=similar.Hyperplanes()))
    wrong = found.join(exact.select("query_id", "vec_id", F.col("similarity").alias("_s")), ["query_id", "vec_id"]).agg(F.count_if(F.col("similarity") != F.col("_s")).alias("wrong"))
    return similar.recall(exact, found).join(wrong, F.lit(True)).select("queries", F.lit(10).cast("bigint").alias("k"), (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("wrong") == 0).alias("similarities_exact"))


@query("txt12_similarity_threshold", f"SELECT vec_id, label, {R('s', 6)} AS similarity FROM sims WHERE label = query_id AND s >= 0.3", CENT)
def _(t):
    cents = label_queries(t).select("label", F.col("embedding").alias("c"))
    s = F.round(text.cosine(F.col("embedding"), F.col("c")), 9)
    from tenura.functions import round_dec
    return t.base("embeddings").join(cents, "label").withColumn("s", s).filter("s >= 0.3").select("vec_id", "label", round_dec(F.col("s"), 6).alias("similarity"))


@query("txt13_store_memory", "SELECT conv_id AS session_id, text AS content, turn, role, 'conversation' AS memory_type FROM conversations")
def _(t):
    path = scratch_folder(t.spark, "memory")
    rows = text.memory_rows(t.base("conversations"), "conv_id", "text", ["turn", "role"], F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), "conversation")
    text.store_memory(rows, path)
    meta = F.from_json("metadata", "turn bigint, role string")
    return t.spark.read.parquet(path).select("session_id", "content", meta["turn"].alias("turn"), meta["role"].alias("role"), "memory_type")


ERASED = "gone AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING MAX(length(text)) > 1500)"


def erased(t):
    conv = t.base("conversations")
    listed = conv.groupBy("conv_id").agg(F.max(F.length("text")).alias("n")).filter("n > 1500").select("conv_id")
    return text.erase_sessions(conv, listed, "conv_id")


@query("txt14_erase_sessions", "SELECT * FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone)", ERASED)
def _(t):
    return erased(t)[0]


@query("txt14_erased_counts", "SELECT conv_id, COUNT(*) AS deleted FROM conversations WHERE conv_id IN (SELECT conv_id FROM gone) GROUP BY 1", ERASED)
def _(t):
    return erased(t)[1]


@query("txt14_erase_in_store", "SELECT conv_id AS session_id, text AS content, role AS memory_type FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone)", ERASED)
def _(t):
    """The stored table after an erasure that replaced only the partitions it had to."""
    path, conv = scratch_folder(t.spark, "memory"), t.base("conversations")
    text.store_memory(conv.select(F.col("conv_id").alias("session_id"), F.col("text").alias("content"), F.col("role").alias("memory_type")), path)
    listed = conv.groupBy("conv_id").agg(F.max(F.length("text")).alias("n")).filter("n > 1500").select(F.col("conv_id").alias("session_id"))
    text.erase_in_store(t.spark, path, listed)
    return t.spark.read.parquet(path).select("session_id", "content", F.col("memory_type").cast("string").alias("memory_type"))


@query("txt15_retention", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'")
def _(t):
    return text.retain(t.base("events").select("event_id", "ts"), "ts", "2024-01-31 00:00:00", 10)


# A response log: an assistant turn answers the user turn before it.
RESP = """resp AS (SELECT a.conv_id, a.turn, a.text AS answer, list_filter(string_split(u.text, ' ')[1:2], lambda w: w <> '') AS expected_contains,
  CASE WHEN length(u.text) > 200 THEN ['query_member_data', 'compare_cohorts'] WHEN length(u.text) > 100 THEN ['get_churn_score'] ELSE [] END AS expected_tools,
  CASE WHEN length(a.text) > 400 THEN ['query_member_data', 'get_churn_score'] ELSE ['compare_cohorts'] END AS actual_tools,
  length(a.text) * 10 AS latency_ms, CASE WHEN length(u.text) > 150 THEN 'diagnostic' ELSE 'factual' END AS category
  FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant'),
rs AS (SELECT *, CASE WHEN len(expected_contains) = 0 THEN length(trim(answer)) > 0 ELSE len(list_filter(expected_contains, lambda w: NOT contains(lower(answer), lower(w)))) = 0 END AS task_success,
  CASE WHEN len(expected_tools) = 0 THEN 1.0::DOUBLE ELSE CAST(len(list_intersect(expected_tools, actual_tools)) AS DOUBLE) / len(expected_tools) END AS tool_accuracy,
  """ + f"{has('answer', tx.NATIONAL_ID)} OR {has('answer', tx.EMAIL)} OR {has('answer', tx.PHONE)} OR {has('answer', NAME_SQL)} AS pii_leaked FROM resp)"


def responses(t):
    conv = t.base("conversations")
    a = conv.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    n = F.length("asked")
    return a.join(u, ["conv_id", "turn"]).withColumns({
        "expected_contains": F.filter(F.slice(F.split("asked", " "), 1, 2), lambda w: w != ""),
        "expected_tools": F.when(n > 200, arr("query_member_data", "compare_cohorts")).when(n > 100, arr("get_churn_score")).otherwise(F.array().cast("array<string>")),
        "actual_tools": F.when(F.length("answer") > 400, arr("query_member_data", "get_churn_score")).otherwise(arr("compare_cohorts")),
        "latency_ms": F.length("answer") * 10, "category": F.when(n > 150, "diagnostic").otherwise("factual")})


@query("txt16_score_responses", f"SELECT conv_id, turn, task_success, {R('tool_accuracy', 6)} AS tool_accuracy, pii_leaked FROM rs", RESP)
def _(t):
    from tenura.functions import round_dec
    return text.score_responses(responses(t)).select("conv_id", "turn", "task_success", round_dec(F.col("tool_accuracy"), 6).alias("tool_accuracy"), "pii_leaked")


RATES = f"""COUNT(*) AS n_scenarios, {R("AVG(CAST(task_success AS DOUBLE))", 6)} AS task_success_rate, {R("AVG(tool_accuracy)", 6)} AS tool_selection_accuracy, {R("AVG(latency_ms)", 6)} AS avg_latency,
{R("AVG(CAST(pii_leaked AS DOUBLE))", 6)} AS pii_leak_rate"""


@query("txt17_evaluate_responses", f"""SELECT *, task_success_rate >= 0.7 AND pii_leak_rate <= 0 AND avg_latency <= 15000 AS passed FROM (SELECT 'category' AS scope, category, {RATES} FROM rs GROUP BY category
UNION ALL SELECT 'overall', NULL, {RATES} FROM rs)""", RESP)
def _(t):
    return text.evaluate_responses(text.score_responses(responses(t)))


MORE = RESP.replace("rs AS (SELECT *,", "rs AS (SELECT *, len(regexp_extract_all(answer, '[^ ]+')) AS tokens, CAST(len(list_intersect(list_distinct(regexp_extract_all(answer, '[0-9]+(?:\\.[0-9]+)?')), "
                    "list_distinct(regexp_extract_all(asked, '[0-9]+(?:\\.[0-9]+)?')))) AS DOUBLE) / NULLIF(len(list_distinct(regexp_extract_all(answer, '[0-9]+(?:\\.[0-9]+)?'))), 0) AS grounding,", 1).replace(
                    "a.text AS answer,", "a.text AS answer, u.text AS asked,", 1)
MORE_RATES = RATES + f""", {R("AVG(grounding)", 6)} AS factual_grounding_rate, {R("AVG(tokens)", 6)} AS avg_tokens_per_query"""


@query("txt17_evaluation_summary", f"""SELECT *, task_success_rate >= 0.7 AND pii_leak_rate <= 0 AND avg_latency <= 15000 AS passed FROM (SELECT 'category' AS scope, category, {MORE_RATES} FROM rs GROUP BY category
UNION ALL SELECT 'overall', NULL, {MORE_RATES} FROM rs)""", MORE)
def _(t):
    """With grounding (numbers of the answer that the question states) and tokens."""
    conv = t.base("conversations")
    asked = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    scored = text.score_responses(responses(t)).drop("asked").join(asked, ["conv_id", "turn"])
    known = text.grounding(scored, "answer", "asked").withColumn("tokens", F.size(F.regexp_extract_all("answer", F.lit("[^ ]+"), F.lit(0))))
    return text.evaluate_responses(known)


@query("txt18_member_profiles", f"SELECT member_id, location_id, plan_type, tenure_days, '[REDACTED]' AS member_name, {masked('note')} AS note FROM (SELECT *, 'call ' || CAST(11900000000 + member_id AS VARCHAR) || ' about ' || plan_type AS note FROM m360)", VIS, ACT, M360)
def _(t):
    df = member_360(t).select("member_id", "location_id", "plan_type", "tenure_days", F.col("name").alias("member_name"),
                              F.concat(F.lit("call "), (F.lit(11900000000) + F.col("member_id")).cast("string"), F.lit(" about "), F.col("plan_type")).alias("note"))
    return text.member_profiles(df)


@query("txt19_grounding", f"""SELECT event_type, COUNT(g) AS n, {R("AVG(g)", 6)} AS grounding_rate FROM (SELECT event_type, CAST(len(list_intersect(a, b)) AS DOUBLE) / NULLIF(len(a), 0) AS g FROM
(SELECT event_type, list_distinct(regexp_extract_all('user ' || user_id || ' has ' || (event_id % 100) || ' of 100', '[0-9]+(?:\\.[0-9]+)?')) AS a,
 list_distinct(regexp_extract_all(props || ' for ' || user_id, '[0-9]+(?:\\.[0-9]+)?')) AS b FROM events)) GROUP BY 1""")
def _(t):
    from tenura.functions import round_dec
    user = F.col("user_id").cast("string")
    log = t.base("events").select("event_type", F.concat(F.lit("user "), user, F.lit(" has "), (F.col("event_id") % 100).cast("string"), F.lit(" of 100")).alias("response"),
                                  F.concat(F.col("props"), F.lit(" for "), user).alias("tool_results"))
    return text.grounding(log).groupBy("event_type").agg(F.count("grounding").alias("n"), round_dec(F.avg("grounding"), 6).alias("grounding_rate"))
