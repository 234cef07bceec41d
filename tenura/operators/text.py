"""Personal data, query logs, conversations, response scoring and vector similarity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.config import MASK_TOKEN, PII_FIELDS
from tenura.errors import DataError
from tenura.functions import as_ts, minus_days, round_dec, safe_div
from tenura.functions import text as tx
from tenura.operators.similar import top_similar  # noqa: F401
from tenura.session import checkpointed


def mask_column(df: DataFrame, col: str, token: str = MASK_TOKEN) -> DataFrame:
    return df.withColumn(col, tx.mask_text(F.col(col), token))


def mask_fields(df: DataFrame, fields: Sequence[str] = tuple(PII_FIELDS), token: str = MASK_TOKEN) -> DataFrame:
    """Replace whole columns; absent columns are ignored."""
    return df.withColumns({c: F.lit(token) for c in fields if c in df.columns})


def check_output(df: DataFrame, col: str, token: str = MASK_TOKEN) -> DataFrame:
    """Leak types found in an output text, and the text with every leak masked."""
    return df.withColumns({"leaks": tx.leak_types(F.col(col)), "clean_text": tx.mask_text(F.col(col), token)})


def flag_leaks(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("pii_leaked", tx.leaks(F.col(col)))


def audit_sql(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("rule", tx.sql_rule(F.col(col))).withColumn("allowed", F.col("rule").isNull())


def cap_rows(df: DataFrame, order_by: Sequence[str], n: int = 1000) -> DataFrame:
    """The row limit of any result shown to a reader, in a stated order."""
    return df.orderBy(*order_by).limit(n)


def confidence_gate(df: DataFrame, fallback: str, col: str = "confidence", threshold: float = 0.6) -> DataFrame:
    low = F.col(col) < threshold
    return df.withColumns({"is_confident": ~low, "fallback": F.when(low, F.lit(fallback))})


def classify_intent(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_i", tx.intent(F.col(col))).select("*", "_i.*").drop("_i")


def extract_member_id(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("found_member_id", tx.member_id_in(F.col(col)))


def last_messages(log: DataFrame, session: str, order: str, n: int = 10) -> DataFrame:
    """Last ``n`` messages of every session, numbered oldest first.

    The rank filter lets every task keep at most ``n`` rows per session before the shuffle, so a
    session with very many messages stays cheap.
    """
    newest = Window.partitionBy(session).orderBy(F.desc(order))
    kept = log.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    size = Window.partitionBy(session)
    return kept.withColumn("position", (F.max("_r").over(size) - F.col("_r") + 1).cast("bigint")).drop("_r")


# ---- similarity (top_similar is in ``similar``) ---------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns of the same row."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, by: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group: one partial average per position, never all vectors of a group."""
    long = df.select(by, F.posexplode(vec).alias("_pos", "_x"))
    means = long.groupBy(by, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    entries = F.array_sort(F.collect_list(F.struct("_pos", "_m")))
    return means.groupBy(by).agg(F.transform(entries, lambda e: e["_m"]).alias(vec))


# ---- memory ----------------------------------------------------------------------------------


def memory_rows(messages: DataFrame, session: str, content: str, metadata: Sequence[str], created: Column, kind: str) -> DataFrame:
    """Rows of the memory table: session, text, JSON metadata, type and time."""
    return messages.select(F.col(session).alias("session_id"), F.col(content).alias("content"),
                           F.to_json(F.struct(*metadata)).alias("metadata"), F.lit(kind).alias("memory_type"), created.alias("created_at"))


def store_memory(rows: DataFrame, path: str, buckets: int = 16) -> None:
    """Append rows in partitions by type and by a hash of the session, so that all rows of a session of one type lie in one partition."""
    bucket = F.pmod(F.crc32(F.col("session_id").cast("string").cast("binary")), F.lit(buckets)).cast("int")
    rows.withColumn("session_bucket", bucket).write.mode("append").partitionBy("memory_type", "session_bucket").parquet(path)


def erase_in_store(spark, path: str, sessions: DataFrame, buckets: int = 16) -> DataFrame:
    """Delete all rows of the listed sessions from a stored memory table; gives (session_id, deleted) of those that had any.

    Only partitions that hold a listed session are read and written again (dynamic partition overwrite); all others keep their
    files. The rows that stay are written to the shared folder first, as a table cannot be replaced while it is read. A
    partition left without rows is removed.
    """
    parts = ["memory_type", "session_bucket"]
    listed = checkpointed(sessions.select(F.col("session_id").cast("string").alias("_s")).where("_s is not null").distinct())
    bucket = F.pmod(F.crc32(F.col("_s").cast("binary")), F.lit(buckets)).cast("int")
    places = [r[0] for r in listed.select(bucket).distinct().collect()]  # at most ``buckets`` numbers, so that whole folders drop out of the scan
    memory = spark.read.parquet(path)
    touched = memory.where(F.col("session_bucket").isin(places))
    own = F.col("session_id").cast("string") == F.col("_s")
    deleted = checkpointed(touched.join(listed, own, "left_semi").groupBy("session_id", *parts).agg(F.count("*").alias("n")))
    hit = deleted.select(*parts).distinct().collect()  # partitions, at most types times buckets
    if hit:
        where = reduce(lambda a, b: a | b, [F.col(parts[0]).eqNullSafe(F.lit(r[0])) & F.col(parts[1]).eqNullSafe(F.lit(r[1])) for r in hit])
        stay = checkpointed(memory.where(where).join(listed, own, "left_anti"))
        left = {tuple(r) for r in stay.select(*parts).distinct().collect()}
        stay.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
        for r in hit:
            if tuple(r) not in left:
                folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{parts[0]}={r[0]}/{parts[1]}={r[1]}")
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return deleted.groupBy("session_id").agg(F.sum("n").alias("deleted"))


def erase_sessions(memory: DataFrame, sessions: DataFrame, key: str = "session_id") -> tuple[DataFrame, DataFrame]:
    """Rows that stay after erasing the listed sessions, and deleted counts per session.

    The counts are taken per session before the join with the list.
    """
    listed = sessions.select(key).distinct()
    counts = memory.groupBy(key).agg(F.count("*").alias("deleted"))
    return memory.join(listed, key, "left_anti"), counts.join(listed, key, "left_semi")


def retain(log: DataFrame, ts: str, ref, days: int = 90) -> DataFrame:
    """Audit rows at most ``days`` old; on a date-partitioned table whole partitions drop out."""
    return log.filter(F.col(ts) >= minus_days(ref, days))


# ---- response scoring ------------------------------------------------------------------------


def score_responses(log: DataFrame) -> DataFrame:
    """Per response: success, tool accuracy and leak.

    Needs ``answer``, ``expected_contains``, ``expected_tools`` and ``actual_tools`` (arrays).
    """
    answer = F.lower(F.coalesce("answer", F.lit("")))
    wanted = F.coalesce("expected_contains", F.array().cast("array<string>"))
    blank = F.length(F.regexp_replace(answer, r"\s+", "")) > 0
    success = F.when(F.size(wanted) == 0, blank).otherwise(F.forall(wanted, lambda w: F.contains(answer, F.lower(w))))
    tools = F.array_distinct(F.coalesce("expected_tools", F.array().cast("array<string>")))
    right = F.size(F.array_intersect(tools, F.coalesce("actual_tools", F.array().cast("array<string>"))))
    accuracy = F.when(F.size(tools) == 0, 1.0).otherwise(right / F.size(tools))
    return log.withColumns({"task_success": success, "tool_accuracy": accuracy,
                            "pii_leaked": F.coalesce(tx.leaks(F.col("answer")), F.lit(False))})


def evaluate_responses(scored: DataFrame, success: float = 0.7, leak: float = 0.0, latency_s: float = 15.0) -> DataFrame:
    """Rates overall (category null) and per category, with the verdict against the limits.

    With columns ``grounding`` (see ``grounding``) and ``tokens`` also the mean grounding of the responses that state numbers, and the mean tokens.
    """
    one = lambda c: round_dec(F.avg(F.col(c).cast("double")), 6)
    agg = scored.groupingSets([[], ["category"]], "category").agg(
        F.grouping("category").alias("_g"), F.count("*").alias("n_scenarios"),
        round_dec(F.avg(F.col("task_success").cast("int").cast("double")), 6).alias("task_success_rate"),
        one("tool_accuracy").alias("tool_selection_accuracy"), one("latency_ms").alias("avg_latency"),
        round_dec(F.avg(F.col("pii_leaked").cast("int").cast("double")), 6).alias("pii_leak_rate"))
    more = {"grounding": "factual_grounding_rate", "tokens": "avg_tokens_per_query"}
    extra = [c for c in more if c in scored.columns]
    if extra:
        also = scored.groupingSets([[], ["category"]], "category").agg(F.grouping("category").alias("_g"), *[one(c).alias(more[c]) for c in extra])
        agg = agg.join(also.withColumnRenamed("category", "_c").withColumnRenamed("_g", "_h"), (F.col("_g") == F.col("_h")) & F.col("category").eqNullSafe(F.col("_c"))).drop("_c", "_h")
    ok = (F.col("task_success_rate") >= success) & (F.col("pii_leak_rate") <= leak) & (F.col("avg_latency") <= latency_s * 1000)
    scope = F.when(F.col("_g") == 1, F.lit("overall")).otherwise(F.lit("category"))
    return agg.select(scope.alias("scope"), "category", "n_scenarios", "task_success_rate", "tool_selection_accuracy",
                      "avg_latency", "pii_leak_rate", *[more[c] for c in extra], ok.alias("passed"))


def member_profiles(df: DataFrame, fields: Sequence[str] = tuple(PII_FIELDS), token: str = MASK_TOKEN) -> DataFrame:
    """Profile rows safe to show: listed columns masked, and every other text masked by pattern."""
    masked = mask_fields(df, fields, token)
    texts = [c for c, k in masked.dtypes if k == "string" and c not in fields]
    return masked.withColumns({c: tx.mask_text(F.col(c), token) for c in texts})


def grounding(log: DataFrame, response: str = "response", results: str = "tool_results") -> DataFrame:
    """Share of the distinct numbers in a response that occur in its tool results (null without numbers)."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(tx.NUMBER), F.lit(0)))
    said = numbers(response)
    known = F.size(said) - F.size(F.array_except(said, numbers(results)))
    return log.withColumn("grounding", safe_div(known, F.nullif(F.size(said), F.lit(0))))
