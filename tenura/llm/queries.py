"""One query per operator over its whole table, and SQL where it can say the same. ``register`` adds them to the library's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import chat, chunks, decontam, exact, fim, html, kneser, langid, metric, near, pack, toxic, whiten
from tenura.llm.common import fold

VOCABULARY = "byte_bpe_50k.json"
NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string"))
    out = chat.format_chat(rows)
    turns, loss = chat.read_turns(F.col("formatted")), chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return out.select("conv_id", turns.alias("t"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP1_SQL = r"""WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before,
    regexp_replace(text, '([<\[])(\\*)(s>|/s>|AND\]|ROLE\]|/ROLE\]|INST\]|/INST\]|SYS\])', '\1\\\2\3', 'g') AS safe
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(safe) + CASE WHEN k > 1 AND before = role THEN 5 ELSE 4 + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 5
    ELSE 13 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|AND\]|ROLE\]|/ROLE\]|INST\]|/INST\]|SYS\])', '\1\\\2\3', 'g')) END END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack.token_pieces(table(spark, sf_dir, "documents"), vocabulary())
    out = pack.assign(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    docs = table(spark, sf_dir, "documents")
    return langid.fit(docs.where(fold("doc_id", 3) != 1))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "text")
    out = langid.label(seen, language_model(spark, sf_dir))
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(table(spark, sf_dir, "documents"))


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    out = kneser.score(docs, kneser.fit(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = html.extract(pages.select("page_id", "url", "html"), html.learn(pages), out="text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    model = toxic.fit(docs, labels.where(~held_out))
    out = toxic.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, out="score")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({NORM}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
c AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.to_id)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(to_id) AS component_id, c.doc_id = min(to_id) AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id"""


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = f"""WITH t AS (SELECT doc_id, sha256({NORM}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)"""


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric.jaccard_classes(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({NORM}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
c AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.to_id)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(to_id) AS component_id
FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten.whiten(table(spark, sf_dir, "embeddings"))
    # the exact sum grows with n^2 and may pass 64 bits: its digits are always there
    return out.withColumns({"deviation_digits": F.col("deviation").cast("string"), "deviation": F.col("deviation").try_cast("bigint")})


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fim.restore(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


OP13_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM t),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM u),
c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR k[3] % 100 >= 50 THEN 'plain' WHEN k[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_main_text": op6_main_text,
    "op7_toxicity": op7_toxicity,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_fill_in_middle": op13_fill_in_middle,
}
SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op8_minhash_near_dedup": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_jaccard_join": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
