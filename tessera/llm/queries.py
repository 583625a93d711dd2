"""The corpus operators applied to whole tables: one query for each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.chat import chat_format, chat_parse, unescaped
from tessera.llm.common import stored
from tessera.llm.embedding_join import near_vectors
from tessera.llm.html_text import extract_html
from tessera.llm.kneser_ney import score, train
from tessera.llm.kneser_ney_sql import OP1_SQL
from tessera.llm.packing import pack, with_tokens
from tessera.llm.passages import shared_passages
from tessera.llm.quality import quality_rules
from tessera.llm.quality_sql import OP2_SQL
from tessera.llm.repeats import remove_repeats
from tessera.llm.simhash import simhash_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 7 == 2, F.lit(True))
    model = train(docs.where(~held_out("doc_id")))
    return score(docs, model).select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        F.round("base_score", 6).alias("base_score"),
        F.round("score", 6).alias("score"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *(f"quality.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")),
    )


def op3_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


#: Pair by pair, which the whole tables of small scale factors bear.
OP3_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT reach.vec_id, pair.b FROM reach JOIN pair ON pair.a = reach.other
)
SELECT vec_id, (SELECT count(*) FROM pair WHERE pair.a = reach.vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reach GROUP BY vec_id
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = stored(with_tokens(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens"), "lengths")
    return pack(lengths, "n_tokens", ["doc_id"], buckets=16, budget=65_536)


def packing_sql(rows: str, buckets: int = 16, budget: int = 65_536) -> str:
    """CTEs ending in `packed`, for a table rows (doc_id, n_tokens)."""
    return f"""
p_hist AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY n_tokens) AS i, n_tokens AS x, count(*) AS c FROM {rows} GROUP BY n_tokens
), p_sum AS MATERIALIZED (
  SELECT i, x, (sum(c) OVER o)::BIGINT AS n, (sum(c * x) OVER o)::BIGINT AS s FROM p_hist WINDOW o AS (ORDER BY i)
), p_best AS (
  SELECT 1 AS m, i, (x * n - s)::BIGINT AS cost, 0::BIGINT AS split FROM p_sum
  UNION ALL
  SELECT m, i, o.cost, o.split FROM (
    SELECT b.m + 1 AS m, e.i, min(struct_pack(cost := CASE WHEN b.i = e.i THEN b.cost ELSE b.cost + e.x * (e.n - d.n) - (e.s - d.s) END,
      split := CASE WHEN b.i = e.i THEN 0 ELSE b.i END)) AS o
    FROM p_best AS b JOIN p_sum AS d ON d.i = b.i JOIN p_sum AS e ON b.i <= e.i
    WHERE b.m < {buckets} GROUP BY b.m, e.i)
), p_back AS (
  SELECT {buckets} AS m, (SELECT max(i) FROM p_sum) AS i, 0 AS step
  UNION ALL
  SELECT k.m - 1, CASE WHEN b.split > 0 THEN b.split ELSE k.i END, k.step + 1
  FROM p_back AS k JOIN p_best AS b ON b.m = k.m AND b.i = k.i WHERE k.m > 1
), p_bound AS MATERIALIZED (
  SELECT x AS bucket_tokens, (row_number() OVER (ORDER BY x) - 1)::INT AS bucket FROM (SELECT DISTINCT x FROM p_back JOIN p_sum USING (i))
), p_place AS (
  SELECT r.doc_id, r.n_tokens, b.bucket, b.bucket_tokens, row_number() OVER (PARTITION BY b.bucket ORDER BY r.doc_id NULLS FIRST) - 1 AS place,
    greatest(1, {budget} // b.bucket_tokens) AS each
  FROM {rows} AS r JOIN p_bound AS b ON b.bucket_tokens = (SELECT min(bucket_tokens) FROM p_bound WHERE bucket_tokens >= r.n_tokens)
), packed AS (
  SELECT doc_id, n_tokens, bucket, bucket_tokens, (place // each)::BIGINT AS batch, (place % each)::BIGINT AS slot FROM p_place
)"""


OP4_SQL = rf"""WITH RECURSIVE lengths AS MATERIALIZED (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT + 1 AS n_tokens FROM documents
), {packing_sql("lengths")} SELECT * FROM packed"""


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_passages(_table(spark, sf_dir, "documents"), words=50, alike=0.8)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_shared_words", F.size("spans").cast("long").alias("n_spans"), "component_id", F.to_json("spans").alias("spans")
    )


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.expr(f"aggregate({c}, 0L, (a, s) -> a + s.end - s.begin)")
    return remove_repeats(_table(spark, sf_dir, "documents"), length=400, passages=(200, 50)).select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_bytes"),
        total("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        total("passages").alias("n_passage_bytes"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe_encode(_table(spark, sf_dir, "documents"), path)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_html(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    more = f"SELECT * FROM VALUES (-1L, 0L, 'user', '{odd}'), (-1L, 1L, 'assistant', '{odd}') AS t(conv_id, turn, role, text)"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(more))
    back = chat_parse(chat_format(turns)).select(
        "conv_id",
        "turns",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(
            F.transform("loss_spans", lambda s: unescaped(F.expr("formatted").substr(s["begin"] + 1, s["length"]))), ""
        ).alias("loss"),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP10_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m AS (
  SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS body, regexp_replace(role, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS head,
    role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS more
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + CASE WHEN more THEN 10 ELSE 12 + length(replace(head, chr(10), '<|im_nl|>')) + 1 + 11 END)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_kneser_ney": op1_kneser_ney, "op2_quality": op2_quality, "op3_embedding_join": op3_embedding_join, "op4_packing": op4_packing, "op5_passages": op5_passages, "op6_suffix_array": op6_suffix_array, "op7_simhash": op7_simhash, "op8_bpe": op8_bpe, "op9_html": op9_html, "op10_chat": op10_chat}


def oracle_sql() -> dict[str, str]:
    return {"op1_kneser_ney": OP1_SQL, "op2_quality": OP2_SQL, "op3_embedding_join": OP3_SQL, "op4_packing": OP4_SQL, "op10_chat": OP10_SQL}
