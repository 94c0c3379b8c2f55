"""The queries opN_<name> over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_file(name: str) -> Callable[[], str]:
    """The place of a public tokenizer file, looked up where it is read."""

    def path() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2, window=4096)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op3_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chain_dedup import fuzzy_passages

    return fuzzy_passages(table(spark, sf_dir, "documents"), direct=32)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), shingle=3, most=3).drop("key", "root")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents")).drop("key")


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s
  FROM documents),
k AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS group_size,
         first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM k
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("key")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^ 	-
]+')) AS size, md5(t) AS tie,
         -ln((cast(('0x' || md5('0:' || doc_id)[:13]) AS bigint) + 0.5::double) / 4503599627370496.0::double)
         / CASE WHEN length(t) > 0 THEN 1.0::double - 0.9::double * length(regexp_replace(t, '[A-Za-z \x{80}-\x{10FFFF}]+', '', 'g')) / length(t) ELSE 1.0 END AS key
  FROM d),
s AS (
  SELECT source, sum(size)::bigint AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::int]::double AS weight
  FROM f GROUP BY source),
c AS (
  SELECT *, 2.0::double * source_size AS cap, 2.0::double * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (1.5::double * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight), cap) AS target FROM l),
e AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN round(target)::bigint // source_size ELSE 0 END AS epochs FROM a),
p AS (
  SELECT f.*, e.source_size, target, epochs, round(target)::bigint - epochs * e.source_size AS rest,
         sum(size) OVER (PARTITION BY f.source ORDER BY key, doc_id, tie ROWS UNBOUNDED PRECEDING) - size AS before
  FROM f JOIN e ON f.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::bigint AS size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::bigint AS taken
FROM p
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_io import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)


CONTROL_CASE = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_CASE).alias("text"))
    return chat.digests(chat.read_back(chat.formatted(chat.segments(rows.unionByName(case)))))


OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'))
          + length(replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), chr(10), '\' || chr(10))) + 4 + 1 + 8 AS n,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::bigint AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user'), ('assistant', 'tool'), ('tool', 'assistant')) END) AS valid
FROM e GROUP BY conv_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_mixing": OP6_SQL, "op8_chat_formatting": OP8_SQL, "op10_top_k": OP10_SQL}
