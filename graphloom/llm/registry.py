"""Queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table


def tokenizer_path() -> str:
    """The vocabulary file; GRAPHLOOM_TOKENIZER names another place."""
    if path := os.environ.get("GRAPHLOOM_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pii import private

    return private(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.near_dedup import classes

    return classes(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.chat import format_conversations, read_back

    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '{said}' AS text UNION ALL SELECT -1L, 1L, 'assistant', '{said}'"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(rows))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.substring_dedup import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.suffix_dedup import digest, remove_repeats

    return digest(remove_repeats(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?(?:INST|ROLE)\])', '-\1', 'g')) AS n_text,
    length(regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?(?:INST|ROLE)\])', '-\1', 'g')) AS n_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + CASE role WHEN 'user' THEN 19 WHEN 'assistant' THEN 8 ELSE 21 + n_role END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict:
    found = (f for name, f in globals().items() if name.startswith("op") and callable(f) and name[2].isdigit())
    return {f.__name__: f for f in found} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL}
