"""Queries of the training-data operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, licenses, lm_scoring, packing, pii, quality, simhash, spans, toxicity
from .common import table

#: Demonstration key of the pseudonyms; deployments pass their own.
PII_KEY = b"tapeworks demonstration key"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    both = rows.unionByName(more)
    return chat.digest(both.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a file tree: source, then directories of 1000 and of 20 ids; each twentieth id is its directory's licence file."""
    name = F.when(F.col("doc_id") % 20 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("doc_id div 1000"), F.expr("doc_id div 20"), name)
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents"), words=51)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_quality_rules, op3_decontamination, op4_simhash, op5_packing, op6_chat_formatting,
    op7_license_scan, op8_pii, op9_toxicity, op10_substring_dedup, pipeline,
)}

_CONVERSATIONS = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g')) AS body,
         length(replace(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>)', '\\l\1', 'g'), '\[(/?INST\])', '\\b\1', 'g'), chr(10), '\n')) AS head
  FROM said
)
SELECT CAST(conv_id AS BIGINT) AS conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|>') + head + 1 + body + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

#: The other operators need a hash, a model, a tokenizer or a keyed permutation that SQL lacks; tests/llm has their brute-force versions.
ORACLE = {"op6_chat_formatting": _CONVERSATIONS}
