"""Queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import oracle, quality
from millrace.llm.align import align
from millrace.llm.chat_format import conversation_digest, format_conversations
from millrace.llm.common import fold, scratch, table
from millrace.llm.decontaminate import contamination
from millrace.llm.exact_dedup import exact_groups
from millrace.llm.language_id import identify, train
from millrace.llm.line_dedup import remove_boilerplate
from millrace.llm.mixing import mix_counts
from millrace.llm.secrets import find_secrets, span_digest
from millrace.llm.simhash import near_groups
from millrace.llm.token_output import read_tokens, write_tokens
from millrace.llm.topk import top_k
from millrace.llm.whitening import whiten


def tokenizer_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(fold("doc_id", 5) != 0), "text", "lang", sample_per_language=2000)
    found = identify(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    text = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.char_length(text).cast("long").alias("kept_chars"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), role, text)
    return conversation_digest(format_conversations(turns.union(extra), tokenizer_file()))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), path)
    return read_tokens(spark, path).drop("tokens")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_secrets(table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.filter(fold("doc_id", 3) != 1))
    scored = quality.score(docs, model)
    return scored.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_file(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", "vec_id", F.expr("try_cast(score AS bigint)").alias("score"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_chat_format, op4_simhash, op5_exact_dedup, op6_token_output, op7_secret_scan, op8_quality, op9_mixing, op10_decontaminate, op11_whitening, op12_alignment, op13_topk)} | {"pipeline": corpus_pipeline.run}
SQL = {"op2_line_dedup": oracle.OP2, "op3_chat_format": oracle.OP3, "op5_exact_dedup": oracle.OP5, "op9_mixing": oracle.OP9, "op10_decontaminate": oracle.OP10, "op13_topk": oracle.OP13}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
