"""A training corpus from raw documents: quality, near-duplicates, contamination, mix, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``documents``; ``run`` writes every stage's result to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import quality
from millrace.llm.common import cut, scratch, table
from millrace.llm.decontaminate import remove_contaminated
from millrace.llm.mixing import mix_documents
from millrace.llm.simhash import near_dedup
from millrace.llm.token_output import read_tokens, write_tokens

#: Near-duplicates: Jaccard similarity 0.8 of five-word shingle sets. Candidates share one of 28 keys of 5 min-hashes (two
#: sets at 0.8 share none in 1.5 of 100,000 cases) and have fingerprints of 256 bits within 72; sets at 0.8 differ in
#: about 39 bits (standard deviation 6), sets of 4 and 5 in 48.
NEAR = {"shingle": 5, "words": 4, "radius": 72, "bands": 28, "rows": 5, "least": 0.8}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on the labelled ones among them, takes for good."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return near_dedup(docs, **NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target weights."""
    return mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in coded files, read back: ``doc_id, start, n_tokens, ids_crc32`` per document of the mix."""
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_tokens(spark, path).drop("tokens")


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The line model and the token ids have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
