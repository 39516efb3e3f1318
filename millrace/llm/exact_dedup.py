"""Exact deduplication by 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, fresh, small


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_bits: int = 128
) -> DataFrame:
    """One row per document: the group of equal texts it belongs to and the row of that group which stays.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``; every input row comes back once.

    Texts are hashed where they are read, and hashes are counted. A hash that occurs once is settled; the texts
    behind repeated hashes are then grouped by (hash, text), which compares their bytes after a partial
    aggregation in each task, so a huge group sends one row per task. Repeated hashes are broadcast to the texts while they are few
    (``small``); where they are more, the texts of all documents are shuffled once to meet them. ``hash_bits`` below 128 exists to test
    collisions.

    Null text counts as empty. ``keep`` is "smallest" or "largest" id. A null id is never kept unless all ids of
    its group are null. Rows that repeat both id and text are one document: they get the same
    decision. Other columns are ignored. An empty table gives an empty result.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.substring(F.md5(text.cast("binary")), 1, hash_bits // 4).alias("h"),
    )
    sizes = keyed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    repeated = small(cut(sizes, "repeated"))
    classes = cut(
        keyed.join(repeated, "h", "left_semi")
        .groupBy("h", "text")
        .agg(F.count("*").alias("n"), pick("id").alias("keep_id"))
        .drop("text"),
        "classes",
    )
    collided = cut(classes.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "collided")
    slim = keyed.select("id", "h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    if collided.isEmpty():
        found = slim.join(classes, "h", "left")
    else:
        plain = slim.join(collided, "h", "left_anti").join(classes, "h", "left")
        mixed = keyed.join(collided, "h", "left_semi")
        split = mixed.groupBy("h", "text").agg(F.count("*").alias("n"), pick("id").alias("keep_id"))
        found = plain.unionByName(
            mixed.join(split, ["h", "text"]).select(
                "h", "id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "n", "keep_id"
            )
        )
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text one stays."""
    kept = cut(exact_groups(docs, id_col, text_col, keep).filter("kept").select(F.col(id_col).alias("keep"), "text_sha256"), "kept")
    sha = fresh(docs, "sha")
    marked = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).dropDuplicates([id_col, sha])
    on = marked[id_col].eqNullSafe(kept["keep"]) & (marked[sha] == kept["text_sha256"])
    return marked.join(kept, on, "left_semi").drop(sha)
