"""Removal of boilerplate lines by the number of distinct sites they appear on, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, fresh, is_small, small

#: White space that is not part of a line.
BLANK = " \t\r"
#: Names of changed documents that are broadcast, where their lines are too many: rows, and bytes as JSON text.
CHANGED_ROWS, CHANGED_BYTES = 2_000_000, 128 << 20


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hash(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(BLANK)).cast("binary")))


def is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK)) == ""


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int = 12) -> DataFrame:
    """``line``: hashes that occur with at least ``min_sites`` distinct ``site`` values in ``lines`` (line, site).

    One HyperLogLog sketch per line and task, merged by the shuffle. Three standard errors (and one site at least) on either
    side of the threshold count as near it; near lines are counted exactly from their distinct (line, site) pairs.
    """
    margin = max(1.0, 3 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    spread = sketched.select("line", F.hll_sketch_estimate("sketch").alias("sites"))
    wide = cut(spread.filter(F.col("sites") >= min_sites - margin), "wide")
    near = small(wide.filter(F.col("sites") <= min_sites + margin).select("line"))
    pairs = lines.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("line")
    return wide.filter(F.col("sites") > min_sites + margin).select("line").unionByName(exact)


def with_removal(docs: DataFrame, removal: DataFrame, key: Column, text_hash: Column) -> DataFrame:
    """``docs`` with the array of line hashes that go from each, null where none do."""
    same = (key == removal["key"]) & (text_hash == removal["text_hash"])
    return docs.join(removal, same, "left").drop(removal["key"], removal["text_hash"])


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    lg_k: int = 12,
) -> DataFrame:
    """All columns of ``docs``, the text without lines that occur on ``min_sites`` or more sites, and ``n_lines, n_removed``.

    Lines end at \\n and are compared without surrounding spaces, tabs and returns; blank lines are never removed and
    not counted. Every copy of a boilerplate line goes, within one document too. Remaining lines keep their
    order and spacing. A null text stays null and has no lines; a null site is a site of its own;
    documents are told apart by id and text, so null ids and repeated rows are handled like any other. Columns
    named ``n_lines`` or ``n_removed`` are replaced. An empty table gives none. Only hashes are shuffled while the lines that go, by
    document, are small enough to broadcast. Beyond that the names of the documents that change are broadcast, and only those
    documents are shuffled with their texts; if even the names are too many, all documents are.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))
    marks = F.array_distinct(F.transform(F.filter(split_lines(F.col(text_col)), lambda x: ~is_blank(x)), line_hash))
    occurrences = cut(
        docs.select(key.alias("key"), text_hash.alias("text_hash"), site.alias("site"), F.explode(marks).alias("line")), "lines"
    )
    boilerplate = small(cut(boilerplate_lines(occurrences.select("line", "site"), min_sites, lg_k), "boilerplate"))
    hit = occurrences.select("key", "text_hash", "line").join(boilerplate, "line")
    removed = fresh(docs, "removed")
    removal = cut(hit.groupBy("key", "text_hash").agg(F.collect_set("line").alias(removed)), "removal")
    if is_small(removal):
        joined = with_removal(docs, F.broadcast(removal), key, text_hash)
    else:
        names = small(cut(removal.select("key", "text_hash"), "changed"), CHANGED_ROWS, CHANGED_BYTES)
        same = (key == names["key"]) & (text_hash == names["text_hash"])
        nothing = F.lit(None).cast("array<binary>")
        joined = with_removal(docs.join(names, same, "left_semi"), removal, key, text_hash).unionByName(
            docs.join(names, same, "left_anti").withColumn(removed, nothing)
        )
    lines = split_lines(F.col(text_col))
    solid = F.filter(lines, lambda x: ~is_blank(x))
    goes = lambda x: F.array_contains(F.col(removed), line_hash(x))
    changed = F.col(removed).isNotNull()
    n_removed = F.when(changed, F.size(F.filter(solid, goes))).otherwise(0).cast("long")
    cleaned = F.when(changed, F.array_join(F.filter(lines, lambda x: is_blank(x) | ~goes(x)), "\n")).otherwise(F.col(text_col))
    return joined.withColumns(
        {"n_lines": F.size(solid).cast("long"), "n_removed": n_removed, text_col: cleaned}
    ).drop(removed)
