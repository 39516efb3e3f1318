"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, cut, fresh, small

#: Hash buckets per source; only the bucket in which a source's sample ends is ordered row by row.
BUCKETS = 4096


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """Capped water-filling over ``source, source_size``: adds ``weight`` and ``target``.

    Sources in code-point order, null last, take the weights in turn. All sources start at the level that shares the whole
    budget by weight; those that this takes to ``max_epochs`` times their size or beyond are clamped there, and what they leave is
    shared by weight among the others, until no more are clamped. Each round is one aggregate over the sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    turn = (F.col("position") % len(weights)).cast("int")
    ranked = numbered(sources.select("source", "source_size"), order).select(
        "source", "source_size", F.array(*map(F.lit, weights))[turn].cast("long").alias("weight")
    )
    ranked = cut(ranked, "sources")
    size, weight, most = F.col("source_size"), F.col("weight"), F.lit(float(max_epochs))
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else F.lit(level) * weight >= size * most
        sums = ranked.agg(
            F.sum(size).alias("all"), F.sum(F.when(full, size).otherwise(0)).alias("full"),
            F.sum(F.when(full, 0).otherwise(weight)).alias("open"), F.count_if(full).alias("n"),
        ).first()
        if sums["n"] == clamped or not sums["open"]:
            break
        clamped, level = sums["n"], (float(share) * sums["all"] - float(sums["full"]) * float(max_epochs)) / sums["open"]
    target = F.when(full, size * most).otherwise(weight * F.lit(level if level is not None else 0.0))
    return ranked.withColumn("target", target.cast("double"))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``position`` (from 0) in the order: rows are dealt out by ranges and numbered within them, after the
    rows of the ranges before. Only one row per range is ordered in one task."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn("row", within).join(F.broadcast(firsts), "range").withColumn("position", F.col("first") + F.col("row") - 1).drop("range", "row", "first")


def marked(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    """What decides a document's turn in its source: a seeded hash of its id (of its text if the id is null), that hash's
    bucket, and its text's hash."""
    text = F.coalesce(docs[text_col], F.lit(""))
    name = F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("#"), F.xxhash64(text).cast("string")))
    turn = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return {
        "source": docs[source_col],
        "size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "turn": turn,
        "bucket": F.conv(F.substring(turn, 1, 3), 16, 10).cast("int"),
        "text_hash": F.xxhash64(text),
    }


def mix_plan(sized: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> tuple[DataFrame, DataFrame]:
    """From ``source, size, turn, bucket, text_hash`` per document: the plan per source, and the documents of the
    bucket in which a source's sample ends that belong to it (``edge_turn, edge_hash, edge_source``, and ``fits``, how many of
    their ``copies``; that is less than all for one document of a source at most)."""
    per_bucket = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    filled = targets(per_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = cut(filled.withColumn("whole", whole).withColumn("rest", F.col("target") - whole * F.col("source_size")), "filled")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    edges = (
        starts.join(filled, starts["source"].eqNullSafe(filled["source"]))
        .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bucket_size") > F.col("rest")))
        .select(starts["source"].alias("edge_source"), F.col("bucket").alias("edge_bucket"), "before")
    )
    plan = cut(filled.join(edges, filled["source"].eqNullSafe(edges["edge_source"]), "left").drop("edge_source"), "plan")
    mine = small(plan.withColumnRenamed("source", "plan_source"))
    on_edge = sized.join(mine, sized["source"].eqNullSafe(mine["plan_source"]) & (F.col("bucket") == F.col("edge_bucket")))
    copies = on_edge.groupBy("source", "turn", "text_hash", "size", "before", "rest").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("source").orderBy("turn", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))
    room = F.floor((F.col("rest") - ahead) / F.col("size") + F.lit(0.5))
    fits = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(room, F.col("copies")))).otherwise(F.col("copies")).cast("long")
    chosen = copies.withColumn("fits", fits).filter("fits > 0").select(
        F.col("turn").alias("edge_turn"), F.col("text_hash").alias("edge_hash"), F.col("source").alias("edge_source"), "copies", "fits"
    )
    return plan, cut(chosen, "edge")


def repeats_of(rows: DataFrame, names: dict[str, str], plan: DataFrame, edge: DataFrame, max_epochs: float) -> DataFrame:
    """``rows`` with ``source_size``, ``target`` and ``repeats`` from the plan, under the names given.

    Where a sample ends among copies of one document, equal rows are counted and come back as two rows' worth: as many as
    still fit are taken once more than the others.
    """
    plan = small(plan.select(*[F.col(c).alias(names[c]) for c in ("source_size", "target")], F.col("source").alias("_plan_source"),
                             F.col("whole").alias("_whole"), F.col("edge_bucket").alias("_edge_bucket")))
    most = F.lit(math.ceil(max_epochs)).cast("long")

    def on_edge(rows, edge):
        source = rows[names["source"]].eqNullSafe(edge["edge_source"])
        return (rows[names["turn"]] == edge["edge_turn"]) & (rows[names["text_hash"]] == edge["edge_hash"]) & source

    def repeated(joined, extra):
        repeats = F.when(joined[names["source_size"]] > 0, F.least(joined["_whole"] + extra.cast("long"), most)).otherwise(F.lit(0).cast("long"))
        return joined.withColumn(names["repeats"], repeats).select(*rows.columns, *[names[c] for c in ("source_size", "target", "repeats")])

    def planned(rows):
        return rows.join(plan, rows[names["source"]].eqNullSafe(plan["_plan_source"]))

    split = cut(edge.filter("fits < copies"), "split")
    some = not split.isEmpty()
    settled = rows.join(small(split), on_edge(rows, split), "left_anti") if some else rows
    inside = small(edge.filter("fits = copies"))
    joined = planned(settled).join(inside, on_edge(settled, inside), "left")
    found = repeated(joined, (joined[names["bucket"]] < F.coalesce(F.col("_edge_bucket"), F.lit(0))) | F.col("edge_turn").isNotNull())
    if not some:
        return found
    # One row per kind of equal rows with their number, in a fixed order, then each row again.
    one = small(split)
    kinds = rows.join(one, on_edge(rows, one)).groupBy(*rows.columns, "fits").agg(F.count("*").alias("_n"))
    kinds = cut(kinds.withColumn("_kind", F.xxhash64(*[F.col(c) for c in rows.columns])), "kinds")
    before = Window.partitionBy(names["source"]).orderBy("_kind").rowsBetween(Window.unboundedPreceding, -1)
    ahead = kinds.withColumn("_fits", F.col("fits") - F.coalesce(F.sum("_n").over(before), F.lit(0)))
    each = planned(ahead.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))))
    return found.unionByName(repeated(each, F.col("_copy") <= F.col("_fits")))


def mix_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """How often each document is repeated in the mix: ``id_col, source, size, source_size, target, repeats, taken``.

    Size is the number of words. Each source repeats all its documents floor(target / source_size) times; for the rest
    documents are taken in the order of a seeded hash of their id while at least half of the next one fits, so a source
    misses its target by at most half of one document, and not by more where one document has many copies. No document is taken
    more than ``max_epochs`` (whole) times.

    The order is found without sorting a source: sizes are summed per hash bucket, the bucket in which the target
    falls is found from the sums, and only its rows are ordered. Reruns agree.

    Null text has size 0 and is repeated like its source; a null source is a source; documents without an id have turns by
    their text; of rows that repeat id, source and text as many are taken as fit; sources without words are not taken; an
    empty table gives none.
    """
    columns = marked(docs, id_col, text_col, source_col, seed)
    sized = cut(docs.select(docs[id_col].alias("id"), *[c.alias(name) for name, c in columns.items()]), "sized")
    plan, edge = mix_plan(sized, weights, share, max_epochs)
    names = {c: c for c in ("source", "bucket", "turn", "text_hash", "source_size", "target", "repeats")}
    return repeats_of(sized, names, plan, edge, max_epochs).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken")
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: each document as often as ``mix_counts`` says, with all its columns.

    Texts are shuffled where rows repeat a document in which a source's sample ends (columns must then be of types that can be
    grouped), and all of them where the documents in the buckets at the sources' edges are too many to broadcast (``small``).
    """
    columns = marked(docs, id_col, text_col, source_col, seed)
    sized = cut(docs.select(*[c.alias(name) for name, c in columns.items()]), "sized")
    plan, edge = mix_plan(sized, weights, share, max_epochs)
    names = {c: fresh(docs, f"mix_{c}") for c in ("source", "bucket", "turn", "text_hash", "source_size", "target", "repeats")}
    rows = docs.withColumns({names[c]: columns[c] for c in ("source", "bucket", "turn", "text_hash")})
    counted = repeats_of(rows, names, plan, edge, max_epochs).filter(F.col(names["repeats"]) > 0)
    once = fresh(docs, "mix_once")
    spread = counted.withColumn(once, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names["repeats"]))))
    return spread.select(*[spread[c] for c in docs.columns])
