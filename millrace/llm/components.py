"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``links`` has columns a, b (one type). Returns ``node, root``: nodes are linked, at any remove, iff roots are equal.

    Each round maps every node to the least of itself and its neighbours and replaces links by the links of
    what their ends were mapped to; links within one node vanish. Rounds take the nodes' own order and a hash order in
    turn: the first settles stars at once, the second halves long chains. Minima are pre-aggregated in every task, and
    each round's tables are written, so joins on a hub's key are between plain shuffles that Spark can split.
    Links with a null end are ignored; self-links give a node of its own; no links give no rows.
    """
    links = cut(links.filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    mapping, step = None, 0
    while mapping is None or not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, s=step: F.struct((F.col(c) if s % 2 == 0 else F.xxhash64(F.lit(s), c)).alias("rank"), F.col(c).alias("to"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        parents = cut(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["to"].alias("root")), "parents")
        if mapping is None:
            mapping = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("up"))
            mapping = cut(mapping.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "mapping")
        of = lambda c: parents.select(F.col("node").alias(c), F.col("root").alias(f"new_{c}"))
        moved = cut(links.join(of("a"), "a").select("new_a", "b"), "moved").join(of("b"), "b")
        links = cut(moved.filter("new_a <> new_b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).distinct(), "links")
        step += 1
    return mapping
