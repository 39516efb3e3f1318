"""Looking back along a key's rows without bringing all of them together."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.tables import keep

#: Rows of one key that a task sorts and looks back along by itself.
HOT_ROWS = 1 << 20


def last_before(rows: DataFrame, keys: list[str], order: list[str], found: dict[str, str]) -> DataFrame:
    """``rows`` with a column for each of ``found`` (value column: new name): the last non-null value in the key's rows before this one, in the
    ascending order of the columns ``order`` (nulls first; rows that tie in all of them are taken in any order).

    If no key has more than ``HOT_ROWS`` rows, which is counted first, a window per key looks back; the result does not depend on that. Else rows are dealt out
    by ranges of (keys, order), so a key with very many rows lies in many ranges and no task gets more than a range of it. Inside a range
    a window looks back; what a key's earlier ranges end with is carried over. Only keys that go on from one range to the next carry anything, so there is at
    most one such row per range, which is broadcast. Null keys are a key.
    """
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= HOT_ROWS:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({name: F.last(value, ignorenulls=True).over(whole) for value, name in found.items()})
    ranged = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = keep(ranged, "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    looked = ranged.withColumns({f"_{name}": F.last(value, ignorenulls=True).over(inside) for value, name in found.items()})

    # What each range ends with for each key, and from that what a key's later ranges begin with: a row per range at most.
    position = F.struct(*order)
    last = [F.max_by(value, F.when(F.col(value).isNotNull(), position)).alias(name) for value, name in found.items()]
    ends = ranged.groupBy(*keys, "_range").agg(*last)
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.struct(*keys).alias("_key"), F.col("_range").alias("_to"), *[F.last(name, ignorenulls=True).over(earlier).alias(f"_carried_{name}") for name in found.values()])
    carried = carried.filter(reduce(or_, [F.col(f"_carried_{name}").isNotNull() for name in found.values()]))
    on = (looked["_range"] == carried["_to"]) & F.struct(*[looked[k] for k in keys]).eqNullSafe(carried["_key"])
    joined = looked.join(F.broadcast(carried), on, "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_{name}", f"_carried_{name}").alias(name) for name in found.values()])
