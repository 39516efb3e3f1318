"""What the corpus operators share: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import shared_path as scratch

#: Rows, and bytes as JSON text, up to which a table is broadcast; beyond either Spark shuffles both sides.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Words: anything but \x20 and \x09 to \x0D, which is what Java's class takes for white space.
WORD = r"\S+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, most: int) -> Iterator[None]:
    """The session's setting is at most ``most`` meanwhile (not positive counts as no limit) and then as before."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Give the system back what this process has freed, if its C library keeps that (glibc does) and has a call for it."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later stages then neither recompute it nor lose it with an executor, and the plan knows its real size.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already cut) with a broadcast hint if it is proven small (``is_small``), else unchanged."""
    return F.broadcast(df) if is_small(df, limit, most_bytes) else df


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` (already cut) has at most ``limit`` rows of at most ``most_bytes`` bytes together."""
    if df.count() > limit:
        return False
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"]
    return (size or 0) <= most_bytes


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
