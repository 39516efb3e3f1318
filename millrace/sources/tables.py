"""Scans of relational tables, JSON payloads, batch writes and log lines."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import or_default, redact
from millrace.functions.times import iso
from millrace.sources.units import Conflict, Store

#: Used only in local sessions that name no ``spark.checkpoint.dir``, as in tests.
DEFAULT_SHARED_DIR = "/tmp/checkpoints"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; timestamps without zone are read as UTC instants (the session time zone must be UTC)."""
    df = spark.read.parquet(path)
    naive = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive})


#: Connections that a database gives one reader.
POOL = 15


def scan_jdbc(spark: SparkSession, url: str, table: str, key: str, partitions: int = 8, pool: int = POOL, above: int | None = None, **options: str) -> DataFrame:
    """A database table, read in ranges of a key (numbers) that hold about equally many rows each.

    The ranges' edges are measured in the database, by looking up the keys at equal ranks, so keys need not be spread evenly; equal bounds
    would give one connection most of a skewed table. There are at most ``pool`` ranges, each one connection. Rows with a null key are read with the first range.
    With ``above`` only rows with a greater key are read (none with a null key), for a table that only grows: ``high_water`` gives the next one.
    """
    ask = lambda query: spark.read.format("jdbc").options(**options).option("url", url).option("query", query).load()
    where = f"{key} IS NOT NULL" if above is None else f"{key} > {above}"
    n = int(ask(f"SELECT COUNT(*) AS n FROM {table} WHERE {where}").first()[0])
    ranges = max(1, min(partitions, pool, n))
    ranks = sorted({n * i // ranges for i in range(1, ranges)})
    at = lambda rank: ask(f"SELECT {key} FROM {table} WHERE {where} ORDER BY {key} OFFSET {rank} ROWS FETCH NEXT 1 ROWS ONLY").first()[0]
    edges = sorted({at(rank) for rank in ranks})
    first = f"({key} IS NULL OR {key} < {edges[0]})" if edges else "1 = 1"
    first = first if above is None else " AND ".join([f"{key} > {above}", *([f"{key} < {edges[0]}"] if edges else [])])
    middle = [f"{key} >= {a} AND {key} < {b}" for a, b in itertools.pairwise(edges)]
    last = [f"{key} >= {edges[-1]}"] if edges else []
    return spark.read.jdbc(url, table, predicates=[first, *middle, *last], properties=options)


def high_water(spark: SparkSession, url: str, table: str, key: str, **options: str) -> int | None:
    """The largest key there is now; what is read above it later has come since."""
    query = f"SELECT MAX({key}) AS m FROM {table}"
    return spark.read.format("jdbc").options(**options).option("url", url).option("query", query).load().first()[0]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this session's part of the folder that the driver and all executors share."""
    return f"{_session_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its plan ends there, and a lost executor does not take it along."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _session_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = DEFAULT_SHARED_DIR
    return f"{base.rstrip('/')}/millrace/{spark.conf.get('spark.app.id')}"


def clear_shared(spark: SparkSession) -> None:
    """Delete this session's intermediate tables. Results that still read them must have been written before."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_session_dir(spark))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def parse_payload(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """JSON text as typed fields; a record that does not fit has nulls and its text in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return df.withColumn("_parsed", F.from_json(column, full, options)).select(*df.columns, "_parsed.*")


def to_payload(df: DataFrame) -> Column:
    """A row as JSON text: nulls are written, timestamps in ISO 8601."""
    fields = [iso(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def write_batch(df: DataFrame, path: str, batch: str) -> DataFrame:
    """Write one unit of work all or nothing; a replay of ``batch`` replaces what it wrote before, and one that fails leaves it as it was.

    Returns the batch as read back; ``read_batches`` gives those of all batches. If another writer of the folder comes first, the batch,
    which touches no other one's rows, is published after it.
    """
    store = Store(df.sparkSession, path)
    folder = store.unit().stage(df)
    while True:
        unit = store.unit()
        unit.place("rows", batch, folder, df.schema)
        try:
            unit.publish()
        except Conflict:
            continue
        return store.rows(unit.manifest["tables"]["rows"], [batch])


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches that were written whole."""
    return Store(spark, path).read("rows")


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write all there is of a stream, each trigger's rows as one unit of work named by its number, so that a trigger which is
    run again after a failure replaces its rows instead of adding them."""
    writer = stream.writeStream.foreachBatch(lambda df, number: write_batch(df, path, str(number)) and None)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log_line(ts: Column, level: Column, logger: Column, request: Column, message: Column) -> Column:
    """One redacted line: time, level padded to 8, logger, [request id or -], message."""
    return F.format_string(
        "%s %-8s %s [%s] %s", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), level, logger, or_default(request, "-"), redact(message)
    )
