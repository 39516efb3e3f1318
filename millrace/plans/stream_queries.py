"""Streaming queries over the events, run to the end of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import views as V
from millrace.plans.base import query
from millrace.plans.session_queries import _MACHINE_SECONDS, FOLD, LIMIT, MACHINE
from millrace.plans.text_queries import redact_sql
from millrace.sources import tables
from millrace.streaming import streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. The path is a pattern because a stream's plain path must be a directory."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT doc_id AS id, '-' AS request_id, {redact_sql('text')} AS text FROM documents")
def redact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    feed = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    return streams.drain(streams.redacted, feed.select(F.col("doc_id").alias("id"), F.lit("").alias("request_id"), "text"), "redact")


@query("SELECT event_id AS id, user_id, ts FROM events")
def write_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tables.shared_path(spark, "stream")
    feed = _events(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", "ts")
    tables.write_stream(feed, f"{path}/out", f"{path}/state")
    return tables.read_batches(spark, f"{path}/out").select("id", "user_id", "ts")


@query(LIMIT + " SELECT id, client, allowed, retry_after FROM folded")
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all requests."""
    feed = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("client"), "ts")
    return streams.drain(lambda rows: streams.rate_limited(rows, limit=2, window_s=86400, delay="1 hour"), feed, "limit", "ts")


@query(FOLD + " SELECT id, user_id, session, kind, outcome FROM session_outcomes")
def session_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all session events."""
    kind = F.col("event_type")
    feed = _events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        "user_id",
        (F.get_json_object("props", "$.k").cast("long") % 3).alias("session"),
        "ts",
        F.when(kind == "signup", "login").when(kind.isin("click", "view"), "refresh").when(kind == "purchase", "logout").otherwise("logout_all").alias("kind"),
        (F.col("event_id") % 9 == 0).alias("stale"),
    )
    return streams.drain(lambda rows: streams.sessions_folded(rows, delay="1 hour"), feed, "sessions", "ts")


@query(MACHINE)
def session_machine_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all session events; their digests are derived beforehand, as a client would present them."""
    path = tables.shared_path(spark, "machine")
    V.machine_events(spark, sf_dir).write.parquet(path)
    feed = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return streams.drain(lambda rows: streams.session_machine_stream(rows, *_MACHINE_SECONDS, delay="1 hour"), feed, "machine", "ts")
