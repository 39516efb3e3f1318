"""Account, session and request tables derived from the given tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.tables import scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    none = F.lit(None)
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        F.sha2(F.concat(F.lit("p"), k.cast("string")), 256).alias("hashed_password"),
        F.when(k % 7 != 0, F.col("c_name")).alias("full_name"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.when(k % 50 == 0, "admin").otherwise("user").alias("role"),
        (k == 1).alias("is_app_admin"),
        none.cast("string").alias("avatar_url"),
        F.when(k % 4 == 0, F.lit("2024-02-01").cast("timestamp")).alias("onboarding_completed_at"),
        F.when(k % 5 == 0, "oidc").alias("oauth_provider"),
        F.when(k % 5 == 0, k.cast("string")).alias("oauth_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.floor(k / 3).cast("int"))).alias("created_at"),
        none.cast("timestamp").alias("updated_at"),
    )


def raw_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming records: emails in mixed case, padded, broken or repeated."""
    k = F.col("id")
    email = F.when(k % 11 == 0, F.replace("email", F.lit("@"), F.lit(""))).when(k % 13 == 0, F.lit("customer.000000013@example.com")).otherwise(F.col("email"))
    email = F.when(k % 2 == 0, F.upper(email)).otherwise(email)
    email = F.when(k % 3 == 0, F.concat(F.lit(" \t"), email, F.lit(" "))).otherwise(email)
    return accounts(spark, sf_dir).select(
        "id", email.alias("email"), "full_name", F.when(k % 17 == 0, "owner").otherwise(F.col("role")).alias("role"),
        F.substring(F.lit("correct horse"), 1, (k % 12 + 1).cast("int")).alias("password"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.when(k % 97 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("user_id"),
        F.sha2(F.concat(F.lit("t"), k.cast("string")), 256).alias("refresh_token_hash"),
        F.when(k % 5 != 0, F.concat(F.lit("10.0.0."), (k % 250).cast("string"))).alias("ip_address"),
        (F.col("o_orderstatus") == "O").alias("is_active"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("last_used_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.when(k % 4 != 0, F.col("o_orderstatus")).alias("description"),
        F.col("o_custkey").alias("owner_id"),
        F.col("o_orderdate").alias("created_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    text = k.cast("string")
    status = F.when(kind == "click", 200).when(kind == "view", 401).when(kind == "signup", 404).when(kind == "purchase", 429).otherwise(500)
    return table(spark, sf_dir, "events").select(
        k.alias("id"),
        F.col("user_id").alias("client"),
        "ts",
        F.when(kind == "signup", "websocket").otherwise("http").alias("scope"),
        F.when(kind == "view", "/docs").otherwise("/api/v1/users/").alias("path"),
        F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit("r "), text)).otherwise(F.concat(F.lit("r-"), (k % 500).cast("string"))).alias("request_id"),
        status.alias("status"),
    )


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        (F.get_json_object("props", "$.k").cast("long") % 3).alias("session"),
        "ts",
        F.when(kind == "signup", "login").when(kind.isin("click", "view"), "refresh").when(kind == "purchase", "logout").otherwise("logout_all").alias("kind"),
        (F.col("event_id") % 9 == 0).alias("stale"),
    )


def events_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return rows.select(F.col("event_id").alias("id"), "user_id", "ts")


def token_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_of(spark, sf_dir, "click")
    return rows.select(F.col("user_id").alias("session"), "ts", F.sha2(F.col("id").cast("string"), 256).alias("digest"))


def token_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that present the digest of the user's last click before, or of the one before that on every ninth event."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    clicks = Window.partitionBy("user_id", "event_type").orderBy("ts")
    before = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    click = F.struct(F.col("event_id").alias("last"), F.lag("event_id").over(clicks).alias("earlier"))
    marked = events.withColumn("click", F.when(F.col("event_type") == "click", click))
    marked = marked.withColumn("seen", F.last("click", ignorenulls=True).over(before)).filter(F.col("event_type") == "view")
    shown = F.when(F.col("event_id") % 9 == 0, F.col("seen.earlier")).otherwise(F.col("seen.last"))
    return marked.select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), "ts", F.sha2(shown.cast("string"), 256).alias("digest"))


def access_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("actor"), (F.col("o_custkey") + k % 3).alias("target"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-part tokens whose middle part is base64url JSON claims; every fourth is not valid before half a minute after its event."""
    kind = F.when(F.col("event_type") == "click", "access").when(F.col("event_type") == "view", "refresh").otherwise("password_reset")
    begins = F.when(F.col("event_id") % 4 == 0, F.format_string('"nbf":%d,', F.unix_seconds("ts") + 30)).otherwise("")
    claims = F.format_string('{"sub":"%d",%s"exp":%d,"type":"%s"}', "user_id", begins, F.unix_seconds("ts") + 60, kind)
    part = F.regexp_replace(F.translate(F.base64(claims.cast("binary")), "+/\r\n", "-_"), "=", "")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("e30."), part, F.lit(".sig")).alias("token"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user of the events, some inactive."""
    k = F.col("user_id")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    until = F.lit("2024-01-10").cast("timestamp") + F.make_dt_interval(days=(k % 90).cast("int"))
    return users.select(k.alias("id"), (k + 1).alias("user_id"), _digest("s", k).alias("refresh_token_hash"), (k % 5 != 0).alias("is_active"), until.alias("expires_at"))


def refresh_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as refreshes of their user's session, 15 times as far apart: each presents what the last undisturbed one before it should
    have issued; every ninth replays the session's first digest, every seventeenth has a bad token (both disturbed)."""
    k, n = F.col("user_id"), F.col("event_id")
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when((n % 9 != 0) & (n % 17 != 0), n), ignorenulls=True).over(before)
    events = table(spark, sf_dir, "events").withColumn("last", last)
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + 15 * (F.unix_micros("ts") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))))
    shown = F.when((n % 9 == 0) | F.col("last").isNull(), _digest("s", k)).otherwise(_digest("r", F.col("last")))
    return events.select(n.alias("attempt"), shown.alias("digest"), _digest("r", n).alias("new_digest"), (n % 17 != 0).alias("token_ok"), at.alias("at"))


def machine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session events with digests: logins and refreshes should issue one; refreshes and logouts present what the session should have been issued
    last before, or on every ninth event the one before that."""
    issues = F.col("kind").isin("login", "refresh")
    own = Window.partitionBy("user_id", "session").orderBy("ts", "id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    marked = session_events(spark, sf_dir).withColumn("issue", F.when(issues, F.col("id")))
    marked = marked.withColumn("last", F.last("issue", ignorenulls=True).over(before))
    marked = marked.withColumn("earlier", F.last(F.when(issues, F.struct(F.col("last").alias("v"))), ignorenulls=True).over(before)["v"])
    shown = F.when(F.col("stale"), F.col("earlier")).otherwise(F.col("last"))
    presents = F.col("kind").isin("refresh", "logout")
    return marked.select("id", "user_id", "session", "ts", "kind", F.when(presents, _digest("i", shown)).alias("digest"), F.when(issues, _digest("i", F.col("id"))).alias("new_digest"))


def _digest(prefix: str, number: Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), number.cast("string")), 256)


#: The same tables in DuckDB.
CTES = r"""
accounts AS (
  SELECT c_custkey AS id, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
    sha256('p' || c_custkey) AS hashed_password, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS full_name,
    c_acctbal >= 0 AS is_active, CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role, c_custkey = 1 AS is_app_admin,
    NULL::VARCHAR AS avatar_url, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-02-01' END AS onboarding_completed_at,
    CASE WHEN c_custkey % 5 = 0 THEN 'oidc' END AS oauth_provider, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR END AS oauth_id,
    TIMESTAMP '2024-01-01' + to_minutes(c_custkey // 3) AS created_at, NULL::TIMESTAMP AS updated_at FROM customer),
raw_accounts AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN ' ' || chr(9) || email || ' ' ELSE email END AS email, full_name,
    CASE WHEN id % 17 = 0 THEN 'owner' ELSE role END AS role, substr('correct horse', 1, (id % 12 + 1)::INT) AS password
  FROM (SELECT id, full_name, role, CASE WHEN id % 2 = 0 THEN upper(e) ELSE e END AS email FROM (
    SELECT *, CASE WHEN id % 11 = 0 THEN replace(email, '@', '') WHEN id % 13 = 0 THEN 'customer.000000013@example.com' ELSE email END AS e FROM accounts))),
sessions AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN -1 ELSE o_custkey END AS user_id, sha256('t' || o_orderkey) AS refresh_token_hash,
    CASE WHEN o_orderkey % 5 <> 0 THEN '10.0.0.' || (o_orderkey % 250) END AS ip_address, o_orderstatus = 'O' AS is_active,
    o_orderdate AS created_at, o_orderdate AS last_used_at, o_orderdate + INTERVAL 30 DAYS AS expires_at FROM orders),
items AS (
  SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS description,
    o_custkey AS owner_id, o_orderdate AS created_at FROM orders),
requests AS (
  SELECT event_id AS id, user_id AS client, ts, CASE WHEN event_type = 'signup' THEN 'websocket' ELSE 'http' END AS scope,
    CASE WHEN event_type = 'view' THEN '/docs' ELSE '/api/v1/users/' END AS path,
    CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'r ' || event_id ELSE 'r-' || (event_id % 500) END AS request_id,
    CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 401 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 ELSE 500 END AS status FROM events),
session_events AS (
  SELECT event_id AS id, user_id, (props->>'$.k')::BIGINT % 3 AS session, ts,
    CASE event_type WHEN 'signup' THEN 'login' WHEN 'click' THEN 'refresh' WHEN 'view' THEN 'refresh' WHEN 'purchase' THEN 'logout' ELSE 'logout_all' END AS kind,
    event_id % 9 = 0 AS stale FROM events),
logins AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'signup'),
revocations AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'error'),
token_issues AS (SELECT user_id AS session, ts, sha256(event_id::VARCHAR) AS digest FROM events WHERE event_type = 'click'),
clicks AS (SELECT user_id, ts, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS earlier FROM events WHERE event_type = 'click'),
token_uses AS (
  SELECT v.event_id AS id, v.user_id AS session, v.ts, sha256((CASE WHEN v.event_id % 9 = 0 THEN c.earlier ELSE c.event_id END)::VARCHAR) AS digest
  FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN clicks c ON v.user_id = c.user_id AND v.ts > c.ts),
access_pairs AS (SELECT o_orderkey AS id, o_custkey AS actor, o_custkey + o_orderkey % 3 AS target FROM orders),
messages AS (SELECT doc_id AS id, text FROM documents),
user_sessions AS (
  SELECT user_id AS id, user_id + 1 AS user_id, sha256('s' || user_id) AS refresh_token_hash, user_id % 5 <> 0 AS is_active,
    TIMESTAMP '2024-01-10' + to_days((user_id % 90)::INT) AS expires_at FROM (SELECT DISTINCT user_id FROM events)),
refresh_attempts AS (
  SELECT event_id AS attempt, user_id AS session_key, sha256(CASE WHEN event_id % 9 = 0 OR last IS NULL THEN 's' || user_id ELSE 'r' || last END) AS digest,
    sha256('r' || event_id) AS new_digest, event_id % 17 <> 0 AS token_ok,
    make_timestamp(epoch_us(TIMESTAMP '2024-01-01') + 15 * (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))) AS "at"
  FROM (SELECT *, last_value(CASE WHEN event_id % 9 <> 0 AND event_id % 17 <> 0 THEN event_id END IGNORE NULLS)
          OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)),
machine_issues AS (
  SELECT user_id, session, ts, id, lag(id) OVER (PARTITION BY user_id, session ORDER BY ts, id) AS earlier FROM session_events WHERE kind IN ('login', 'refresh')),
machine_events AS (
  SELECT e.id, e.user_id, e.session, e.ts, e.kind,
    CASE WHEN e.kind IN ('refresh', 'logout') THEN sha256('i' || (CASE WHEN e.stale THEN i.earlier ELSE i.id END)) END AS digest,
    CASE WHEN e.kind IN ('login', 'refresh') THEN sha256('i' || e.id) END AS new_digest
  FROM session_events e ASOF LEFT JOIN machine_issues i ON e.user_id = i.user_id AND e.session = i.session AND e.ts > i.ts)
"""
