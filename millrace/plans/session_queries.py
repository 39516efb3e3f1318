"""Session, request and limit queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import or_default
from millrace.operators import changes as M
from millrace.operators import sessions as S
from millrace.operators.failures import error_dimension as dimension
from millrace.operators.failures import failure_counts
from millrace.plans import views as V
from millrace.plans.base import query


@query("""
, asked AS (SELECT o_orderkey AS attempt, sha256('t' || (o_orderkey + o_orderkey % 2)) AS digest FROM orders)
SELECT attempt, s.id AS session_id, user_id FROM asked JOIN sessions s ON s.is_active AND s.refresh_token_hash = digest
""")
def active_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = V.table(spark, sf_dir, "orders").select(k.alias("attempt"), F.sha2(F.concat(F.lit("t"), (k + k % 2).cast("string")), 256).alias("refresh_token_hash"))
    active = V.sessions(spark, sf_dir).filter("is_active")
    return asked.join(active, "refresh_token_hash").select("attempt", F.col("id").alias("session_id"), "user_id")


@query("SELECT id, scope, path FROM requests WHERE scope = 'http' AND NOT (starts_with(path, '/docs') OR starts_with(path, '/redoc'))")
def non_exempt_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.non_exempt(V.requests(spark, sf_dir)).select("id", "scope", "path")


@query("SELECT id, user_id, expires_at FROM sessions WHERE expires_at <= TIMESTAMP '1996-01-01'")
def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.expired(V.sessions(spark, sf_dir), F.lit("1996-01-01").cast("timestamp")).select("id", "user_id", "expires_at")


@query("""
, attempts AS (SELECT o_orderkey AS attempt, sha256('t' || (o_orderkey + o_orderkey % 2)) AS digest, o_orderkey % 10 <> 7 AS token_ok,
               o_orderdate + to_days((o_orderkey % 60)::INT) AS at FROM orders),
joined AS (SELECT a.*, s.id AS session_id, s.user_id, s.expires_at, c.is_active AS owner_active FROM attempts a
           LEFT JOIN sessions s ON s.is_active AND s.refresh_token_hash = a.digest LEFT JOIN accounts c ON c.id = s.user_id),
named AS (SELECT *, CASE WHEN NOT token_ok THEN 'invalid_token' WHEN session_id IS NULL THEN 'no_active_session'
            WHEN expires_at <= "at" THEN 'session_expired' WHEN owner_active IS NULL THEN 'unknown_account'
            WHEN NOT owner_active THEN 'inactive_account' ELSE 'ok' END AS outcome FROM joined)
SELECT attempt, digest, session_id, user_id, outcome, outcome IN ('session_expired', 'inactive_account') AS would_deactivate FROM named
""")
def refresh_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    attempts = V.table(spark, sf_dir, "orders").select(
        k.alias("attempt"),
        F.sha2(F.concat(F.lit("t"), (k + k % 2).cast("string")), 256).alias("digest"),
        (k % 10 != 7).alias("token_ok"),
        (F.col("o_orderdate") + F.make_dt_interval(days=(k % 60).cast("int"))).alias("at"),
    )
    return S.refresh_outcomes(attempts, V.sessions(spark, sf_dir), V.accounts(spark, sf_dir))


@query("""
, asked AS (SELECT a.*, row_number() OVER (PARTITION BY session_key ORDER BY a."at", attempt) AS n FROM refresh_attempts a),
live AS (SELECT s.*, a.is_active AS owner_active FROM user_sessions s LEFT JOIN accounts a ON a.id = s.user_id WHERE s.is_active),
folded AS (
  WITH RECURSIVE fold AS (
    SELECT id AS session_key, 0::BIGINT AS n, NULL::BIGINT AS attempt, refresh_token_hash AS held, expires_at AS until, NULL::VARCHAR AS outcome, 0::BIGINT AS used FROM live
    UNION ALL
    SELECT session_key, n, attempt, CASE WHEN outcome = 'ok' THEN new_digest ELSE held END,
      CASE WHEN outcome = 'ok' THEN "at" + INTERVAL 30 DAYS ELSE until END, outcome, used + (outcome = 'ok')::BIGINT
    FROM (SELECT a.session_key, a.n, a.attempt, a.new_digest, a."at", f.held, f.until, f.used,
            CASE WHEN NOT a.token_ok THEN 'invalid_token' WHEN a.digest <> f.held THEN 'no_active_session' WHEN a."at" >= f.until THEN 'session_expired'
              WHEN l.owner_active IS NULL THEN 'unknown_account' WHEN NOT l.owner_active THEN 'inactive_account' ELSE 'ok' END AS outcome
          FROM fold f JOIN asked a ON a.session_key = f.session_key AND a.n = f.n + 1 JOIN live l ON l.id = f.session_key))
  SELECT * FROM fold WHERE n > 0)
SELECT a.attempt, coalesce(f.outcome, CASE WHEN a.token_ok THEN 'no_active_session' ELSE 'invalid_token' END) AS outcome,
  CASE WHEN f.outcome = 'ok' THEN f.session_key END AS refreshed, CASE WHEN f.outcome = 'ok' THEN f.used END AS position
FROM asked a LEFT JOIN folded f USING (attempt)
""")
def refresh_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.refresh_chains(V.refresh_attempts(spark, sf_dir), V.user_sessions(spark, sf_dir), V.accounts(spark, sf_dir))
    return done.select("attempt", "outcome", F.when(F.col("outcome") == "ok", F.col("session_id")).alias("refreshed"), "position")


@query("""
, claims AS (SELECT o_orderkey AS token_id, CASE WHEN o_orderkey % 9 = 0 THEN 'x' || o_custkey WHEN o_orderkey % 9 = 1 THEN '9' || (o_custkey + 10000000) ELSE o_custkey::VARCHAR END AS sub FROM orders)
SELECT token_id, sub, CASE WHEN try_cast(sub AS BIGINT) IS NULL THEN 'bad_claim' WHEN a.id IS NULL THEN 'unknown_account'
  WHEN NOT a.is_active THEN 'inactive_account' ELSE 'ok' END AS outcome FROM claims LEFT JOIN accounts a ON a.id = try_cast(sub AS BIGINT)
""")
def resolve_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sub = F.when(k % 9 == 0, F.concat(F.lit("x"), c.cast("string"))).when(k % 9 == 1, F.concat(F.lit("9"), (c + 10000000).cast("string"))).otherwise(c.cast("string"))
    claims = V.table(spark, sf_dir, "orders").select(k.alias("token_id"), sub.alias("sub"))
    return S.resolve_subjects(claims, V.accounts(spark, sf_dir))


@query("""
, keys AS (SELECT id FROM accounts WHERE id % 7 = 0)
SELECT 'account' AS kind, id FROM accounts WHERE id NOT IN (SELECT id FROM keys)
UNION ALL SELECT 'session', id FROM sessions WHERE user_id NOT IN (SELECT id FROM keys)
""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = V.accounts(spark, sf_dir)
    left, kept = M.delete_cascade(accounts, V.sessions(spark, sf_dir), accounts.filter("id % 7 = 0").select("id"), "user_id")
    return left.select(F.lit("account").alias("kind"), "id").unionByName(kept.select(F.lit("session").alias("kind"), "id"))


@query("SELECT s.id, s.user_id FROM sessions s LEFT JOIN accounts a ON a.id = s.user_id WHERE a.id IS NULL")
def orphan_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = V.accounts(spark, sf_dir).select(F.col("id").alias("user_id"))
    return V.sessions(spark, sf_dir).join(owners, "user_id", "left_anti").select("id", "user_id")


_CODES = """
, codes(status, code, message, status_text) AS (VALUES
  (200, NULL, NULL, NULL), (401, 'AUTHENTICATION_ERROR', 'Authentication failed', 'Unauthorized'), (404, 'NOT_FOUND', 'Resource not found', 'Not Found'),
  (429, 'RATE_LIMIT_EXCEEDED', 'Rate limit exceeded', 'Slow down'), (500, 'INTERNAL_ERROR', 'Internal server error', 'Internal Server Error'))
"""


@query(_CODES + "SELECT id, r.status, code, message, status_text FROM requests r JOIN codes c USING (status) WHERE status >= 400")
def error_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = V.requests(spark, sf_dir).filter("status >= 400")
    named = dimension(spark, {429: "Slow down"}).filter(~F.col("code").isin("APP_ERROR", "DATABASE_ERROR"))
    return failed.join(F.broadcast(named), "status").select("id", "status", "code", "message", "status_text")


@query(_CODES + """
SELECT code, CASE WHEN status >= 500 THEN 'error' ELSE 'warning' END AS severity, count(*) AS n,
  count(CASE WHEN status < 500 THEN path END) AS with_details FROM requests JOIN codes USING (status) WHERE status >= 400 GROUP BY 1, 2
""")
def failure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = V.requests(spark, sf_dir).filter("status >= 400").withColumn("details", F.col("path"))
    named = dimension(spark).filter(~F.col("code").isin("APP_ERROR", "DATABASE_ERROR"))
    return failure_counts(failed.join(F.broadcast(named), "status"))


@query("""
SELECT l.id, l.user_id, l.ts, r.ts AS revoked_at FROM logins l ASOF LEFT JOIN revocations r ON l.user_id = r.user_id AND l.ts <= r.ts
""")
def session_revoked_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.revoked_at(V.events_of(spark, sf_dir, "signup"), V.events_of(spark, sf_dir, "error"))


@query("""
SELECT u.id, u.session, i.digest AS current, CASE WHEN i.digest IS NOT NULL THEN u.digest IS DISTINCT FROM i.digest END AS stale
FROM token_uses u ASOF LEFT JOIN token_issues i ON u.session = i.session AND u.ts > i.ts
""")
def stale_token_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stale_uses(V.token_issues(spark, sf_dir), V.token_uses(spark, sf_dir))


@query("SELECT a.id AS user_id, count(s.id) AS revoked FROM accounts a LEFT JOIN sessions s ON s.user_id = a.id AND s.is_active WHERE a.id % 3 = 0 GROUP BY a.id")
def revoked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = V.accounts(spark, sf_dir).filter("id % 3 = 0").select(F.col("id").alias("user_id"))
    return M.revoked_counts(V.sessions(spark, sf_dir), users)


@query("SELECT coalesce(nullif(request_id, ''), '-') AS request_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM requests GROUP BY 1")
def request_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = or_default(F.col("request_id"), "-").alias("request_id")
    return V.requests(spark, sf_dir).groupBy(key).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
SELECT source AS recipient, max(doc_id) AS id, max_by(length(text), doc_id)::BIGINT AS n_chars FROM documents WHERE text LIKE '%token%' GROUP BY source
""")
def latest_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = V.table(spark, sf_dir, "documents").filter(F.col("text").contains("token"))
    latest = F.max_by(F.struct(F.char_length("text").cast("long").alias("n_chars")), "doc_id")
    return mail.groupBy(F.col("source").alias("recipient")).agg(F.max("doc_id").alias("id"), latest["n_chars"].alias("n_chars"))


# The limit that both allows and rejects on these tables: 2 requests a day.
LIMIT = """
, hits AS (SELECT id, client, ts, row_number() OVER (PARTITION BY client ORDER BY ts, id) AS n FROM requests),
folded AS (
  WITH RECURSIVE fold AS (
    SELECT id, client, ts, n, ts AS opened, 1 AS used, true AS allowed FROM hits WHERE n = 1
    UNION ALL
    SELECT h.id, h.client, h.ts, h.n, CASE WHEN h.ts - f.opened >= INTERVAL 1 DAY THEN h.ts ELSE f.opened END,
      CASE WHEN h.ts - f.opened >= INTERVAL 1 DAY THEN 1 WHEN f.used < 2 THEN f.used + 1 ELSE f.used END,
      h.ts - f.opened >= INTERVAL 1 DAY OR f.used < 2
    FROM fold f JOIN hits h ON h.client = f.client AND h.n = f.n + 1)
  SELECT *, CASE WHEN allowed THEN 0 ELSE greatest(1, ceil((86400000000 - (epoch_us(ts) - epoch_us(opened))) / 1000000))::BIGINT END AS retry_after FROM fold)
"""


@query(LIMIT + "SELECT id, client, allowed, retry_after FROM folded")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rate_limit(V.requests(spark, sf_dir), limit=2, window_s=86400)


@query(LIMIT + "SELECT client, count(*) AS requests, count(*) FILTER (NOT allowed) AS rejected FROM folded GROUP BY client")
def rate_limit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rate_limit_totals(V.requests(spark, sf_dir), limit=2, window_s=86400)


FOLD = """
, marked AS (
  SELECT e.*,
    max(CASE WHEN kind = 'login' THEN ts END) OVER (PARTITION BY user_id, session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
    max(CASE WHEN kind = 'logout' THEN ts END) OVER (PARTITION BY user_id, session ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed,
    max(CASE WHEN kind = 'logout_all' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
  FROM session_events e),
opened AS (SELECT *, opened IS NOT NULL AND (closed IS NULL OR opened > closed) AND (ended IS NULL OR opened > ended) AS is_open FROM marked),
session_outcomes AS (SELECT id, user_id, session, kind, ts, CASE kind WHEN 'login' THEN 'opened' WHEN 'refresh' THEN CASE WHEN is_open AND NOT stale THEN 'rotated' ELSE 'rejected' END
  WHEN 'logout' THEN CASE WHEN is_open THEN 'closed' ELSE 'ignored' END ELSE 'closed_all' END AS outcome FROM opened)
"""


@query(FOLD + "SELECT id, user_id, session, kind, outcome FROM session_outcomes")
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_fold(V.session_events(spark, sf_dir))


#: Sessions last two days here and are remembered for one more.
_MACHINE_SECONDS = (2 * 86400, 86400)
MACHINE = """
, keys AS (SELECT DISTINCT user_id, session FROM session_events),
placed AS (
  SELECT k.user_id, k.session, e.id, e.ts, e.kind, e.digest, e.new_digest, row_number() OVER (PARTITION BY k.user_id, k.session ORDER BY e.ts, e.id) AS n
  FROM keys k JOIN machine_events e ON e.user_id = k.user_id AND (e.session = k.session OR e.kind = 'logout_all')),
walked AS (
  WITH RECURSIVE walk AS (
    SELECT user_id, session, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS held, NULL::TIMESTAMP AS until, NULL::VARCHAR AS outcome, 0::BIGINT AS shut FROM keys
    UNION ALL
    SELECT user_id, session, n, id,
      CASE outcome WHEN 'opened' THEN new_digest WHEN 'rotated' THEN new_digest WHEN 'closed' THEN NULL WHEN 'closed_all' THEN NULL ELSE held END,
      CASE WHEN outcome IN ('opened', 'rotated') THEN ts + INTERVAL 2 DAYS WHEN outcome IN ('closed', 'closed_all') THEN NULL ELSE until END, outcome,
      CASE WHEN outcome = 'closed_all' THEN alive WHEN outcome = 'closed' THEN 1 ELSE 0 END
    FROM (SELECT p.*, w.held, w.until, (w.held IS NOT NULL AND p.ts < w.until + INTERVAL 1 DAY)::BIGINT AS alive,
            CASE p.kind WHEN 'login' THEN 'opened' WHEN 'logout_all' THEN 'closed_all'
              WHEN 'refresh' THEN CASE WHEN p.digest IS DISTINCT FROM w.held OR w.held IS NULL OR p.ts >= w.until + INTERVAL 1 DAY THEN 'rejected'
                WHEN p.ts >= w.until THEN 'expired' ELSE 'rotated' END
              ELSE CASE WHEN p.digest IS DISTINCT FROM w.held OR w.held IS NULL OR p.ts >= w.until + INTERVAL 1 DAY THEN 'ignored' ELSE 'closed' END END AS outcome
          FROM walk w JOIN placed p ON p.user_id = w.user_id AND p.session = w.session AND p.n = w.n + 1))
  SELECT id, any_value(outcome) AS outcome, sum(shut)::BIGINT AS closed FROM walk WHERE n > 0 GROUP BY id)
SELECT e.id, e.user_id, e.session, e.kind, w.outcome, w.closed FROM machine_events e JOIN walked w USING (id)
"""


@query(MACHINE)
def session_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_machine(V.machine_events(spark, sf_dir), *_MACHINE_SECONDS)
