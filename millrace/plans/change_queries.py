"""Changes of whole tables over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import validation
from millrace.operators import changes as M
from millrace.plans import views as V
from millrace.plans.base import query
from millrace.sources import payloads
from millrace.sources.tables import shared_path
from millrace.sources.units import Store

AS_OF = "2025-01-01"


@query("""
SELECT id, email, role, is_active, is_app_admin FROM accounts
UNION ALL SELECT id + 1000000, email, CASE WHEN id % 17 = 0 THEN 'user' ELSE role END, true, false FROM raw_accounts WHERE id % 5 = 0
""")
def insert_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.raw_accounts(spark, sf_dir).filter("id % 5 = 0")
    batch = rows.select((F.col("id") + 1000000).alias("id"), "email", F.when(F.col("id") % 17 != 0, F.col("role")).alias("role"))
    defaults = {"role": F.lit("user"), "is_active": F.lit(True), "is_app_admin": F.lit(False), "created_at": F.lit(AS_OF).cast("timestamp")}
    return M.insert(V.accounts(spark, sf_dir), batch, defaults).select("id", "email", "role", "is_active", "is_app_admin")


_PATCHED = f"""
, patches AS (SELECT o_custkey AS id, o_orderkey AS arrival, o_orderkey % 2 = 0 AS sends_name, o_orderkey % 3 = 0 AS sends_role,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS full_name, CASE WHEN o_orderkey % 6 <> 0 THEN 'admin' END AS role FROM orders),
names AS (SELECT id, max(arrival) AS at FROM patches WHERE sends_name GROUP BY id),
roles AS (SELECT id, max(arrival) AS at FROM patches WHERE sends_role AND role IS NOT NULL GROUP BY id),
new AS (SELECT a.id, a.full_name AS old_name, a.role AS old_role,
    CASE WHEN n.id IS NULL THEN a.full_name ELSE np.full_name END AS full_name, CASE WHEN r.id IS NULL THEN a.role ELSE rp.role END AS role
  FROM accounts a LEFT JOIN names n USING (id) LEFT JOIN patches np ON np.arrival = n.at
  LEFT JOIN roles r ON r.id = a.id LEFT JOIN patches rp ON rp.arrival = r.at)
SELECT id, full_name, role, CASE WHEN full_name IS DISTINCT FROM old_name OR role IS DISTINCT FROM old_role THEN TIMESTAMP '{AS_OF}' END AS updated_at FROM new
"""


@query(_PATCHED)
def patch_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    patched = M.patch(V.accounts(spark, sf_dir), _patches(spark, sf_dir), ["full_name", "role"], F.lit(AS_OF).cast("timestamp"))
    return patched.select("id", "full_name", "role", "updated_at")


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    sent = F.array_compact(F.array(F.when(k % 2 == 0, "full_name"), F.when(k % 3 == 0, "role")))
    return V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        k.alias("arrival"),
        sent.alias("set_fields"),
        F.when(k % 4 != 0, F.col("o_orderpriority")).alias("full_name"),
        F.when(k % 6 != 0, "admin").alias("role"),
    )


@query("""
SELECT id, user_id, refresh_token_hash, is_active, expires_at FROM sessions
UNION ALL SELECT id + 10000000, user_id, sha256('login' || id), true, ts + INTERVAL 30 DAYS FROM logins
""")
def open_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    logins = V.events_of(spark, sf_dir, "signup").withColumn("token", F.concat(F.lit("login"), F.col("id").cast("string")))
    opened = M.open_sessions(V.sessions(spark, sf_dir), logins.withColumn("id", F.col("id") + 10000000))
    return opened.select("id", "user_id", "refresh_token_hash", "is_active", "expires_at")


@query("""
SELECT id, CASE WHEN id % 3 = 0 THEN sha256('new' || id) ELSE refresh_token_hash END AS refresh_token_hash,
  CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 40 DAYS ELSE expires_at END AS expires_at,
  CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 10 DAYS ELSE last_used_at END AS last_used_at,
  CASE WHEN id % 6 = 0 THEN '192.0.2.1' ELSE ip_address END AS ip_address FROM sessions
""")
def rotate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions, k = V.sessions(spark, sf_dir), F.col("id")
    rotations = sessions.filter("id % 3 = 0").select(
        "id",
        F.concat(F.lit("new"), k.cast("string")).alias("token"),
        (F.col("created_at") + F.expr("INTERVAL 10 DAYS")).alias("ts"),
        F.when(k % 6 == 0, "192.0.2.1").alias("ip_address"),
    )
    return M.rotate(sessions, rotations).select("id", "refresh_token_hash", "expires_at", "last_used_at", "ip_address")


@query("SELECT id, is_active AND id % 4 <> 0 AS is_active FROM sessions")
def close_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = V.sessions(spark, sf_dir)
    digests = sessions.filter("id % 4 = 0").select(F.col("refresh_token_hash").alias("digest"))
    return M.close(sessions, digests).select("id", "is_active")


@query("SELECT id, user_id, is_active AND NOT (user_id >= 0 AND user_id % 5 = 0) AS is_active FROM sessions")
def revoke_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = V.accounts(spark, sf_dir).filter("id % 5 = 0").select(F.col("id").alias("user_id"))
    return M.revoke_all(V.sessions(spark, sf_dir), users).select("id", "user_id", "is_active")


@query("""
, new AS (SELECT id, CASE WHEN id % 3 = 0 THEN upper(email) ELSE email END AS email, CASE WHEN id % 4 = 0 THEN NULL ELSE full_name END AS full_name FROM accounts WHERE id % 10 <> 0
  UNION ALL SELECT id + 1000000, email, full_name FROM accounts WHERE id % 20 = 0)
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN o.id IS NULL OR n.id IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN o.email IS DISTINCT FROM n.email THEN 'email' END,
    CASE WHEN o.full_name IS DISTINCT FROM n.full_name THEN 'full_name' END], lambda x: x IS NOT NULL), ',') END AS fields
FROM accounts o FULL JOIN new n ON o.id = n.id
WHERE o.id IS NULL OR n.id IS NULL OR o.email IS DISTINCT FROM n.email OR o.full_name IS DISTINCT FROM n.full_name
""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, k = V.accounts(spark, sf_dir).select("id", "email", "full_name"), F.col("id")
    changed = old.filter("id % 10 <> 0").select("id", F.when(k % 3 == 0, F.upper("email")).otherwise(F.col("email")).alias("email"), F.when(k % 4 != 0, F.col("full_name")).alias("full_name"))
    added = old.filter("id % 20 = 0").withColumn("id", k + 1000000)
    rows = M.diff(old, changed.unionByName(added), ["email", "full_name"])
    return rows.select("id", "change", F.array_join("fields", ",").alias("fields"))


def _store(spark: SparkSession, sf_dir: str, buckets: int = 16) -> Store:
    """Accounts by id and sessions by user in a new store, put there by one unit."""
    store = Store(spark, shared_path(spark, "store"))
    with store.unit("load", 1) as unit:
        unit.replace("accounts", V.accounts(spark, sf_dir), "id", buckets)
        unit.replace("sessions", V.sessions(spark, sf_dir), "user_id", buckets)
    return store


@query(f"""
, changed AS (SELECT id FROM accounts WHERE id % 3 = 0)
SELECT 'account' AS kind, id, CASE WHEN id % 3 = 0 THEN sha256('n' || id) ELSE hashed_password END AS secret,
  CASE WHEN id % 3 = 0 THEN TIMESTAMP '{AS_OF}' END AS updated_at, is_active FROM accounts
UNION ALL SELECT 'session', id, refresh_token_hash, NULL, is_active AND user_id NOT IN (SELECT id FROM changed) FROM sessions
""")
def commit_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New passwords sign their accounts out everywhere: both tables change in one unit, whose replay changes nothing."""
    store = _store(spark, sf_dir)
    new = V.accounts(spark, sf_dir).filter("id % 3 = 0").select("id", F.sha2(F.concat(F.lit("n"), F.col("id").cast("string")), 256).alias("hashed_password"))
    for as_of in (AS_OF, "2026-01-01"):  # the second one is a replay
        with store.unit("passwords", 1) as unit:
            unit.change("accounts", new.select("id"), lambda rows, t=as_of: M.set_passwords(rows, new, F.lit(t).cast("timestamp")))
            users = new.select(F.col("id").alias("user_id"))
            unit.change("sessions", users, lambda rows, u=users: M.revoke_all(rows, u))
    accounts = store.read("accounts").select(F.lit("account").alias("kind"), "id", F.col("hashed_password").alias("secret"), "updated_at", "is_active")
    none = F.lit(None).cast("timestamp").alias("updated_at")
    return accounts.unionByName(store.read("sessions").select(F.lit("session").alias("kind"), "id", F.col("refresh_token_hash").alias("secret"), none, "is_active"))


@query(_PATCHED)
def stored_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patches on a stored table, as three units that read and write the buckets of their accounts only."""
    store, patches = _store(spark, sf_dir, 32), _patches(spark, sf_dir)
    for number in range(3):
        mine = patches.filter(F.col("id") % 3 == number)
        with store.unit("patches", number) as unit:
            unit.change("accounts", mine.select("id"), lambda rows, p=mine: M.patch(rows, p, ["full_name", "role"], F.lit(AS_OF).cast("timestamp")))
    return store.read("accounts").select("id", "full_name", "role", "updated_at")


@query("""
SELECT id, CASE WHEN id % 3 = 0 THEN sha256('new' || id) ELSE refresh_token_hash END AS refresh_token_hash,
  CASE WHEN id % 3 = 0 THEN created_at + INTERVAL 40 DAYS ELSE expires_at END AS expires_at,
  is_active AND NOT (id % 4 = 0 AND id % 3 <> 0) AND NOT (user_id >= 0 AND user_id % 5 = 0) AS is_active FROM sessions
""")
def stored_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations, then logouts by digest, then revocations by user, as one unit on a stored table."""
    store, sessions, k = _store(spark, sf_dir), V.sessions(spark, sf_dir), F.col("id")
    new = sessions.filter("id % 3 = 0").select(
        "id", "user_id", F.concat(F.lit("new"), k.cast("string")).alias("token"), (F.col("created_at") + F.expr("INTERVAL 10 DAYS")).alias("ts"), F.lit(None).cast("string").alias("ip_address")
    )
    closed = sessions.filter("id % 4 = 0").select("user_id", F.col("refresh_token_hash").alias("digest"))
    users = V.accounts(spark, sf_dir).filter("id % 5 = 0").select(F.col("id").alias("user_id"))
    with store.unit("sessions", 1) as unit:
        unit.change("sessions", new.select("user_id"), lambda rows: M.rotate(rows, new.drop("user_id")))
        unit.change("sessions", closed.select("user_id"), lambda rows: M.close(rows, closed.select("digest")))
        unit.change("sessions", users, lambda rows: M.revoke_all(rows, users))
    return store.read("sessions").select("id", "refresh_token_hash", "expires_at", "is_active")


_BODIES = r"""
, bodies AS (
  SELECT o_orderkey AS arrival, o_custkey AS id, CASE o_orderkey % 8 WHEN 0 THEN '{"full_name": null, "role": "admin"}' WHEN 1 THEN '{"full_name": " N' || o_orderkey || '", "x": 1}'
    WHEN 2 THEN '{"is_active": "No", "role": "owner"}' WHEN 3 THEN '{"full_name": 5, "is_active": 2}' WHEN 4 THEN '{"role": null, "is_active": true, "email": " A' || o_orderkey || '@Example.com "}'
    WHEN 5 THEN '[1]' WHEN 6 THEN '{"full_name": "broken' ELSE '{"is_active": 0}' END AS body FROM orders),
read AS (SELECT *, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN body ELSE 'null' END::JSON AS j FROM bodies),
typed AS (SELECT *, ok AND json_type(j) = 'OBJECT' AS obj, json_type(j, '$.full_name') AS name_type, json_type(j, '$.role') AS role_type, json_type(j, '$.is_active') AS active_type FROM read),
fields AS (
  SELECT *, CASE WHEN obj THEN json_keys(j) ELSE [] END AS keys, CASE WHEN name_type = 'VARCHAR' THEN trim(j->>'$.full_name') END AS full_name,
    CASE WHEN role_type = 'VARCHAR' THEN j->>'$.role' END AS role, lower(trim(j->>'$.email')) AS email,
    CASE WHEN active_type = 'BOOLEAN' THEN (j->>'$.is_active')::BOOLEAN WHEN lower(j->>'$.is_active') IN ('1', 'on', 't', 'true', 'y', 'yes') THEN true
      WHEN lower(j->>'$.is_active') IN ('0', 'off', 'f', 'false', 'n', 'no') THEN false END AS is_active FROM typed),
checked AS (
  SELECT *, array_to_string(list_filter([CASE WHEN NOT ok THEN 'body:json_invalid' WHEN NOT obj THEN 'body:model_attributes_type' END,
    CASE WHEN name_type <> 'NULL' AND full_name IS NULL THEN 'body.full_name:string_type' END,
    CASE WHEN active_type <> 'NULL' AND is_active IS NULL THEN 'body.is_active:bool_parsing' END,
    CASE WHEN role NOT IN ('admin', 'user') THEN 'body.role:enum' END], lambda x: x IS NOT NULL), ',') AS errors FROM fields)
"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of partial updates, checked: of all kinds that there are, broken ones included."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    body = (
        F.when(k % 8 == 0, '{"full_name": null, "role": "admin"}')
        .when(k % 8 == 1, F.concat(F.lit('{"full_name": " N'), text, F.lit('", "x": 1}')))
        .when(k % 8 == 2, '{"is_active": "No", "role": "owner"}')
        .when(k % 8 == 3, '{"full_name": 5, "is_active": 2}')
        .when(k % 8 == 4, F.concat(F.lit('{"role": null, "is_active": true, "email": " A'), text, F.lit('@Example.com "}')))
        .when(k % 8 == 5, "[1]")
        .when(k % 8 == 6, '{"full_name": "broken')
        .otherwise('{"is_active": 0}')
    )
    rows = V.table(spark, sf_dir, "orders").select(k.alias("arrival"), F.col("o_custkey").alias("id"), body.alias("body"))
    parsed = payloads.parse_patch(rows, "body")
    parsed = parsed.withColumns({c: X.strip(F.col(c)) for c in ("full_name", "role", "password")} | {"email": X.normalize_email(F.col("email"))})
    return payloads.check_fields(parsed, [r for r in validation.account_rules() if r[3] != "missing"])


@query(_BODIES + """
SELECT arrival, array_to_string(list_filter(keys, lambda x: x <> 'x'), ',') AS set_fields, array_to_string(list_filter(keys, lambda x: x = 'x'), ',') AS unknown_fields,
  errors, email, full_name, role, is_active FROM checked
""")
def patch_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("errors", lambda e: F.concat_ws(":", F.concat_ws(".", e["loc"]), e["type"])), ",")
    joined = lambda c: F.array_join(c, ",").alias(c)
    return _bodies(spark, sf_dir).select("arrival", joined("set_fields"), joined("unknown_fields"), shown.alias("errors"), "email", "full_name", "role", "is_active")


@query(_BODIES + f"""
, good AS (SELECT * FROM checked WHERE errors = ''),
names AS (SELECT id, max(arrival) AS at FROM good WHERE list_contains(keys, 'full_name') GROUP BY id),
roles AS (SELECT id, max(arrival) AS at FROM good WHERE role IS NOT NULL GROUP BY id),
actives AS (SELECT id, max(arrival) AS at FROM good WHERE is_active IS NOT NULL GROUP BY id),
emails AS (SELECT id, max(arrival) AS at FROM good WHERE email IS NOT NULL GROUP BY id),
new AS (SELECT a.id, a.full_name AS n0, a.role AS r0, a.is_active AS a0, a.email AS e0, CASE WHEN n.id IS NULL THEN a.full_name ELSE np.full_name END AS full_name,
    coalesce(rp.role, a.role) AS role, coalesce(ap.is_active, a.is_active) AS is_active, coalesce(ep.email, a.email) AS email
  FROM accounts a LEFT JOIN names n USING (id) LEFT JOIN good np ON np.arrival = n.at LEFT JOIN roles r ON r.id = a.id LEFT JOIN good rp ON rp.arrival = r.at
  LEFT JOIN actives ac ON ac.id = a.id LEFT JOIN good ap ON ap.arrival = ac.at LEFT JOIN emails e ON e.id = a.id LEFT JOIN good ep ON ep.arrival = e.at)
SELECT id, email, full_name, role, is_active, CASE WHEN full_name IS DISTINCT FROM n0 OR role <> r0 OR is_active <> a0 OR email <> e0 THEN TIMESTAMP '{AS_OF}' END AS updated_at FROM new
""")
def patch_from_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts after the bodies that are right: what was sent decides, a null only where a field may be cleared."""
    good, _ = payloads.quarantine(_bodies(spark, sf_dir))
    fields = ["email", "full_name", "role", "is_active"]
    patched = M.patch(V.accounts(spark, sf_dir), good, fields, F.lit(AS_OF).cast("timestamp"))
    return patched.select("id", *fields, "updated_at")
