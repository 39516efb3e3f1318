"""Account queries over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import normalize_email, or_default
from millrace.operators import accounts as A
from millrace.operators.changes import insert_if_absent
from millrace.plans import views as V
from millrace.plans.base import query

_ALL = "id, email, full_name, is_active, role, is_app_admin, created_at"


def _base(df: DataFrame) -> DataFrame:
    return df.select("id", "email", "full_name", "is_active", "role", "is_app_admin", "created_at")


@query(f"SELECT {_ALL} FROM accounts")
def scan_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(V.accounts(spark, sf_dir))


@query("SELECT id, email, full_name, is_active, role, is_app_admin, avatar_url, onboarding_completed_at, oauth_provider, created_at, updated_at FROM accounts")
def public_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.accounts(spark, sf_dir).select(*A.PUBLIC)


@query("""
SELECT id, coalesce(nullif(full_name, ''), 'N/A') AS full_name, email, CASE WHEN is_app_admin THEN 'Superuser' ELSE 'User' END AS role,
       CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS status FROM accounts
""")
def display_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.display(V.accounts(spark, sf_dir))


@query("SELECT id, title, coalesce(nullif(description, ''), 'No description') AS description FROM items")
def display_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.items(spark, sf_dir).select("id", "title", or_default(F.col("description"), "No description").alias("description"))


@query("SELECT id, email, id IS NOT DISTINCT FROM 42 AS is_current FROM accounts")
def mark_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.accounts(spark, sf_dir).select("id", "email", F.col("id").eqNullSafe(F.lit(42)).alias("is_current"))


@query("SELECT id, role FROM accounts")
def typed_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.typed_role(V.accounts(spark, sf_dir)).select("id", "role")


@query("SELECT o_orderkey AS request, o_custkey + o_orderkey % 5 * 100000 AS id, a.email, a.id IS NOT NULL AS found FROM orders LEFT JOIN accounts a ON a.id = o_custkey + o_orderkey % 5 * 100000")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    keys = V.table(spark, sf_dir, "orders").select(k.alias("request"), (F.col("o_custkey") + k % 5 * 100000).alias("id"))
    return A.lookup(keys, V.accounts(spark, sf_dir), "id").select("request", "id", "email", "found")


@query(r"""
, keys AS (SELECT id AS request, lower(regexp_replace(email, '^\s+|\s+$', '', 'g')) AS email FROM raw_accounts)
SELECT request, k.email, a.id AS account_id, a.id IS NOT NULL AS found FROM keys k LEFT JOIN accounts a USING (email)
""")
def lookup_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = V.raw_accounts(spark, sf_dir).select(F.col("id").alias("request"), F.col("email").alias("given"))
    found = A.lookup_email(keys, V.accounts(spark, sf_dir), "given")
    return found.select("request", "email", F.col("id").alias("account_id"), "found")


@query(f"SELECT {_ALL} FROM accounts WHERE email ILIKE '%R.0000001_2%' OR full_name ILIKE '%R.0000001_2%'")
def search_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(A.search(V.accounts(spark, sf_dir), "R.0000001_2"))


@query("SELECT id, is_app_admin OR role = 'admin' AS is_admin, is_app_admin OR role = 'admin' OR role = 'user' AS has_user_role FROM accounts WHERE is_app_admin OR role = 'admin'")
def admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.accounts(spark, sf_dir).filter(A.is_admin())
    return rows.select("id", A.is_admin().alias("is_admin"), A.has_role("user").alias("has_user_role"))


@query("""
SELECT p.id, actor, target, coalesce(a.is_app_admin OR a.role = 'admin' OR actor = target, false) AS allowed
FROM access_pairs p LEFT JOIN accounts a ON a.id = actor
""")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.visible(V.access_pairs(spark, sf_dir), V.accounts(spark, sf_dir)).select("id", "actor", "target", "allowed")


@query("""
SELECT p.id, actor, target, CASE WHEN a.id IS NULL THEN 'unknown_actor' WHEN actor = target AND a.is_app_admin THEN 'app_admin_self'
  WHEN actor = target AND (a.is_app_admin OR a.role = 'admin') THEN 'admin_self'
  WHEN actor = target OR a.is_app_admin OR a.role = 'admin' THEN 'allowed' ELSE 'forbidden' END AS decision
FROM access_pairs p LEFT JOIN accounts a ON a.id = actor
""")
def delete_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.delete_decisions(V.access_pairs(spark, sf_dir), V.accounts(spark, sf_dir)).select("id", "actor", "target", "decision")


@query(r"""
SELECT id, lower(regexp_replace(email, '^\s+|\s+$', '', 'g')) AS email FROM raw_accounts r
WHERE EXISTS (SELECT 1 FROM accounts a WHERE a.is_active AND a.email = lower(regexp_replace(r.email, '^\s+|\s+$', '', 'g')))
""")
def recoverable(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = V.raw_accounts(spark, sf_dir).select("id", normalize_email(F.col("email")).alias("email"))
    return asked.join(V.accounts(spark, sf_dir).filter("is_active"), "email", "left_semi").select("id", "email")


@query("SELECT a.id AS account_id, s.id AS session_id, s.is_active AS session_active FROM accounts a LEFT JOIN sessions s ON s.user_id = a.id")
def accounts_with_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, s = V.accounts(spark, sf_dir), V.sessions(spark, sf_dir)
    joined = a.join(s, a["id"] == s["user_id"], "left")
    return joined.select(a["id"].alias("account_id"), s["id"].alias("session_id"), s["is_active"].alias("session_active"))


@query("SELECT i.id AS item_id, title, a.id AS owner_id, a.email AS owner_email FROM items i JOIN accounts a ON a.id = i.owner_id")
def items_with_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, a = V.items(spark, sf_dir), V.accounts(spark, sf_dir)
    return i.join(a, i["owner_id"] == a["id"]).select(i["id"].alias("item_id"), "title", "owner_id", a["email"].alias("owner_email"))


@query(r"""
, wanted AS (SELECT id AS request_id, CASE WHEN id % 4 = 0 THEN id END AS account_id, lower(regexp_replace(email, '^\s+|\s+$', '', 'g')) AS email FROM raw_accounts),
firsts AS (SELECT email, min(request_id) AS first_request FROM wanted GROUP BY email)
SELECT request_id, account_id, w.email, CASE WHEN a.id IS NOT NULL AND a.id IS DISTINCT FROM account_id THEN 'taken'
  WHEN request_id <> first_request THEN 'repeated' ELSE 'ok' END AS outcome
FROM wanted w LEFT JOIN accounts a USING (email) JOIN firsts USING (email)
""")
def email_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    asked = V.raw_accounts(spark, sf_dir).select(k.alias("request_id"), F.when(k % 4 == 0, k).alias("account_id"), "email")
    return A.conflicts(asked, V.accounts(spark, sf_dir))


@query("SELECT count(*) AS n FROM accounts")
def account_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.accounts(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM accounts WHERE email ILIKE '%1@%' OR full_name ILIKE '%1@%'")
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.search(V.accounts(spark, sf_dir), "1@").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM accounts) = 0 AS no_accounts, (SELECT count(*) FROM items WHERE owner_id < 0) = 0 AS no_items_without_owner")
def is_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda df, name: df.limit(1).agg((F.count("*") == 0).alias(name))
    return none(V.accounts(spark, sf_dir), "no_accounts").join(none(V.items(spark, sf_dir).filter("owner_id < 0"), "no_items_without_owner"), F.lit(True))


@query("SELECT id FROM accounts ORDER BY created_at, id LIMIT 1")
def first_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_account(V.accounts(spark, sf_dir))


@query(r"SELECT lower(regexp_replace(email, '^\s+|\s+$', '', 'g')) AS email, count(*) AS n FROM raw_accounts GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicates(V.raw_accounts(spark, sf_dir).select(normalize_email(F.col("email")).alias("email")), "email")


@query("SELECT owner_id, count(*) AS n_items FROM items GROUP BY owner_id")
def items_per_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.items(spark, sf_dir).groupBy("owner_id").agg(F.count("*").alias("n_items"))


@query("SELECT id, row_number() OVER (ORDER BY created_at DESC, id) - 1 AS position, (row_number() OVER (ORDER BY created_at DESC, id) - 1) // 25 + 1 AS page FROM accounts")
def page_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.accounts(spark, sf_dir).select("id", "created_at")
    return A.number_pages(rows, [F.desc("created_at"), F.asc("id")], 25).select("id", "position", "page")


@query(f"SELECT {_ALL} FROM accounts WHERE email ILIKE '%0%' OR full_name ILIKE '%0%' ORDER BY created_at DESC, id LIMIT 50 OFFSET 20")
def account_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _base(A.page(V.accounts(spark, sf_dir), "0", 20, 50))


@query("""
, found AS (SELECT * FROM accounts WHERE email ILIKE '%000001%' OR full_name ILIKE '%000001%'),
page AS (SELECT * FROM found ORDER BY created_at DESC, id LIMIT 5 OFFSET 10)
SELECT total, id, email, full_name, created_at FROM (SELECT count(*) AS total FROM found) LEFT JOIN page ON true
""")
def account_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.page_with_total(V.accounts(spark, sf_dir), "000001", 10, 5)
    return rows.select("total", "id", "email", "full_name", "created_at")


@query("""
, t AS (SELECT count(*) AS total, ceil(count(*) / 50)::BIGINT AS pages FROM accounts)
SELECT total, pages, page, (page - 1) * 50 + 1 AS first_row, least(page * 50, total) AS last_row,
  'Showing ' || ((page - 1) * 50 + 1) || ' to ' || least(page * 50, total) || ' of ' || total || ' entries' AS label
FROM t, unnest(range(1, pages + 1)) AS u(page)
""")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.page_summary(V.accounts(spark, sf_dir).agg(F.count("*").alias("total")), 50)


@query(r"""
, new AS (SELECT id + 1000000 AS id, lower(regexp_replace(email, '^\s+|\s+$', '', 'g')) AS email FROM raw_accounts WHERE id % 11 = 0 OR id % 10 = 3),
firsts AS (SELECT min(id) AS id, email FROM new GROUP BY email)
SELECT id, email FROM accounts UNION ALL SELECT id, email FROM firsts WHERE email NOT IN (SELECT email FROM accounts)
""")
def seed_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = V.raw_accounts(spark, sf_dir).filter("id % 11 = 0 OR id % 10 = 3")
    new = new.select((F.col("id") + 1000000).alias("id"), normalize_email(F.col("email")).alias("email"))
    return insert_if_absent(V.accounts(spark, sf_dir).select("id", "email"), new.groupBy("email").agg(F.min("id").alias("id")), "email")
