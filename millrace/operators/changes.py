"""Changes as whole-table functions: the current table and a batch in, the new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import expires_at

CLEARABLE = ("full_name", "avatar_url")


def insert(table: DataFrame, batch: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """The table with the batch; columns that the batch lacks or has as null get their default."""
    filled = batch.withColumns({c: F.coalesce(F.col(c), d) if c in batch.columns else d for c, d in defaults.items()})
    return table.unionByName(filled, allowMissingColumns=True)


def insert_if_absent(table: DataFrame, batch: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table with those rows of the batch whose key it does not have. Of batch rows that repeat a key the first by ``order`` (by all
    columns without it) is inserted, as later ones would find it there. A null key is a key like any other."""
    absent = batch.join(table.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    whole = F.struct(*([F.col(order).alias("_order")] if order else []), *batch.columns)
    first = absent.groupBy(F.col(key).alias("_key")).agg(F.min(whole).alias("_row"))
    return table.unionByName(first.select(*[F.col("_row")[c].alias(c) for c in batch.columns]), allowMissingColumns=True)


def set_passwords(table: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Accounts with the digests in ``new`` (id, hashed_password); of several for one account the largest. ``updated_at`` becomes ``as_of`` where a
    digest changed."""
    given = new.groupBy("id").agg(F.max("hashed_password").alias("_digest"))
    differs = F.col("_digest").isNotNull() & ~F.col("_digest").eqNullSafe(F.col("hashed_password"))
    changed = {"updated_at": F.when(differs, as_of).otherwise(F.col("updated_at")), "hashed_password": F.coalesce("_digest", "hashed_password")}
    return table.join(given, "id", "left").withColumns(changed).select(table.columns)


def patch(table: DataFrame, patches: DataFrame, fields: list[str], as_of: Column, clearable: tuple[str, ...] = CLEARABLE) -> DataFrame:
    """Partial updates. ``patches``: id, arrival, set_fields (array) and new values.

    Only fields that were sent change, and a null only where the field may be cleared. Of several patches of a row the last
    one that sends a field (by arrival) decides it. ``updated_at`` becomes ``as_of`` where a value really changed.
    """

    def sends(f: str) -> Column:
        given = F.array_contains("set_fields", f)
        return given if f in clearable else given & F.col(f).isNotNull()

    latest = [F.max_by(F.struct(F.col(f).alias("v")), F.when(sends(f), F.col("arrival"))).alias(f"_{f}") for f in fields]
    folded = patches.groupBy("id").agg(*[F.max(F.when(sends(f), 1)).alias(f"_{f}_sent") for f in fields], *latest)
    joined = table.join(folded, "id", "left")
    new = {f: F.when(F.col(f"_{f}_sent").isNotNull(), F.col(f"_{f}.v")).otherwise(F.col(f)) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~new[f].eqNullSafe(F.col(f))
    values = [new[c].alias(c) if c in new else F.when(changed, as_of).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in table.columns]
    return joined.select(*values)


def delete_cascade(parents: DataFrame, children: DataFrame, keys: DataFrame, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the keys (one column, ``id``)."""
    return parents.join(keys, "id", "left_anti"), children.join(keys.withColumnRenamed("id", foreign), foreign, "left_anti").select(children.columns)


def open_sessions(sessions: DataFrame, logins: DataFrame) -> DataFrame:
    """Sessions with those that ``logins`` (id, user_id, token, ts) open; they last as long as their refresh token."""
    opened = logins.select(
        "id",
        "user_id",
        F.sha2(F.col("token"), 256).alias("refresh_token_hash"),
        F.lit(True).alias("is_active"),
        F.col("ts").alias("created_at"),
        expires_at(F.col("ts"), "refresh").alias("expires_at"),
    )
    return sessions.unionByName(opened, allowMissingColumns=True)


def rotate(sessions: DataFrame, rotations: DataFrame) -> DataFrame:
    """New digest, expiry and last use for sessions in ``rotations`` (id, token, ts, ip_address and, if both tables have it, user_agent).

    Of several rotations of a session the last one (by ts, then token; those without ts first) gives digest, expiry and last use, and
    the last one that gives an address or agent gives that: these are replaced only where given. Every session stays one row.
    """
    given = [c for c in ("ip_address", "user_agent") if c in rotations.columns and c in sessions.columns]
    order = F.struct("ts", "token")
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}") for c in given]
    new = rotations.groupBy("id").agg(F.max(order).alias("_last"), *latest)
    hit = F.col("_last").isNotNull()
    changed = {
        "refresh_token_hash": F.when(hit, F.sha2(F.col("_last.token"), 256)).otherwise(F.col("refresh_token_hash")),
        "expires_at": F.when(hit, expires_at(F.col("_last.ts"), "refresh")).otherwise(F.col("expires_at")),
        "last_used_at": F.when(hit, F.col("_last.ts")).otherwise(F.col("last_used_at")),
    }
    return sessions.join(new, "id", "left").withColumns(changed | {c: F.coalesce(f"_{c}", c) for c in given}).select(sessions.columns)


def close(sessions: DataFrame, digests: DataFrame) -> DataFrame:
    """Sessions with any of the digests (column ``digest``) inactive; unknown digests do nothing."""
    hits = digests.select(F.col("digest").alias("refresh_token_hash"), F.lit(True).alias("_hit")).distinct()
    return sessions.join(hits, "refresh_token_hash", "left").withColumn("is_active", F.col("is_active") & F.col("_hit").isNull()).select(sessions.columns)


def revoke_all(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """All sessions of the users (column ``user_id``) inactive."""
    hits = users.select("user_id").distinct().withColumn("_hit", F.lit(True))
    return sessions.join(hits, "user_id", "left").withColumn("is_active", F.col("is_active") & F.col("_hit").isNull()).select(sessions.columns)


def revoked_counts(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """For each user how many active sessions a revocation closes, zero included."""
    active = sessions.filter("is_active").groupBy("user_id").agg(F.count("*").alias("n"))
    return users.select("user_id").distinct().join(active, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("revoked"))


def diff(old: DataFrame, new: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """``key, change, fields``: added, removed or changed rows and, for changed ones, the names of the fields that differ."""
    a = old.select(key, F.lit(True).alias("_old"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    b = new.select(key, F.lit(True).alias("_new"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_old_{f}").eqNullSafe(F.col(f"_new_{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    rows = a.join(b, key, "full").select(key, change.alias("change"), F.when(change == "changed", differs).otherwise(F.array()).alias("fields"))
    return rows.filter((F.col("change") != "changed") | (F.size("fields") > 0))
