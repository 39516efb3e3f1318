"""Account queries: search, lookup, visibility, pages, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import normalize_email, or_default, search_pattern
from millrace.sources.tables import shared_path

PUBLIC = [
    "id", "email", "full_name", "is_active", "role", "is_app_admin", "avatar_url", "onboarding_completed_at",
    "oauth_provider", "created_at", "updated_at",
]
ROLES = ["admin", "user"]
MOST_PER_PAGE = 200


def is_admin() -> Column:
    return F.col("is_app_admin") | (F.col("role") == "admin")


def has_role(role: str) -> Column:
    """Admins have every role."""
    return is_admin() | (F.col("role") == role)


def typed_role(accounts: DataFrame) -> DataFrame:
    """Fails on a role that is none."""
    bad = F.raise_error(F.concat(F.lit("not a role: "), F.coalesce("role", F.lit("null"))))
    return accounts.withColumn("role", F.when(F.col("role").isin(ROLES), F.col("role")).otherwise(bad.cast("string")))


def search(accounts: DataFrame, text: str | None) -> DataFrame:
    """Accounts with ``text`` in email or name, in any case; no text, no filter. A null name is no match by itself."""
    if not text:
        return accounts
    pattern = search_pattern(text)
    return accounts.filter(F.col("email").ilike(pattern) | F.col("full_name").ilike(pattern))


def page(accounts: DataFrame, text: str | None, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page, newest first, ties by id."""
    if skip < 0 or not 1 <= limit <= MOST_PER_PAGE or len(text or "") > 255:
        raise ValueError("skip must be 0 or more, limit 1 to 200, and search at most 255 characters")
    return search(accounts, text).orderBy(F.desc("created_at"), "id").offset(skip).limit(limit)


def page_with_total(accounts: DataFrame, text: str | None, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page, each row with the number of all matches; an empty page is one row of nulls with the total."""
    total = search(accounts, text).agg(F.count("*").alias("total"))
    rows = page(accounts, text, skip, limit)
    return total.join(F.broadcast(rows), F.lit(True), "left")  # at most MOST_PER_PAGE rows


def number_pages(df: DataFrame, order: list[Column], size: int, name: str = "page") -> DataFrame:
    """Every row's ``position`` (from 0) in the whole order and its page (from 1), without a global window.

    Rows are dealt out by ranges of the order and written with the number of their range, so that a lost executor cannot
    deal them anew; counts per range give each range's first position.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, "ranges")
    dealt = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(path)
    ranged = spark.read.schema(dealt.schema).parquet(path)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    first = counts.select(
        "_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first")
    )
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    position = (F.col("_first") + F.col("_row") - 1).cast("long")
    joined = numbered.join(F.broadcast(first), "_range").withColumn("position", position)
    return joined.withColumn(name, (F.floor(F.col("position") / size) + 1).cast("long")).drop("_range", "_row", "_first")


def page_summary(total: DataFrame, size: int) -> DataFrame:
    """From one row with ``total``: one row per page with its number, first and last row, and "x to y of z". Only the total
    comes to the driver; pages are made by tasks."""
    n = total.first()["total"]
    pages = -(-n // size)
    numbered = total.sparkSession.range(1, pages + 1).select(F.lit(n).alias("total"), F.lit(pages).cast("long").alias("pages"), F.col("id").alias("page"))
    rows = numbered.withColumn("first_row", (F.col("page") - 1) * size + 1).withColumn("last_row", F.least(F.col("page") * size, F.col("total")))
    return rows.withColumn("label", F.format_string("Showing %d to %d of %d entries", "first_row", "last_row", "total"))


def lookup(keys: DataFrame, accounts: DataFrame, key: str) -> DataFrame:
    """Every key with its account and whether there is one."""
    there = accounts.withColumn("found", F.lit(True))
    return keys.join(there, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def lookup_email(keys: DataFrame, accounts: DataFrame, column: str) -> DataFrame:
    """Keys are normalised first; stored emails are compared as they are."""
    return lookup(keys.withColumn("email", normalize_email(F.col(column))), accounts, "email")


def visible(pairs: DataFrame, accounts: DataFrame) -> DataFrame:
    """(actor, target) pairs with whether the actor sees the target: their own row, or any for admins."""
    actors = accounts.select(F.col("id").alias("actor"), is_admin().alias("actor_is_admin"))
    seen = F.coalesce(F.col("actor_is_admin") | (F.col("actor") == F.col("target")), F.lit(False))
    return pairs.join(actors, "actor", "left").withColumn("allowed", seen).drop("actor_is_admin")


def delete_decisions(pairs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Decision on each (actor, target) deletion: by the app admin or admin on themselves it is refused."""
    actors = accounts.select(F.col("id").alias("actor"), "is_app_admin", is_admin().alias("admin"))
    self = F.col("actor") == F.col("target")
    decision = (
        F.when(F.col("admin").isNull(), "unknown_actor")
        .when(self & F.col("is_app_admin"), "app_admin_self")
        .when(self & F.col("admin"), "admin_self")
        .when(self | F.col("admin"), "allowed")
        .otherwise("forbidden")
    )
    return pairs.join(actors, "actor", "left").withColumn("decision", decision).drop("is_app_admin", "admin")


def display(accounts: DataFrame) -> DataFrame:
    """What a table of accounts shows."""
    return accounts.select(
        "id",
        or_default(F.col("full_name"), "N/A").alias("full_name"),
        "email",
        F.when(F.col("is_app_admin"), "Superuser").otherwise("User").alias("role"),
        F.when(F.col("is_active"), "Active").otherwise("Inactive").alias("status"),
    )


def conflicts(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests (``request_id, account_id`` or null, ``email``) with ``outcome``: taken by another account, taken by an
    earlier request for the same email, without an email, or ok. Every request comes back."""
    wanted = requests.withColumn("email", normalize_email(F.col("email")))
    holders = accounts.select(F.col("email"), F.col("id").alias("holder"))
    first = wanted.groupBy("email").agg(F.min("request_id").alias("first_request"))
    joined = wanted.join(holders, "email", "left").join(first, "email", "left")
    taken = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("account_id"))
    outcome = F.when(F.col("email").isNull(), "no_email").when(taken, "taken").when(F.col("request_id") != F.col("first_request"), "repeated").otherwise("ok")
    return joined.select("request_id", "account_id", "email", outcome.alias("outcome"))


def first_account(accounts: DataFrame) -> DataFrame:
    """The earliest account (ties by id), which becomes the administrator."""
    return accounts.agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
