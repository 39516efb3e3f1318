"""Units of work over several tables, and changes of stored tables bucket by bucket."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes as M
from millrace.sources.units import Conflict, Store, Unit


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    with made.unit("load", 1) as unit:
        unit.replace("accounts", spark.range(40).select("id", F.lit("old").alias("hash")), "id", 8)
        unit.replace("sessions", spark.range(80).select("id", (F.col("id") % 40).alias("user_id"), F.lit(True).alias("is_active")), "user_id", 8)
    return made


def hashes(store, version=None):
    return {r.id: r.hash for r in store.read("accounts", version).collect()}


def active(store):
    return {r.id for r in store.read("sessions").filter("is_active").collect()}


def reset(store, unit, ids):
    keys = store.spark.createDataFrame([(i,) for i in ids], "id long")
    unit.change("accounts", keys, lambda rows: rows.withColumn("hash", F.when(F.col("id").isin(ids), "new").otherwise(F.col("hash"))))
    unit.change("sessions", keys.withColumnRenamed("id", "user_id"), lambda rows: M.revoke_all(rows, keys.withColumnRenamed("id", "user_id")))


def test_both_tables_change_together(store):
    with store.unit("reset", 1) as unit:
        reset(store, unit, [3, 4])
        assert {r.hash for r in unit.read("accounts").filter("id = 3").collect()} == {"new"}  # the unit sees its own changes
        assert hashes(store)[3] == "old"  # nobody else does yet
    assert {i for i, h in hashes(store).items() if h == "new"} == {3, 4} and active(store) == set(range(80)) - {3, 4, 43, 44}
    assert hashes(store, 1)[3] == "old"  # an old snapshot stays


def test_a_unit_that_fails_half_way_changes_nothing(store):
    before, version = hashes(store), store.version()
    with pytest.raises(Exception, match="half-way"), store.unit("reset", 1) as unit:
        keys = store.spark.createDataFrame([(5,)], "id long")
        unit.change("accounts", keys, lambda rows: rows.withColumn("hash", F.lit("new")))
        bad = F.when(F.col("id") == 45, F.raise_error(F.lit("half-way"))).otherwise(F.lit(False))
        unit.change("sessions", keys.withColumnRenamed("id", "user_id"), lambda rows: rows.withColumn("is_active", bad.cast("boolean")))
    assert hashes(store) == before and active(store) == set(range(80)) and store.version() == version


def test_replays_change_nothing(store):
    for ids in ([1], [2]):  # the second is a replay of the first by its number
        with store.unit("reset", 7) as unit:
            reset(store, unit, ids)
    assert {i for i, h in hashes(store).items() if h == "new"} == {1} and store.version() == 2
    with store.unit("reset", 6) as unit:
        assert unit.done


def test_of_two_writers_on_one_base_one_is_refused(store):
    first, second = store.unit("a", 1), store.unit("b", 1)
    reset(store, first, [1])
    reset(store, second, [2])
    first.publish()
    with pytest.raises(Conflict):
        second.publish()
    assert {i for i, h in hashes(store).items() if h == "new"} == {1}
    with store.unit("b", 1) as again:
        reset(store, again, [2])
    assert {i for i, h in hashes(store).items() if h == "new"} == {1, 2}
    same, replay = store.unit("c", 1), store.unit("c", 1)
    for unit in (same, replay):
        reset(store, unit, [3])
        unit.publish()  # the replay finds its own number there and is content
    assert store.version() == 4


def test_buckets_that_are_not_touched_keep_their_folders(store):
    before = store.manifest()["tables"]["accounts"]["parts"]
    with store.unit("reset", 1) as unit:
        reset(store, unit, [9])
    after = store.manifest()["tables"]["accounts"]["parts"]
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1


def test_rows_that_go_empty_their_bucket_and_new_keys_fill_theirs(spark, store):
    everyone = spark.range(40).select("id")
    with store.unit("gone", 1) as unit:
        unit.change("accounts", everyone, lambda rows: rows.filter("id >= 1000"))
    assert hashes(store) == {} and store.manifest()["tables"]["accounts"]["parts"] == {}
    new = spark.createDataFrame([(500, "x"), (None, "y")], "id long, hash string")
    with store.unit("new", 1) as unit:
        unit.change("accounts", new.select("id"), lambda rows: rows.unionByName(new))
    assert hashes(store) == {500: "x", None: "y"}
    with pytest.raises(ValueError, match="keys"), store.unit("new", 2) as unit:
        unit.change("accounts", new.filter("id = 500").select("id"), lambda rows: rows.unionByName(everyone.withColumn("hash", F.lit("z"))))
    assert hashes(store) == {500: "x", None: "y"}


def test_old_snapshots_expire(spark, store):
    for n in range(3):
        with store.unit("reset", n) as unit:
            reset(store, unit, [n])
    folders = lambda: {p for t in store.manifest()["tables"].values() for p in t["parts"].values()}
    kept = folders()
    store.expire(keep=1)
    assert store.version() == 4 and folders() == kept and len(hashes(store)) == 40
    with pytest.raises(Exception, match="does not exist"):
        store.read("accounts", 1)


def test_rotations_of_one_session_are_folded(spark):
    sessions = spark.createDataFrame([(1, "h", "a", "agent", None, None), (2, "h2", "b", None, None, None)], "id long, refresh_token_hash string, ip_address string, user_agent string, expires_at timestamp, last_used_at timestamp")
    rows = [(1, "t1", "2024-01-01", "ip1", "agent1"), (1, "t2", "2024-01-02", None, None), (1, "t0", None, "ip0", None)]
    rotations = spark.createDataFrame(rows, "id long, token string, ts string, ip_address string, user_agent string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r for r in M.rotate(sessions, rotations).collect()}
    assert len(got) == 2 and str(got[1].last_used_at) == "2024-01-02 00:00:00" and str(got[1].expires_at) == "2024-02-01 00:00:00"
    assert (got[1].ip_address, got[1].user_agent, got[2].refresh_token_hash, got[2].ip_address) == ("ip1", "agent1", "h2", "b")
    assert got[1].refresh_token_hash == spark.range(1).select(F.sha2(F.lit("t2"), 256)).first()[0]


def test_of_repeats_in_a_seed_the_first_is_inserted(spark):
    table = spark.createDataFrame([("a", 1)], "email string, id long")
    batch = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2), (None, 5), (None, 4)], "email string, id long")
    assert sorted(map(tuple, M.insert_if_absent(table, batch, "email", "id").collect()), key=str) == [("a", 1), ("b", 2), (None, 4)]
    assert M.insert_if_absent(table, batch.limit(0), "email").count() == 1


def test_changes_of_the_same_buckets_are_written_once(store, monkeypatch):
    staged, real = [], Unit._stage
    monkeypatch.setattr(Unit, "_stage", lambda self, table, rows, entry: staged.append(table) or real(self, table, rows, entry))
    keys = store.spark.range(40).select("id")
    add = lambda tail: lambda rows: rows.withColumn("hash", F.concat("hash", F.lit(tail)))
    with store.unit("reset", 1) as unit:
        for tail in "abc":
            unit.change("accounts", keys, add(tail))
        assert staged == []
    assert staged == ["accounts"] and set(hashes(store).values()) == {"oldabc"}
    with store.unit("reset", 2) as unit:
        unit.change("accounts", keys, add("d"))
        assert {r.hash for r in unit.read("accounts").collect()} == {"oldabcd"}  # a read writes what waits
        unit.change("accounts", keys, add("e"))
        unit.change("accounts", keys.filter("id = 3"), lambda rows: rows.withColumn("hash", F.when(F.col("id") == 3, "f").otherwise(F.col("hash"))))
    assert staged == ["accounts"] * 4 and {i: h for i, h in hashes(store).items() if h != "oldabcde"} == {3: "f"}


def test_a_big_bucket_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        made = Store(spark, str(tmp_path / "big"))
        with made.unit("load", 1) as unit:
            unit.replace("rows", spark.range(100_000).select("id", F.lit(1).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h")), "k", 4)
        assert len(made.read("rows").inputFiles()) > 1 and made.read("rows").count() == 100_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
