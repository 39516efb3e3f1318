"""Refresh chains, the session machine and the rate limiter against plain folds; looking back along hot keys; streams against batches."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators import sessions as S
from millrace.streaming import streams

AT = datetime.datetime(2024, 1, 1)
DAY = datetime.timedelta(days=1)
ATTEMPT = "attempt long, digest string, new_digest string, token_ok boolean, at timestamp"
SESSION = "id long, user_id long, refresh_token_hash string, is_active boolean, expires_at timestamp"


def plain_chains(attempts, sessions, accounts):
    """The service's refresh, one attempt after another."""
    held = [dict(id=i, user=u, digest=h, until=e) for i, u, h, a, e in sessions if a]
    out = {}
    for attempt, digest, new, ok, at in sorted(attempts, key=lambda r: (r[4] is not None, r[4], r[0])):
        found = [s for s in held if s["digest"] == digest]
        if ok is not True:
            out[attempt] = "invalid_token"
        elif not found:
            out[attempt] = "no_active_session"
        elif len(found) > 1:
            out[attempt] = "ambiguous"
        elif at is None or found[0]["until"] is None or found[0]["until"] <= at:
            out[attempt] = "session_expired"
        elif found[0]["user"] not in accounts:
            out[attempt] = "unknown_account"
        elif not accounts[found[0]["user"]]:
            out[attempt] = "inactive_account"
        else:
            out[attempt] = "ok"
            found[0].update(digest=new, until=at + 30 * DAY)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_the_plain_fold(spark, seed):
    rng = random.Random(seed)
    sessions = [(i, i % 7, f"root{i}", i % 5 != 0, AT + (i % 4) * 10 * DAY) for i in range(12)] + [(50, 1, "twice", True, AT + 90 * DAY), (51, 2, "twice", True, AT + 90 * DAY), (52, 1, "endless", True, None)]
    accounts = {u: u != 3 for u in range(6)}
    attempts, issued, live = [], [s[2] for s in sessions] + ["unknown", None], [s[2] for s in sessions]
    for i in range(150):
        now, which = f"n{i}", rng.randrange(len(live))
        shown = live[which] if rng.random() < 0.7 else rng.choice(issued)
        ok, at = rng.choice([True] * 8 + [False, None]), None if rng.random() < 0.03 else AT + datetime.timedelta(hours=8 * i + rng.randrange(8))
        attempts.append((i, shown, now, ok, at))
        issued.append(now)
        if shown == live[which] and ok:
            live[which] = now
    attempts += [(200 + i, "root1", f"m{i}", True, AT) for i in range(40)]  # one digest over and over, at one time
    frames = spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(sessions, SESSION), spark.createDataFrame(list(accounts.items()), "id long, is_active boolean")
    got = S.refresh_chains(*frames).collect()
    want = plain_chains(attempts, sessions, accounts)
    assert len(got) == len(attempts) and {r.attempt: r.outcome for r in got} == want and list(want.values()).count("ok") > 8
    for chain in {r.session_id for r in got if r.outcome == "ok"}:
        places = sorted(r.position for r in got if r.outcome == "ok" and r.session_id == chain)
        assert places == list(range(1, len(places) + 1))


def test_a_long_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    rounds = []
    real = S.keep
    monkeypatch.setattr(S, "keep", lambda df, name: rounds.append(name) or real(df, name))
    rows = [(i, "root" if i == 0 else f"n{i - 1}", f"n{i}", True, AT + i * DAY) for i in range(100)]
    sessions = spark.createDataFrame([(1, 1, "root", True, AT + DAY)], SESSION)
    got = S.refresh_chains(spark.createDataFrame(rows, ATTEMPT), sessions, spark.createDataFrame([(1, True)], "id long, is_active boolean")).collect()
    assert sorted(r.position for r in got) == list(range(1, 101)) and rounds.count("paths") <= 9


def test_each_attempt_by_itself_denies_what_is_unknown(spark):
    sessions = spark.createDataFrame([(1, 1, "a", True, AT + DAY), (2, 1, "b", True, AT), (3, 1, "b", True, AT), (4, 1, "c", True, None)], SESSION)
    attempts = [(1, "a", None, None, AT), (2, "a", None, True, AT), (3, "b", None, True, AT), (4, "c", None, True, AT), (5, "a", None, True, None), (6, None, None, True, AT)]
    got = S.refresh_outcomes(spark.createDataFrame(attempts, ATTEMPT).drop("new_digest"), sessions, spark.createDataFrame([(1, True)], "id long, is_active boolean"))
    assert {r.attempt: r.outcome for r in got.collect()} == {1: "invalid_token", 2: "ok", 3: "ambiguous", 4: "session_expired", 5: "session_expired", 6: "no_active_session"}


def plain_machine(events, lifetime, retained):
    """The service's login, refresh, logout and logout-all, one event after another."""
    rows, out = [], {}
    for e in sorted((e for e in events if e[3] is not None), key=lambda e: (e[3], e[0])):
        i, user, session, ts, kind, digest, new = e
        mine = [r for r in rows if r["user"] == user and ts < r["until"] + retained]
        hit = [r for r in mine if r["digest"] == digest and digest is not None]
        if kind == "login":
            rows = [r for r in rows if (r["user"], r["session"]) != (user, session)]
            rows.append(dict(user=user, session=session, digest=new, until=ts + lifetime))
            out[i] = (session, "opened", 0)
        elif kind == "refresh" and hit and ts < hit[0]["until"]:
            hit[0].update(digest=new, until=ts + lifetime)
            out[i] = (hit[0]["session"], "rotated", 0)
        elif kind == "refresh":
            out[i] = (hit[0]["session"], "expired", 0) if hit else (session, "rejected", 0)
        elif kind == "logout":
            rows = [r for r in rows if r not in hit]
            out[i] = (hit[0]["session"], "closed", 1) if hit else (session, "ignored", 0)
        elif kind == "logout_all":
            rows = [r for r in rows if r["user"] != user]
            out[i] = (session, "closed_all", len(mine))
        else:
            out[i] = (session, "unknown", 0)
    return out | {e[0]: (e[2], "undated", 0) for e in events if e[3] is None}


def machine_events(seed, text=False):
    rng, issued, rows = random.Random(seed), {}, []
    for i in range(260):
        user, session = rng.choice([0, 1, 2, None]), rng.choice([0, 1, None])
        user, session = (None if v is None or not text else f"k{v}" for v in (user, session)) if text else (user, session)
        kind = rng.choice(["login", "login", "refresh", "refresh", "refresh", "logout", "logout_all", "other", None])
        own = issued.setdefault(user, [])
        digest = rng.choice(own[-3:] + [None]) if kind in ("refresh", "logout") else None
        new = f"d{i}" if kind in ("login", "refresh") else None
        if new:
            own.append(new)
        rows.append((i, user, session, None if rng.random() < 0.03 else AT + datetime.timedelta(minutes=20 * i + rng.randrange(20)), kind, digest, new))
    return rows


@pytest.mark.parametrize("text", [False, True])
def test_session_machine_and_its_stream_equal_the_plain_fold(spark, tmp_path, text):
    rows = machine_events(5, text)
    key = "string" if text else "long"
    schema = f"id long, user_id {key}, session {key}, ts timestamp, kind string, digest string, new_digest string"
    want = plain_machine(rows, datetime.timedelta(hours=6), datetime.timedelta(hours=9))
    batch = S.session_machine(spark.createDataFrame(rows, schema), 6 * 3600, 9 * 3600).collect()
    assert {r.id: (r.session, r.outcome, r.closed) for r in batch} == want and {"rotated", "expired", "closed", "closed_all"} <= {w[1] for w in want.values()}
    for part in range(3):
        piece = rows[90 * part : 90 * part + 90]
        random.Random(part).shuffle(piece)
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    stream = streams.drain(lambda feed: streams.session_machine_stream(feed, 6 * 3600, 9 * 3600, "1 hour"), feed, "machine", "ts")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch))


def test_streams_take_text_keys_nulls_and_unknown_staleness(spark, tmp_path):
    kinds = ["login", "refresh", "logout", "logout_all", "other", None]
    rng = random.Random(3)
    rows = [
        (i, rng.choice(["u", "v", None]), rng.choice(["s", None]), None if i % 29 == 0 else AT + datetime.timedelta(seconds=5 * i), rng.choice(kinds), rng.choice([True, False, None]))
        for i in range(120)
    ]
    schema = "id long, user_id string, session string, ts timestamp, kind string, stale boolean"
    batch = spark.createDataFrame(rows, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    want = S.session_fold(batch)
    got = streams.drain(lambda feed: streams.sessions_folded(feed, "1 minute"), feed, "sessions", "ts")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    pick = lambda df: df.select("id", F.col("user_id").alias("client"), "ts")
    got = streams.drain(lambda feed: streams.rate_limited(feed, 2, 60, "1 minute"), pick(feed), "limit", "ts")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, S.rate_limit(pick(batch), 2, 60).collect()))


def test_rows_later_than_the_watermark_are_dropped_and_windows_are_forgotten(spark, tmp_path):
    schema = "id long, client long, ts timestamp"
    second = lambda s: AT + datetime.timedelta(seconds=s)
    for n, piece in enumerate([[(1, 1, second(0)), (2, 1, second(1))], [(3, 2, second(600))], [(7, 3, second(610))], [(4, 1, second(2)), (5, 2, second(601))], [(6, 1, second(1200))]]):
        spark.createDataFrame(piece, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = streams.drain(lambda rows: streams.rate_limited(rows, 1, 60, "1 minute"), feed, "late", "ts")
    assert {r.id: r.allowed for r in got.collect()} == {1: True, 2: False, 3: True, 5: False, 6: True, 7: True}  # 4 came after its time had passed


def test_state_holds_what_the_watermark_has_not_passed_and_nothing_else(spark, tmp_path):
    second = lambda s: AT + datetime.timedelta(seconds=s)
    schema = "id long, client string, ts timestamp"
    for n, piece in enumerate([[(1, "a", second(0)), (2, "a", second(1))], [(3, "b", second(600))], [(4, "c", second(610))]]):
        spark.createDataFrame(piece, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{n}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    writer = streams.rate_limited(feed, 1, 60, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    keys = lambda name: {r.key.client for r in spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "state")).collect()}
    assert keys("slots") == {"b", "c"} and keys("window") == set()  # a's rows have been decided, and its window is over
    assert {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: True, 2: False}


def test_no_window_takes_a_whole_hot_key(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 0)
    events = spark.createDataFrame([(1, 1, 1, AT, "login", False)], "id long, user_id long, session long, ts timestamp, kind string, stale boolean")
    plan = S.session_fold(events)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line and "windowspecdefinition" in line]
    whole = [w for w in windows if "_range" not in w.split("windowspecdefinition(")[1].split(" ASC")[0]]
    assert len(windows) > len(whole) and all("_carried_" in w for w in whole)  # over a key alone only what its ranges end with


def plain_limit(rows, limit, window):
    state, out = {}, {}
    for us, client, i in sorted(rows, key=lambda r: (r[0], r[2])):
        start, hits = state.get(client, (None, 0))
        if start is None or us - start >= window:
            start, hits = us, 0
        allowed = hits < limit
        out[i] = (allowed, 0 if allowed else max(1, -((us - start - window) // 1_000_000)))
        state[client] = (start, hits + allowed)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_one_huge_client_is_decided_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK_HITS", chunk)
    rng = random.Random(chunk)
    rows, us = [], 0
    for i in range(700):
        us += rng.choice([0, 10_000, 400_000, 3_000_000, 3_000_000, 70_000_000])
        rows.append((us, rng.choice(["big"] * 9 + ["a", "b", None]), i))
    df = spark.createDataFrame([(i, c, AT + datetime.timedelta(microseconds=t)) for t, c, i in rows] + [(9999, "big", None)], "id long, client string, ts timestamp")
    for limit, window in ((2, 10), (1, 60), (5, 1), (300, 600)):
        got = {r.id: (r.allowed, r.retry_after) for r in S.rate_limit(df, limit, window).collect()}
        assert got.pop(9999) == (None, None) and got == plain_limit(rows, limit, window * 1_000_000)


def test_one_client_is_spread_over_tasks(spark):
    df = spark.range(200_000).select("id", F.lit("one").alias("client"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        decided = S.rate_limit(df, 300, 60)
        assert decided.groupBy(F.spark_partition_id()).count().count() >= 2
        assert decided.filter("allowed").count() == 4 * 300
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_runs_are_those_of_every_entry():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 200):
        times, window = np.sort(rng.integers(0, 400, n)), 37
        upto, start, hits = S.window_runs(times, window)
        for opens in range(int(times[0]) - 1, int(times[0]) + window + 1):
            if opens > times[-1]:
                continue
            at = int(np.searchsorted(times, opens))
            while (further := int(np.searchsorted(times, times[at] + window))) < n:
                at = further
            run = int(np.searchsorted(upto, opens))
            assert (start[run], hits[run]) == (times[at], n - at)


@pytest.mark.parametrize(("seed", "hot"), [(0, 0), (1, 100), (2, 1000)])
def test_looking_back_along_a_hot_key(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 9 + ["a", None]), rng.randrange(3), i * 7 % 500, rng.choice([None, None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, j long, t long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.seen for r in ordered.last_before(df, ["k", "j"], ["t"], {"v": "seen"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last = {}
    for i, k, j, _, v in sorted(rows, key=lambda r: r[3]):
        assert got[i] == last.get((k, j))
        last[k, j] = v if v is not None else last.get((k, j))


@pytest.mark.parametrize("hot", [0, 1000])
def test_the_session_fold_of_a_hot_user_equals_the_plain_fold(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    rng, opened, want = random.Random(6), {}, {}
    rows = [(i, rng.choice([1] * 9 + [2]), rng.randrange(4), AT + datetime.timedelta(seconds=i), rng.choice(["login", "refresh", "refresh", "logout", "logout_all"]), i % 7 == 0) for i in range(300)]
    for i, user, session, _, kind, stale in rows:
        mine = opened.setdefault(user, set())
        want[i] = S.event_outcome(kind, stale, session in mine)
        mine.update({session} if kind == "login" else ())
        mine.difference_update({session} if kind == "logout" else mine.copy() if kind == "logout_all" else ())
    events = spark.createDataFrame(rows, "id long, user_id long, session long, ts timestamp, kind string, stale boolean")
    assert {r.id: r.outcome for r in S.session_fold(events).collect()} == want


@pytest.mark.parametrize("hot", [0, 1000])
def test_revocations_at_the_time_of_a_login_count_and_issues_at_the_time_of_a_use_do_not(spark, monkeypatch, hot):
    monkeypatch.setattr(ordered, "HOT_ROWS", hot)
    logins = spark.createDataFrame([(1, 1, AT), (2, 1, AT + DAY), (3, None, AT), (4, 1, None)], "id long, user_id long, ts timestamp")
    revocations = spark.createDataFrame([(1, AT), (None, AT + DAY), (1, None)], "user_id long, ts timestamp")
    assert {r.id: r.revoked_at for r in S.revoked_at(logins, revocations).collect()} == {1: AT, 2: None, 3: AT + DAY, 4: None}
    issues = spark.createDataFrame([(1, AT, "a"), (1, AT + DAY, "b")], "session long, ts timestamp, digest string")
    uses = spark.createDataFrame([(1, 1, AT, "a"), (2, 1, AT + DAY, "a"), (3, 1, AT + 2 * DAY, "a")], "id long, session long, ts timestamp, digest string")
    assert {r.id: (r.current, r.stale) for r in S.stale_uses(issues, uses).collect()} == {1: (None, None), 2: ("a", False), 3: ("b", True)}


class Handle:
    """State of one key in memory; counts the calls that a state server would get."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, set()

    def getValueState(self, name, schema):
        return self.getMapState(name, None, schema)

    def getMapState(self, name, key, schema):
        handle, held = self, self.states.setdefault(name, {})

        def called(value=None):
            handle.calls += 1
            return value

        class State:
            get = lambda self: called(held.get(()))
            update = lambda self, value: called(held.update({(): value}))
            exists = lambda self: called(() in held)
            getValue = lambda self, at: called(held.get(at))
            updateValue = lambda self, at, value: called(held.update({at: value}))
            containsKey = lambda self, at: called(at in held)
            removeKey = lambda self, at: called(held.pop(at, None))
            iterator = lambda self: called(iter(list(held.items())))
            clear = lambda self: called(held.clear())

        return State()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def run_key(processor, handle, batches, key=1):
    """A key's batches of (rows, watermark in milliseconds) through a processor, timers in order."""
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    processor.init(handle)
    out = []
    for rows, watermark in batches:
        times = TimerValues(0, watermark)
        if rows:
            out += list(processor.handleInputRows((key,), iter(rows), times))
        for at in sorted(t for t in handle.timers if t <= watermark):
            out += list(processor.handleExpiredTimer((key,), times, ExpiredTimerInfo(at)))
            handle.timers.discard(at)
    return out


def machine_rows(n, seed, sessions=3):
    rng, rows, own = random.Random(seed), [], []
    for i in range(n):
        kind = rng.choice(["login", "login", "refresh", "refresh", "refresh", "logout"] + ["logout_all"] * (rng.random() < 0.1))
        new = f"d{i}" if kind in ("login", "refresh") else None
        rows.append(dict(id=i, us=i * 60_000_000 + rng.randrange(40_000_000), session=rng.randrange(sessions), kind=kind, digest=rng.choice(own[-4:] + [None]) if new is None or kind == "refresh" else None, new_digest=new))
        own += [new] if new else []
    return rows


def test_state_is_asked_per_key_and_not_per_row():
    """Twenty times the rows of a key in a trigger take as many calls."""
    Row = streams.Row
    made = {
        "limit": lambda: (streams.Limiter(2, 3600 * 1_000_000), 40),
        "open": lambda: (streams.OpenSessions(["id", "us", "session", "kind", "stale"]), 40),
        "machine": lambda: (streams.Machine(["id", "us", "session", "kind", "digest", "new_digest"], 86400 * 1_000_000, 3600 * 1_000_000), 80),
    }
    for make in made.values():
        for n in (40, 800):
            (processor, most), handle = make(), Handle()
            rows = [Row(**r, stale=False) for r in machine_rows(n, 1)]
            out = run_key(processor, handle, [(rows, 0), (None, n * 60_000 - 600_000), (None, 10**12)])
            assert len(out) == n and handle.calls <= most, (processor, n, handle.calls)
            assert not any(handle.states.values()) or set(k for k, v in handle.states.items() if v) <= {"index", "open"}


@pytest.mark.parametrize(("run", "sort", "whole"), [(1, 7, 0), (4, 1 << 16, 256), (1024, 20, 0), (1024, 1 << 16, 256)])
def test_held_rows_and_entries_in_pieces_give_the_same(monkeypatch, run, sort, whole):
    monkeypatch.setattr(streams, "RUN_ROWS", run)
    monkeypatch.setattr(streams, "SHORT_ROWS", min(run, 2))
    monkeypatch.setattr(streams, "SORT_ROWS", sort)
    monkeypatch.setattr(streams, "WHOLE_ENTRIES", whole)
    rows, rng, columns = machine_rows(400, 2, 9), random.Random(4), ["id", "us", "session", "kind", "digest", "new_digest"]
    lifetime, retained = 150 * 1_000_000, 1200 * 1_000_000
    want, sessions, digests = [], {}, {}
    for r in rows:
        session, outcome, closed, _ = S.machine_step(sessions, digests, r, lifetime, retained)
        want.append((r["id"], session, outcome, closed))
    late, batches, at = [], [], 0
    while at < len(rows):  # rows come up to some 30 minutes late, in steps of unequal size; the watermark is as far behind
        step = rng.choice([3, 10, 60])
        new, at = [*late, *rows[at : at + step]], at + step
        rng.shuffle(new)
        late, new = new[:2], new[2:]
        behind = min(r["us"] for r in [*late, *rows[at : at + 1], {"us": 10**18}])
        batches.append(([streams.Row(**r) for r in new], min(max(0, behind // 1000 - 1), 10**9)))
    batches += [([streams.Row(**r) for r in late], batches[-1][1]), (None, 10**12)]
    handle = Handle()
    out = run_key(streams.Machine(columns, lifetime, retained), handle, batches)
    assert [(r.id, r.session, r.outcome, r.closed) for r in out] == want
    assert {w[2] for w in want} >= {"opened", "rotated", "expired", "closed", "closed_all"}
    folds = [streams.event_outcome(*x) for x in _opens(rows)]
    out = run_key(streams.OpenSessions(["id", "us", "session", "kind", "stale"]), Handle(), [([streams.Row(**r.asDict(), stale=r.id % 5 == 0) for r in b or ()], w) for b, w in batches])
    assert [r.outcome for r in out] == folds


def _opens(rows):
    now = set()
    for r in rows:
        yield r["kind"], r["id"] % 5 == 0, r["session"] in now
        now = now | {r["session"]} if r["kind"] == "login" else set() if r["kind"] == "logout_all" else now - {r["session"]} if r["kind"] == "logout" else now
