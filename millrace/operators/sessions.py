"""Session and request rules: authentication outcomes, revocation, replay, limits."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import expires_at
from millrace.operators.ordered import last_before
from millrace.sources.tables import keep

EXEMPT = ["/docs", "/redoc", "/api/v1/openapi.json", "/api/v1/utils/health-check"]


def non_exempt(requests: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """HTTP requests whose path starts with none of the prefixes."""
    exempt = F.lit(False)
    for prefix in prefixes or EXEMPT:
        exempt = exempt | F.col("path").startswith(prefix)
    return requests.filter((F.col("scope") == "http") & ~exempt)


def expired(sessions: DataFrame, as_of: Column) -> DataFrame:
    return sessions.filter(F.col("expires_at") <= as_of)


def refresh_outcomes(attempts: DataFrame, sessions: DataFrame, accounts: DataFrame) -> DataFrame:
    """``attempts`` (attempt, digest, token_ok, at) with the outcome of the first rule that fails, each taken by itself.

    ``would_deactivate`` says that the rule would close the session; the attempt fails as a whole, so the stored
    session stays as it is. A token whose check is unknown (null) is invalid, and a session counts as expired where either time is unknown. A
    digest that several active sessions have is ambiguous. Every attempt comes back once.
    """
    joined = attempts.join(_by_digest(sessions, accounts), "digest", "left")
    outcome = (
        F.when(~_holds("token_ok"), "invalid_token")
        .when(F.col("holders").isNull(), "no_active_session")
        .when(F.col("holders") > 1, "ambiguous")
        .when(~_holds(F.col("at") < F.col("until")), "session_expired")
        .when(F.col("owner_active").isNull(), "unknown_account")
        .when(~F.col("owner_active"), "inactive_account")
        .otherwise("ok")
    )
    rows = joined.select("attempt", "digest", "session_id", "user_id", outcome.alias("outcome"))
    return rows.withColumn("would_deactivate", F.col("outcome").isin("session_expired", "inactive_account"))


def _holds(condition: Column | str) -> Column:
    """Whether a condition is true; unknown counts as false."""
    return F.coalesce(F.col(condition) if isinstance(condition, str) else condition, F.lit(False))


def _by_digest(sessions: DataFrame, accounts: DataFrame) -> DataFrame:
    """``digest, holders, session_id, user_id, until, owner_active``: one row per digest of active sessions; those of several holders name none."""
    held = sessions.filter("is_active").groupBy(F.col("refresh_token_hash").alias("digest")).agg(
        F.count("*").alias("holders"), F.max(F.struct("id", "user_id", "expires_at")).alias("s")
    )
    one = lambda c: F.when(F.col("holders") == 1, F.col(f"s.{c}"))
    named = held.select("digest", "holders", one("id").alias("session_id"), one("user_id").alias("user_id"), one("expires_at").alias("until"))
    owners = accounts.select(F.col("id").alias("user_id"), F.col("is_active").alias("owner_active"))
    return named.join(owners, "user_id", "left")


def refresh_chains(attempts: DataFrame, sessions: DataFrame, accounts: DataFrame) -> DataFrame:
    """``attempts`` (attempt, digest, new_digest, token_ok, at) of one batch, each against what those before it have left.

    An attempt that succeeds retires the digest it presents and issues ``new_digest``, which lasts as long as a refresh token; later
    attempts (by at, then attempt) find only that one. Returns ``attempt, digest, session_id, user_id, outcome, position`` (the place in its
    session's chain of successes, from 1). Outcomes are those of ``refresh_outcomes``; ``no_active_session`` covers digests that are unknown,
    used before, not issued yet or issued by an attempt that failed. Attempts on a digest with more than one source are ambiguous. Failing
    attempts change nothing. Attempts without a time have expired.

    Whether an attempt is the first that may use its digest does not depend on the others' fates: so each digest has one candidate, candidates
    form paths from digest to digest, and only whether a path starts at an active session is open. Pointer doubling decides that in as
    many rounds as the logarithm of the longest path; each round joins candidates by attempt, and no key is hot, since every candidate has at most one
    successor. A digest that very many attempts present is reduced to its first one in each task before it is shuffled.
    """
    order = F.struct("at", "attempt")
    nothing = lambda c: F.lit(None).cast(dict(attempts.dtypes)[c])
    roots = _by_digest(sessions, accounts).select(
        "digest", "holders", "session_id", "user_id", "until", "owner_active", nothing("attempt").alias("issuer"), nothing("at").alias("issued_at")
    )
    issued = attempts.filter(_holds("token_ok") & F.col("new_digest").isNotNull()).select(
        F.col("new_digest").alias("digest"), F.lit(1).cast("long").alias("holders"), F.lit(None).cast(dict(roots.dtypes)["session_id"]).alias("session_id"),
        F.lit(None).cast(dict(roots.dtypes)["user_id"]).alias("user_id"), expires_at(F.col("at"), "refresh").alias("until"), F.lit(True).alias("owner_active"),
        F.col("attempt").alias("issuer"), F.col("at").alias("issued_at"),
    )
    fields = ["session_id", "user_id", "until", "owner_active", "issuer", "issued_at"]
    sources = roots.unionByName(issued).groupBy("digest").agg(F.sum("holders").alias("holders"), F.max(F.struct(*fields)).alias("s"))
    joined = attempts.join(sources.select("digest", "holders", "s.*"), "digest", "left").drop("new_digest")
    first = F.col("issuer").isNull() | _holds(F.struct("issued_at", "issuer") < order)
    may = _holds("token_ok") & _holds(F.col("holders") == 1) & first & _holds(F.col("at") < F.col("until")) & _holds("owner_active")
    rows = keep(joined.withColumns({"first": first, "may": may}), "attempts")

    winners = rows.filter("may").groupBy("digest").agg(F.min(order).alias("won"), F.min_by(F.struct("issuer", "session_id", "user_id"), order).alias("s"))
    paths = keep(winners.select(F.col("won.attempt").alias("attempt"), F.col("s.issuer").alias("up"), "s.session_id", "s.user_id", F.lit(1).cast("long").alias("position")), "paths")
    while not paths.filter("up IS NOT NULL").isEmpty():
        above = paths.select(F.col("attempt").alias("up"), F.col("up").alias("next"), F.col("session_id").alias("s"), F.col("user_id").alias("u"), F.col("position").alias("p"))
        moved = paths.filter("up IS NOT NULL").join(above, "up")  # a path without a start is lost here
        moved = moved.select("attempt", F.col("next").alias("up"), F.col("s").alias("session_id"), F.col("u").alias("user_id"), (F.col("position") + F.col("p")).alias("position"))
        paths = keep(paths.filter("up IS NULL").unionByName(moved), "paths")

    good = paths.select(F.col("attempt").alias("issuer"), F.col("session_id").alias("chain"), F.col("user_id").alias("chain_user"), F.col("position").alias("before"))
    fate = rows.join(winners.select("digest", "won"), "digest", "left").join(good, "issuer", "left")
    alive = F.col("issuer").isNull() | (F.col("before").isNotNull() & F.col("first"))
    outcome = (
        F.when(~_holds("token_ok"), "invalid_token")
        .when(F.col("holders").isNull(), "no_active_session")
        .when(F.col("holders") > 1, "ambiguous")
        .when(~alive | _holds(F.col("won") < order), "no_active_session")
        .when(~_holds(F.col("at") < F.col("until")), "session_expired")
        .when(F.col("owner_active").isNull(), "unknown_account")
        .when(~F.col("owner_active"), "inactive_account")
        .otherwise("ok")
    )
    named = F.col("holders").isNotNull() & (F.col("holders") == 1) & alive
    return fate.withColumn("outcome", outcome).select(
        "attempt",
        "digest",
        F.when(named, F.coalesce("session_id", "chain")).alias("session_id"),
        F.when(named, F.coalesce("user_id", "chain_user")).alias("user_id"),
        "outcome",
        F.when(F.col("outcome") == "ok", F.coalesce("before", F.lit(0)) + 1).alias("position"),
    )


def resolve_subjects(claims: DataFrame, accounts: DataFrame) -> DataFrame:
    """``claims`` (token_id, sub as text) with the outcome of resolving the subject to an active account."""
    owners = accounts.select(F.col("id"), F.col("is_active").alias("owner_active"))
    keyed = claims.withColumn("id", F.col("sub").try_cast("long"))
    outcome = (
        F.when(F.col("id").isNull(), "bad_claim")
        .when(F.col("owner_active").isNull(), "unknown_account")
        .when(~F.col("owner_active"), "inactive_account")
        .otherwise("ok")
    )
    return keyed.join(owners, "id", "left").select("token_id", "sub", outcome.alias("outcome"))


def revoked_at(logins: DataFrame, revocations: DataFrame) -> DataFrame:
    """``logins`` (id, user_id, ts) with the earliest revocation of their user at or after them; none for a login without a time."""
    both = logins.select("id", "user_id", "ts", F.lit(True).alias("_asks"), F.lit(None).cast("timestamp").alias("_revoked")).unionByName(
        revocations.filter("ts IS NOT NULL").select(F.lit(None).cast(dict(logins.dtypes)["id"]).alias("id"), "user_id", "ts", F.lit(False).alias("_asks"), F.col("ts").alias("_revoked"))
    )
    # Backwards in time; at one time revocations come first, so that they count as "at".
    ordered = both.withColumn("_back", -F.unix_micros("ts"))
    marked = last_before(ordered, ["user_id"], ["_back", "_asks"], {"_revoked": "revoked_at"})
    return marked.filter("_asks").select("id", "user_id", "ts", F.when(F.col("ts").isNotNull(), F.col("revoked_at")).alias("revoked_at"))


def stale_uses(issues: DataFrame, uses: DataFrame) -> DataFrame:
    """``uses`` (id, session, ts, digest) with the digest issued last before and whether another one was presented."""
    kind = dict(uses.dtypes)["id"]
    both = issues.filter("ts IS NOT NULL").select(F.lit(None).cast(kind).alias("id"), "session", "ts", F.lit(True).alias("_issues"), F.col("digest").alias("issued"), F.lit(None).cast("string").alias("digest"))
    both = both.unionByName(uses.select("id", "session", "ts", F.lit(False).alias("_issues"), F.lit(None).cast("string").alias("issued"), "digest"))
    # At one time uses come first: what is issued at that time is not before them.
    marked = last_before(both, ["session"], ["ts", "_issues"], {"issued": "current"}).filter("NOT _issues")
    stale = F.when(F.col("current").isNull(), F.lit(None)).otherwise(~F.col("digest").eqNullSafe(F.col("current")))
    return marked.select("id", "session", "current", stale.alias("stale"))


#: The outcome of an event without a time: it has no place in the order, so it changes nothing.
UNDATED = "undated"


def event_outcome(kind: str | None, stale: bool | None, is_open: bool) -> str:
    """The outcome of one session event, given whether its session is open. Whether a token is stale may be unknown: then it is rejected."""
    if kind == "login":
        return "opened"
    if kind == "refresh":
        return "rotated" if is_open and stale is False else "rejected"
    if kind == "logout":
        return "closed" if is_open else "ignored"
    return "closed_all" if kind == "logout_all" else "unknown"


def session_fold(events: DataFrame) -> DataFrame:
    """Outcome of each event (id, user_id, session, ts, kind, stale) of a user's sessions, in time order.

    A login opens its session; a refresh rotates an open session unless its token is stale (or that is unknown); a logout closes an open
    session; a logout-all closes every session of the user. Other kinds are ``unknown``, events without a time ``undated``; neither changes
    anything. Null users and sessions are one user and one session each. A session is open if its last login is later than its
    last logout and the user's last logout-all, which running maxima give without keeping state; a running maximum of the order is the
    last such event before, which ``last_before`` finds without bringing all of a user's or session's events together.
    """
    timed = events.filter("ts IS NOT NULL")
    order = F.struct("ts", "id")
    of = lambda kind: F.when(F.col("kind") == kind, order)
    marked = timed.withColumns({"_login": of("login"), "_logout": of("logout"), "_all": of("logout_all")})
    marked = last_before(marked, ["user_id", "session"], ["ts", "id"], {"_login": "_opened", "_logout": "_closed"})
    marked = last_before(marked, ["user_id"], ["ts", "id"], {"_all": "_ended"})
    opened, closed, ended = F.col("_opened"), F.col("_closed"), F.col("_ended")
    is_open = _holds(opened.isNotNull() & (closed.isNull() | (opened > closed)) & (ended.isNull() | (opened > ended)))
    outcome = (
        F.when(F.col("kind") == "login", "opened")
        .when(F.col("kind") == "refresh", F.when(is_open & _holds(~F.col("stale")), "rotated").otherwise("rejected"))
        .when(F.col("kind") == "logout", F.when(is_open, "closed").otherwise("ignored"))
        .when(F.col("kind") == "logout_all", "closed_all")
        .otherwise("unknown")
    )
    undated = events.filter("ts IS NULL").select("id", "user_id", "session", "kind", F.lit(UNDATED).alias("outcome"))
    return marked.select("id", "user_id", "session", "kind", outcome.alias("outcome")).unionByName(undated)


MACHINE_OUT = "id {id}, user_id {user_id}, session {session}, kind string, outcome string, closed bigint"


def machine_step(sessions: Any, digests: Any, event: dict, lifetime: int, retained: int) -> tuple[Any, str, int, int | None]:
    """One event of a user's session machine: session, outcome, sessions closed by it, and when the session it opened or rotated expires.

    ``sessions`` maps a session to (current digest, expiry in microseconds) and ``digests`` a current digest to its session; both change.
    A login opens its session. A refresh finds the session whose current digest it presents; that one must not have expired; it gets a new digest and
    a new expiry, and the presented one is dead. A failing refresh changes nothing. A logout closes the session of its digest, expired or
    not; a logout-all closes all. ``retained`` after its expiry a session is forgotten.
    """
    us, kind = event["us"], event["kind"]
    if kind == "login":
        old = sessions.get(event["session"])
        if old is not None:
            digests.pop(old[0])
        sessions[event["session"]] = (event["new_digest"], us + lifetime)
        digests[event["new_digest"]] = event["session"]
        return event["session"], "opened", 0, us + lifetime
    if kind in ("refresh", "logout"):
        known = event["digest"] is not None and event["digest"] in digests
        session = digests.get(event["digest"]) if known else None
        until = sessions.get(session)[1] if known else 0
        if not known or us >= until + retained:
            return event["session"], "rejected" if kind == "refresh" else "ignored", 0, None
        if kind == "logout":
            digests.pop(event["digest"])
            sessions.pop(session)
            return session, "closed", 1, None
        if us >= until:
            return session, "expired", 0, None
        digests.pop(event["digest"])
        sessions[session] = (event["new_digest"], us + lifetime)
        digests[event["new_digest"]] = session
        return session, "rotated", 0, us + lifetime
    if kind == "logout_all":
        closed = sum(us < until + retained for _, (_, until) in sessions.items())
        sessions.clear()
        digests.clear()
        return event["session"], "closed_all", closed, None
    return event["session"], "unknown", 0, None


def session_machine(events: DataFrame, lifetime_s: int = 30 * 86400, retained_s: int = 30 * 86400) -> DataFrame:
    """Session events (id, user_id, session, ts, kind, digest, new_digest) folded per user in (ts, id) order by ``machine_step``: ``id, user_id,
    session, kind, outcome, closed``.

    ``digest`` is what a refresh or logout presents and ``new_digest`` what a login or refresh would issue (unique). Outcomes: opened, rotated, expired,
    rejected, closed, ignored, closed_all, unknown (another kind) and undated (no time; changes nothing). ``session`` is the one that the digest belongs
    to, else the event's own. Users are dealt out and sorted; a task folds their events as they stream by and holds the sessions of one user, without those
    that have been expired for ``retained_s``. A user's events are one sequence by definition, so one user is one task's work. Users, sessions and
    ids are numbers or text; a null user is a user.
    """
    lifetime, retained = lifetime_s * 1_000_000, retained_s * 1_000_000
    rows = events.filter("ts IS NOT NULL").select("id", "user_id", "session", F.unix_micros("ts").alias("us"), "kind", "digest", "new_digest")
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "us", "id")
    names = ["id", "user_id", "session", "kind", "outcome", "closed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, sessions, digests = object(), {}, {}
        for batch in batches:
            out = []
            for event in batch.to_pylist():
                if event["user_id"] != user:
                    user, sessions, digests, seen = event["user_id"], {}, {}, 0
                seen += 1
                if seen % 1024 == 0:
                    for session in [s for s, (_, until) in sessions.items() if event["us"] >= until + retained]:
                        digests.pop(sessions.pop(session)[0])
                session, outcome, closed, _ = machine_step(sessions, digests, event, lifetime, retained)
                out.append((event["id"], user, session, event["kind"], outcome, closed))
            types = [batch.schema.field(n).type for n in names[:4]] + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    undated = events.filter("ts IS NULL").select("id", "user_id", "session", "kind", F.lit(UNDATED).alias("outcome"), F.lit(0).cast("long").alias("closed"))
    return ordered.mapInArrow(run, MACHINE_OUT.format(**dict(events.dtypes))).unionByName(undated)


def fold_hits(times: np.ndarray, limit: int, window: int, start: int | None, hits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None, int]:
    """One client's sorted hit times: window start and rank in the window of each, whether it is allowed, and the state after.

    A window begins at the first hit after the previous one is over; hits beyond the limit do not count.
    """
    starts, ranks = np.empty(len(times), dtype=np.int64), np.empty(len(times), dtype=np.int64)
    at = 0
    while at < len(times):
        if start is None or times[at] - start >= window:
            start, hits = int(times[at]), 0
        upto = max(at + 1, int(np.searchsorted(times, start + window, side="left")))
        starts[at:upto], ranks[at:upto] = start, hits + 1 + np.arange(upto - at)
        hits, at = min(limit, hits + upto - at), upto
    return starts, ranks, ranks <= limit, start, hits


#: Hits of one client that are decided together.
CHUNK_HITS = 1 << 14
#: Chunks up to which the states before them are broadcast (two integers each).
BROADCAST_CHUNKS = 200_000


def window_runs(times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a client's sorted hits make of a window that may begin among them: ``upto, start, hits``.

    If the next window may begin at time t or later, the first entry with ``upto >= t`` has the start of the last window that begins here and how
    many hits it has here. Each hit points to the first hit a window length after it; following pointers to the end, all hits at once by
    doubling, leads to the last window's start. Only hits within a window length of the first one are possible beginnings.
    """
    n = len(times)
    after = np.searchsorted(times, times + window)
    last = np.where(after < n, after, np.arange(n))
    while not np.array_equal(further := last[last], last):
        last = further
    last = last[: int(np.searchsorted(times, times[0] + window)) + 1]
    end = np.flatnonzero(np.r_[last[1:] != last[:-1], True])
    return times[end], times[last[end]], n - last[end]


def rate_limit(requests: DataFrame, limit: int = 300, window_s: int = 60) -> DataFrame:
    """Decision on each request (id, client, ts): ``id, client, allowed, retry_after`` (seconds, 0 if allowed).

    Requests without a client share one allowance; those without a time are undecided (null). One client may hold any share of the rows:

    1. Requests are dealt out by ranges of (client, time) and packed into chunks of one client's hits in time order.
    2. For a client of several chunks, one short table per chunk (``window_runs``) says where its last window begins, depending on where the one
       before it ends. Going along these tables gives the window that is open before each chunk; no hits are read for that.
    3. All chunks are decided side by side from the window open before them.
    """
    window, kinds = window_s * 1_000_000, dict(requests.dtypes)
    rows = requests.filter("ts IS NOT NULL").select("id", "client", F.unix_micros("ts").alias("us"))
    ordered = rows.repartitionByRange("client", "us", "id").sortWithinPartitions("client", "us", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, client, opens = 0, [], None, True

        def chunk(alone: bool) -> pa.RecordBatch:
            ids, us = (pa.concat_arrays([h.column(c) for h in held]) for c in (0, 2))
            times = us.to_numpy()
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
            runs = [one(r) for r in window_runs(times, window)] if not alone else [pa.nulls(1, pa.list_(pa.int64()))] * 3
            head = [pa.array([(TaskContext.get().partitionId() << 32) + number], pa.int64()), held[0].column(1).slice(0, 1), pa.array([alone]), pa.array([times[-1]], pa.int64())]
            return pa.RecordBatch.from_arrays([*head, *runs, one(us), one(ids)], names=["chunk", "client", "alone", "last", "upto", "start", "hits", "us", "ids"])

        for batch in batches:
            code = batch.column(1).dictionary_encode(null_encoding="encode").indices.to_numpy()
            for i, j in itertools.pairwise([0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]):
                if i == j:
                    continue
                same = held and batch.column(1)[i].as_py() == client
                if held and not same:
                    yield chunk(alone=not opens)
                    number, held, opens = number + 1, [], False
                client = batch.column(1)[i].as_py()
                while i < j:
                    room = CHUNK_HITS - sum(h.num_rows for h in held)
                    if not room:
                        yield chunk(alone=False)
                        number, held, opens, room = number + 1, [], True, CHUNK_HITS
                    held.append(batch.slice(i, min(room, j - i)))
                    i += held[-1].num_rows
        if held:
            yield chunk(alone=False)

    lists = "upto array<bigint>, start array<bigint>, hits array<bigint>, us array<bigint>"
    chunks = keep(ordered.mapInArrow(pack, f"chunk bigint, client {kinds['client']}, alone boolean, last bigint, {lists}, ids array<{kinds['id']}>"), "chunks")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, start, hits = object(), None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["client"] != client:
                    client, start, hits = row["client"], None, 0
                out.append((row["chunk"], start, hits))
                opens = start + window if start is not None else row["upto"][0]
                if opens > row["last"]:
                    hits = min(limit, hits + row["n"])
                else:
                    at = bisect.bisect_left(row["upto"], opens)
                    start, hits = row["start"][at], min(limit, row["hits"][at])
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["chunk", "open", "used"])

    parted = chunks.filter("NOT alone").select("chunk", "client", "last", "upto", "start", "hits", F.size("us").cast("bigint").alias("n"))
    before = keep(parted.repartition("client").sortWithinPartitions("client", "chunk").mapInArrow(walk, "chunk bigint, open bigint, used bigint"), "before")
    before = F.broadcast(before) if before.count() <= BROADCAST_CHUNKS else before

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, allowed, left = batch.column("us").value_lengths().to_numpy(), [], []
            for us, start, hits in zip(batch.column("us"), batch.column("open").to_pylist(), batch.column("used").to_pylist(), strict=True):
                times = us.values.to_numpy()
                starts, _, good, _, _ = fold_hits(times, limit, window, start, hits or 0)
                allowed.append(good)
                left.append(np.where(good, 0, np.maximum(1, -((times - starts - window) // 1_000_000))))
            if len(lengths):
                clients = batch.column("client").take(pa.array(np.repeat(np.arange(len(lengths)), lengths)))
                columns = [batch.column("ids").flatten(), clients, pa.array(np.concatenate(allowed)), pa.array(np.concatenate(left), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "client", "allowed", "retry_after"])

    decided = chunks.select("chunk", "client", "us", "ids").join(before, "chunk", "left").select("client", "us", "ids", "open", "used")
    decided = decided.mapInArrow(decide, f"id {kinds['id']}, client {kinds['client']}, allowed boolean, retry_after bigint")
    undated = requests.filter("ts IS NULL").select("id", "client", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("bigint").alias("retry_after"))
    return decided.unionByName(undated)


def rate_limit_totals(requests: DataFrame, limit: int = 300, window_s: int = 60) -> DataFrame:
    decided = rate_limit(requests, limit, window_s)
    return decided.groupBy("client").agg(F.count("*").alias("requests"), F.count_if(~F.col("allowed")).alias("rejected"))
