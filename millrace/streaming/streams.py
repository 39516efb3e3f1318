"""Streams: redaction, the rate limiter, the session fold and the session machine.

Stateful streams hold a key's rows until the watermark has passed them and then fold them in (ts, id) order, so rows may
arrive in any order within the delay and the result equals the batch operator's. Later rows are dropped. Rows are held in runs under a short index, with one
timer a key: a trigger touches the index, its new rows and the runs that have become due, not what else a key holds.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Callable, Generator, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.text import or_default, redact
from millrace.operators.sessions import MACHINE_OUT, UNDATED, event_outcome, machine_step
from millrace.sources.tables import shared_path

#: The state store that stateful streams need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: The event time of the row that ends an input (pandas times reach no further).
END = "2262-01-01 00:00:00"

#: Rows of one key that are held together at most, and of the first run of what is left of one.
RUN_ROWS, SHORT_ROWS = 1024, 16
#: New rows of one key that are sorted together, and entries of its state that a fold holds in memory.
SORT_ROWS = 1 << 16
#: Entries up to which a state is read whole.
WHOLE_ENTRIES = 256


def drain(operator: Callable[[DataFrame], DataFrame], feed: DataFrame, name: str, ts: str | None = None) -> DataFrame:
    """Run ``operator(feed)`` over all input there is, into files in the shared folder, and read them back.

    With ``ts``, the feed's event time, the input also ends: after the feed has been read a second source, empty until then, gets one
    row of nulls at a time far ahead. The watermark then passes all rows that are held, and the operator returns
    them; the row itself is never passed.
    """
    spark, path = feed.sparkSession, shared_path(feed.sparkSession, name)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    if ts:
        spark.createDataFrame([], feed.schema).write.parquet(f"{path}/end")
        feed = feed.unionByName(spark.readStream.schema(feed.schema).parquet(f"{path}/end"))
    stream = operator(feed)

    def run():
        writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    if ts:
        end = spark.range(1).select(*[F.lit(END if f.name == ts else None).cast(f.dataType).alias(f.name) for f in feed.schema])
        end.coalesce(1).write.mode("append").parquet(f"{path}/end")
        run()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def redacted(feed: DataFrame) -> DataFrame:
    """Log records (id, request_id, text) with redacted text and ``-`` for a missing request id."""
    return feed.select("id", or_default(F.col("request_id"), "-").alias("request_id"), redact(F.col("text")).alias("text"))


class Held(StatefulProcessor):
    """Holds a key's rows until the watermark has passed their time slot, then gives them to ``fold`` in (ts, id) order.

    Rows are held as JSON lists (numbers, text and booleans), so keys and values of any such type work, nulls too. They lie in runs: what a trigger
    brings, sorted and cut. A short index says where each run begins, so a trigger reads and writes the index and the runs that have become due; what is not due of
    such a run goes back in runs that begin short and double, so a row is written again a logarithm of times at most. One timer stands for all that a
    key waits for. Calls of the state server come per key and run, not per row.

    ``fold`` yields rows of the output and returns when it wants to be called again (milliseconds; None: when rows are due). ``counts`` are numbers of its
    own that are kept with the index; once they are 0 and nothing is held, nothing is left of the key.
    """

    def __init__(self, columns: list[str], slot_ms: int = 1000) -> None:
        self.columns, self.slot_ms = columns, slot_ms
        self.us, self.id = columns.index("us"), columns.index("id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "run bigint", "rows string")
        self.index = handle.getValueState("index", "first array<bigint>, run array<bigint>, next bigint, wake bigint, counts array<bigint>")

    def _open(self) -> None:
        """``runs`` (first time, number), the next run's number, the time of the timer, and the counts."""
        first, run, self.next, self.wake, self.counts = self.index.get() or ((), (), 0, None, ())
        self.runs, self.counts = list(zip(first, run, strict=True)), list(self.counts)

    def _close(self, wake: int | None, known: int | None) -> None:
        """The index written back, and a timer for the first thing waited for, unless that is ``known``."""
        self.wake = min([self._end(first) for first, _ in self.runs] + [wake for wake in [wake] if wake is not None], default=None)
        if self.wake is not None and self.wake != known:
            self.handle.registerTimer(self.wake)
        if self.wake is None and not any(self.counts):
            self.index.clear()
        else:
            self.index.update(([f for f, _ in self.runs], [r for _, r in self.runs], self.next, self.wake, self.counts))

    def _end(self, us: int) -> int:
        """The end of a time's slot (milliseconds)."""
        return (us // 1000 // self.slot_ms + 1) * self.slot_ms

    def _order(self, row: list) -> tuple:
        return row[self.us], row[self.id] is not None, row[self.id]

    def _hold(self, rows: list[list], size: int = RUN_ROWS) -> None:
        """Sorted rows as runs of ``size``, doubling up to ``RUN_ROWS``."""
        at = 0
        while at < len(rows):
            self.slots.updateValue((self.next,), (json.dumps(rows[at : at + size]),))
            self.runs.append((rows[at][self.us], self.next))
            self.next, at, size = self.next + 1, at + size, min(2 * size, RUN_ROWS)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        self._open()
        before = self.wake
        for part in itertools.batched(rows, SORT_ROWS):
            places = [part[0].__fields__.index(c) for c in self.columns]
            self._hold(sorted(([row[i] for i in places] for row in part), key=self._order))
        self._close(before, before)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        self._open()
        if self.wake is not None and self.wake <= now:  # else another timer of this key has done it
            left: list[list[list]] = []
            wake = yield from self.fold(key[0], self._due(now // self.slot_ms * self.slot_ms * 1000, left), now)
            for rows in left:
                self._hold(rows, SHORT_ROWS)
            self._close(wake, None)
        self.due(at)

    def _due(self, limit: int, left: list[list[list]]) -> Iterator[dict]:
        """The rows before ``limit`` from all runs in order; their runs are taken out, and what is not due of them is put into ``left``. A run is read when
        its first row comes, so only runs that overlap in time are in memory together."""
        waiting = sorted(r for r in self.runs if r[0] < limit)
        self.runs = [r for r in self.runs if r[0] >= limit]
        reading: list[tuple] = []
        for first, run in [*waiting, (limit, None)]:
            while reading and reading[0][0][0] < first:
                _, number, rows, at = reading[0]
                yield dict(zip(self.columns, rows[at], strict=True))
                at += 1
                if at < len(rows) and rows[at][self.us] < limit:
                    heapq.heapreplace(reading, (self._order(rows[at]), number, rows, at))
                else:
                    heapq.heappop(reading)
                    if at < len(rows):
                        left.append(rows[at:])
            if run is not None:
                rows = json.loads(self.slots.getValue((run,))[0])
                self.slots.removeKey((run,))
                heapq.heappush(reading, (self._order(rows[0]), run, rows, 0))

    def fold(self, key: Any, rows: Iterator[dict], now: int) -> Generator[Row, None, int | None]:
        raise NotImplementedError

    def due(self, at: int) -> None:
        """What else ends at this time, of which a subclass has set a timer itself."""

    def close(self) -> None:
        pass


class _Entries:
    """A map state of JSON values as a mapping that is changed in memory between ``open`` and ``flush``.

    A state of few entries is read whole at first use, another one entry by entry. ``flush`` writes what differs and returns how many entries there are.
    """

    def __init__(self, state: Any) -> None:
        self.state = state

    def open(self, count: int) -> None:
        self.known: dict[str, str | None] = {}
        self.held: dict[str, str] = {}
        self.count, self.whole, self.wiped = count, count == 0, False

    def _load(self) -> None:
        if not self.whole:
            for name, value in self.state.iterator():
                self.held[name[0]] = value[0]
                self.known.setdefault(name[0], value[0])
            self.whole = True

    def _find(self, key: Any) -> str:
        name = json.dumps(key)
        if name not in self.known and not self.whole:
            if self.count <= WHOLE_ENTRIES:
                self._load()
            elif found := self.state.getValue((name,)):
                self.held[name] = self.known[name] = found[0]
            else:
                self.known[name] = None
        return name

    def __contains__(self, key: Any) -> bool:
        return self.known.get(self._find(key)) is not None

    def get(self, key: Any) -> Any:
        text = self.known.get(self._find(key))
        return None if text is None else json.loads(text)

    def __setitem__(self, key: Any, value: Any) -> None:
        self.known[self._find(key)] = json.dumps(value)

    def pop(self, key: Any) -> None:
        name = self._find(key)
        if name in self.held:
            self.known[name] = None
        else:
            self.known.pop(name, None)

    def items(self) -> list[tuple[Any, Any]]:
        self._load()
        return [(json.loads(k), json.loads(v)) for k, v in self.known.items() if v is not None]

    def changed(self) -> list[tuple[Any, Any]]:
        """The entries that are new or have another value than before."""
        return [(json.loads(k), json.loads(v)) for k, v in self.known.items() if v is not None and v != self.held.get(k)]

    def clear(self) -> None:
        self.known, self.held, self.whole, self.wiped = {}, {}, True, self.wiped or self.count > 0

    def flush(self) -> int:
        if self.wiped:
            self.state.clear()
            self.count = 0
        for name, text in self.known.items():
            if text is None and name in self.held:
                self.state.removeKey((name,))
            elif text is not None and text != self.held.get(name):
                self.state.updateValue((name,), (text,))
            self.count += (text is not None) - (name in self.held)
        return self.count


def _stateful(feed: DataFrame, key: str, delay: str, processor: Held, schema: str, undated: DataFrame) -> DataFrame:
    """The processor's output, and ``undated`` for rows without a time, which no watermark passes."""
    timed = feed.filter("ts IS NOT NULL").withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    done = timed.groupBy(key).transformWithState(processor, schema, "append", "EventTime")
    return done.unionByName(undated)


class Limiter(Held):
    """The rate limiter: state is the open window's start and its hits so far; it is forgotten when the window is over."""

    def __init__(self, limit: int, window: int) -> None:
        super().__init__(["id", "us"])
        self.limit, self.length = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "start bigint, hits bigint")

    def fold(self, key: Any, rows: Iterator[dict], now: int) -> Generator[Row, None, int | None]:
        start, hits = before = self.window.get() or (None, 0)
        for row in rows:
            us = row["us"]
            if start is None or us - start >= self.length:
                start, hits = us, 0
            allowed = hits < self.limit
            hits += allowed
            yield Row(id=row["id"], client=key, allowed=allowed, retry_after=0 if allowed else max(1, -((us - start - self.length) // 1_000_000)))
        if start is None:
            return None
        over = self._end(start + self.length)  # all rows of the window have been folded then
        if over > now and (start, hits) != before:
            self.window.update((start, hits))
        elif over <= now and before[0] is not None:
            self.window.clear()
        return over if over > now else None


def rate_limited(feed: DataFrame, limit: int = 300, window_s: int = 60, delay: str = "1 minute") -> DataFrame:
    """Decisions on requests (id, client, ts) as in the batch operator; a client is forgotten when its window is over. Clients and ids may be
    numbers or text, and null."""
    kinds = dict(feed.dtypes)
    schema = f"id {kinds['id']}, client {kinds['client']}, allowed boolean, retry_after bigint"
    undated = feed.filter("ts IS NULL").select("id", "client", F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("long").alias("retry_after"))
    return _stateful(feed.select("id", "client", "ts"), "client", delay, Limiter(limit, window_s * 1_000_000), schema, undated)


class OpenSessions(Held):
    """Which of a user's sessions are open; each is one entry of the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = _Entries(handle.getMapState("open", "session string", "open string"))

    def fold(self, key: Any, rows: Iterator[dict], now: int) -> Generator[Row, None, int | None]:
        self.open.open(self.counts[0] if self.counts else 0)
        for row in rows:
            session = row["session"]
            outcome = event_outcome(row["kind"], row["stale"], session in self.open)
            if outcome == "opened":
                self.open[session] = True
            elif outcome == "closed":
                self.open.pop(session)
            elif outcome == "closed_all":
                self.open.clear()
            yield Row(id=row["id"], user_id=key, session=session, kind=row["kind"], outcome=outcome)
            if len(self.open.known) > SORT_ROWS:
                self.open.open(self.open.flush())
        self.counts = [self.open.flush()]
        return None


def sessions_folded(feed: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Outcomes of session events (id, user_id, session, ts, kind, stale) as in the batch operator. State has an entry per open session."""
    kinds = dict(feed.dtypes)
    schema = f"id {kinds['id']}, user_id {kinds['user_id']}, session {kinds['session']}, kind string, outcome string"
    undated = feed.filter("ts IS NULL").select("id", "user_id", "session", "kind", F.lit(UNDATED).alias("outcome"))
    columns = ["id", "us", "session", "kind", "stale"]
    return _stateful(feed.select("id", "user_id", "session", "ts", "kind", "stale"), "user_id", delay, OpenSessions(columns), schema, undated)


class Machine(Held):
    """A user's sessions with digest and expiry, found by session and by digest; a timer forgets each some time after it has expired."""

    def __init__(self, columns: list[str], lifetime: int, retained: int) -> None:
        super().__init__(columns)
        self.lifetime, self.retained = lifetime, retained
        #: Sessions that are over within a sixteenth of the time that they are retained are forgotten together.
        self.step = max(1, retained // 16_000 // self.slot_ms) * self.slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.sessions = _Entries(handle.getMapState("sessions", "session string", "value string"))
        self.digests = _Entries(handle.getMapState("digests", "digest string", "value string"))
        self.ends = handle.getMapState("ends", "at bigint", "sessions array<string>")

    def fold(self, key: Any, rows: Iterator[dict], now: int) -> Generator[Row, None, int | None]:
        self._enter()
        for row in rows:
            session, outcome, closed, _ = machine_step(self.sessions, self.digests, row, self.lifetime, self.retained)
            yield Row(id=row["id"], user_id=key, session=session, kind=row["kind"], outcome=outcome, closed=closed)
            if len(self.sessions.known) + len(self.digests.known) > SORT_ROWS:
                self._leave(row["us"] // 1000)  # what comes may still ask for what is over by the watermark
                self._enter()
        self._leave(now)
        return None

    def _enter(self) -> None:
        sessions, digests = self.counts or (0, 0)
        self.sessions.open(sessions)
        self.digests.open(digests)

    def _leave(self, now: int) -> None:
        """Changes written back, without what is forgotten by ``now`` (milliseconds), and timers for what will be."""
        ends: dict[int, list[str]] = {}
        for session, (digest, until) in self.sessions.changed():
            if (at := self._gone(until)) > now:
                ends.setdefault(at, []).append(json.dumps(session))
            else:
                self._forget(session, digest)
        for at, names in ends.items():
            old = self.ends.getValue((at,))
            self.ends.updateValue((at,), ([*(old[0] if old else ()), *names],))
            if not old:
                self.handle.registerTimer(at)
        self.counts = [self.sessions.flush(), self.digests.flush()]

    def _gone(self, until: int) -> int:
        return ((until + self.retained) // 1000 // self.step + 1) * self.step

    def _forget(self, session: Any, digest: str) -> None:
        self.sessions.pop(session)
        self.digests.pop(digest)

    def due(self, at: int) -> None:
        names = None if at % self.step else self.ends.getValue((at,))
        if not names:
            return
        self.ends.removeKey((at,))
        self._enter()
        for session in map(json.loads, names[0]):
            digest, until = self.sessions.get(session) or (None, 0)
            if digest is not None and self._gone(until) <= at:  # else it has been closed or rotated meanwhile
                self._forget(session, digest)
        self.counts = [self.sessions.flush(), self.digests.flush()]
        self._close(self.wake, self.wake)


def session_machine_stream(feed: DataFrame, lifetime_s: int = 30 * 86400, retained_s: int = 30 * 86400, delay: str = "1 minute") -> DataFrame:
    """Outcomes of session events (id, user_id, session, ts, kind, digest, new_digest) as in ``session_machine``. State has an entry per session and
    one per current digest; both go some time after the session has expired."""
    kinds = dict(feed.dtypes)
    schema = MACHINE_OUT.format(**kinds)
    undated = feed.filter("ts IS NULL").select("id", "user_id", "session", "kind", F.lit(UNDATED).alias("outcome"), F.lit(0).cast("long").alias("closed"))
    columns = ["id", "us", "session", "kind", "digest", "new_digest"]
    processor = Machine(columns, lifetime_s * 1_000_000, retained_s * 1_000_000)
    return _stateful(feed.select("id", "user_id", "session", "ts", "kind", "digest", "new_digest"), "user_id", delay, processor, schema, undated)
