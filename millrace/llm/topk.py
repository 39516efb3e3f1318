"""Exact top-k search by inner product, with candidates eliminated by a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut
from millrace.llm.vectors import dimension, usable

#: Pivots, and the vectors (by a hash) among which they are looked for. Neither changes the result, only the work.
PIVOTS = 32
PIVOT_SAMPLE = 2048
#: Vectors of one block, and queries that travel together.
BLOCK = 4096
LEAST_BLOCK = 512
QUERIES = 64
#: Candidates of a query that are scored at a time, in the order of their bounds.
STEP = 128
#: Blocks whose ranges one row of the plan's table holds, and groups of queries that one task takes to a block.
RANGES = 1024
GROUPS = 2048
#: Relative error that single-precision distances may have.
_SLACK = 4e-7
_NO_ID = np.iinfo(np.int64).max


def find_pivots(rows: DataFrame, d: int, pivots: int = PIVOTS) -> np.ndarray:
    """The origin, then vectors of a hash sample of at most ``PIVOT_SAMPLE`` rows, each farthest from those before it."""
    sample = rows.orderBy(F.xxhash64("v", "id")).limit(PIVOT_SAMPLE).select("v").toArrow()
    _, found = usable(sample.column(0).combine_chunks(), d)
    chosen, away = [np.zeros(d)], (found**2).sum(axis=1)
    while len(chosen) < pivots and away.max(initial=0) > 0:
        chosen.append(found[int(away.argmax())])
        away = np.minimum(away, ((found - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole doubles: as doubles while every sum is below 2^53, else as Python integers."""
    if np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * len(q) < 1 << 53:
        return (x @ q).astype(np.int64)
    return np.array([sum(map(int.__mul__, map(int, row), map(int, q))) for row in x], dtype=object)


def upper_bounds(norm: np.ndarray, table: np.ndarray, q_norm: float, q_table: np.ndarray) -> np.ndarray:
    """What no inner product with the query can exceed: by the triangle inequality the distance is at least the largest difference
    of both distances to a pivot, and the inner product is half of (both squared norms less the squared distance).

    ``norm`` are squared norms; the first pivot is the origin, so this is never above the product of both norms.
    """
    apart = np.zeros(len(table))
    for p in range(table.shape[1]):
        np.maximum(apart, np.abs(table[:, p] - q_table[p]), out=apart)
    return _bound(norm, apart - _SLACK * (np.sqrt(norm) * 3 + q_table.max()), q_norm)


def _bound(norm: np.ndarray, apart: np.ndarray, q_norm: float) -> np.ndarray:
    both = norm + q_norm
    return (both - np.maximum(apart, 0) ** 2) / 2 + 1e-12 * both + 1e-6


class Best:
    """The k best (score, id) so far: highest scores, ties to the smaller id, null ids (``_NO_ID``) last."""

    def __init__(self, k: int, floor: float = -np.inf) -> None:
        self.k, self.floor, self.rows = k, floor, []

    def add(self, scores: list[int], ids: list[int]) -> None:
        self.rows = sorted([*self.rows, *zip(scores, ids, strict=True)], key=lambda r: (-r[0], r[1]))[: self.k]
        if len(self.rows) == self.k:
            self.floor = max(self.floor, self.rows[-1][0])


def search_block(x: np.ndarray, ids: np.ndarray, norm: np.ndarray, table: np.ndarray, q: np.ndarray, q_norm: float, q_table: np.ndarray, best: Best, own: int = -1) -> None:
    """Add the block's rows that may be among the best to ``best``, in the order of their bounds, until the next bound is below the
    k-th best score: no row left can then be among the best. ``own`` is the query's own row in this block."""
    bounds = upper_bounds(norm, table, q_norm, q_table)
    if own >= 0:
        bounds[own] = -np.inf
    left = np.flatnonzero(bounds >= best.floor)
    left = left[bounds[left] > -np.inf]
    left = left[np.argsort(-bounds[left], kind="stable")]
    for first in range(0, len(left), STEP):
        some = left[first : first + STEP]
        if bounds[some[0]] < best.floor:
            return
        scores = inner(x[some], q)
        good = np.flatnonzero(scores >= best.floor) if best.floor > -np.inf else np.arange(len(some))
        best.add(scores[good].tolist(), ids[some[good]].tolist())


def _kind(x: np.ndarray) -> str:
    """The smallest type that holds these whole doubles."""
    most = np.abs(x).max(initial=0)
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"


def _pack(x: np.ndarray) -> tuple[bytes, str]:
    kind = _kind(x)
    return x.astype(kind).tobytes(), kind


def _unpack(data: bytes, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(data, dtype=kind).reshape(-1, width).astype(np.float64)


def make_blocks(rows: DataFrame, d: int, pivots: np.ndarray) -> DataFrame:
    """Vectors near one pivot in blocks: ``block, ids, known, data, kind, near`` (distances to all pivots), ``low``, ``high`` (their
    ranges) and ``norm`` (the largest squared norm).

    Vectors are dealt out by ranges of (nearest pivot, distance to it, id), so a frequent vector is spread over tasks too.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1), d)
            if not len(at):
                continue
            near, kind = distances(x, pivots), _kind(x)
            cell = near[:, 1:].argmin(axis=1) + 1 if near.shape[1] > 1 else np.zeros(len(x), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                    pa.array([kind] * len(x)),
                    pa.array(cell, pa.int32()),
                    pa.array(near[np.arange(len(x)), cell], pa.float64()),
                ],
                names=["id", "v", "kind", "cell", "away"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, known, data, cell = 0, [], [], [], None

        def block():
            x = np.concatenate([np.frombuffer(v, kind) for v, kind in data]).astype(np.float64).reshape(-1, d)
            near = distances(x, pivots).astype("<f4")
            packed, kind = _pack(x)
            values = [
                (TaskContext.get().partitionId() << 32) + number, np.array(ids, "<i8").tobytes(), np.array(known).tobytes(), packed, kind,
                near.tobytes(), near.min(axis=0).astype(float).tolist(), near.max(axis=0).astype(float).tolist(), float((x**2).sum(axis=1).max()),
            ]
            return pa.RecordBatch.from_pydict({n: pa.array([v], t) for (n, t), v in zip(_BLOCK_TYPES.items(), values, strict=True)})

        for batch in batches:
            for i, v, kind, c in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(ids) == BLOCK or c != cell and len(ids) >= LEAST_BLOCK:
                    yield block()
                    number, ids, known, data = number + 1, [], [], []
                ids.append(_NO_ID if i is None else i)
                known.append(i is not None)
                data.append((v, kind))
                cell = c
        if ids:
            yield block()

    placed = rows.mapInArrow(place, "id bigint, v binary, kind string, cell int, away double")
    ordered = placed.repartitionByRange("cell", "away", "id").sortWithinPartitions("cell", "away", "id").select("id", "v", "kind", "cell")
    return ordered.mapInArrow(gather, _BLOCK_SCHEMA)


_BLOCK_TYPES = {
    "block": pa.int64(), "ids": pa.binary(), "known": pa.binary(), "data": pa.binary(), "kind": pa.string(), "near": pa.binary(),
    "low": pa.list_(pa.float64()), "high": pa.list_(pa.float64()), "norm": pa.float64(),
}
_BLOCK_SCHEMA = "block bigint, ids binary, known binary, data binary, kind string, near binary, low array<double>, high array<double>, norm double"
_FOUND_SCHEMA = "home bigint, row int, query_id bigint, id bigint, score decimal(38,0)"
_GROUP_SCHEMA = "home bigint, part int, rows binary, query_ids binary, data binary, kind string, near binary, floors binary"


class Block:
    """A block's arrays."""

    def __init__(self, row: dict, d: int) -> None:
        self.ids, self.known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], bool)
        self.x = _unpack(row["data"], row["kind"], d)
        self.near = np.frombuffer(row["near"], "<f4").reshape(len(self.ids), -1).astype(np.float64)
        self.norm = (self.x**2).sum(axis=1)


def _not_above(score: float) -> float:
    """The score as a double, rounded down."""
    rounded = float(score)
    return rounded if rounded == -np.inf or int(rounded) <= score else float(np.nextafter(rounded, -np.inf))


def _found(home: int, row: int, query: int, best: Best) -> list[tuple]:
    return [(home, row, query, None if i == _NO_ID else i, s) for s, i in best.rows]


def _found_batch(found: list[tuple]) -> dict[str, pa.Array]:
    columns = list(zip(*found, strict=True)) if found else [[]] * 5
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
    return {n: pa.array(c, t) for n, c, t in zip(("home", "row", "query_id", "id", "score"), columns, types, strict=True)}


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, pivots: int = PIVOTS) -> DataFrame:
    """For each row whose id is divisible by ``every`` the ``k`` other rows of highest inner product: ``query_id, rank, id_col, score``.

    Entries are ``floor(1024 * entry)``. Scores are exact; ties go to the smaller id (null last, then ranks are dealt in any order among equals).
    A query is a row, not an id: of two rows with one id each is a query and the other one's candidate, and their ranks are numbered
    apart. A query with fewer than ``k`` candidates gets all. Null vectors, those with null or non-finite entries and those of another
    length than most take no part; entries beyond 2^52 / 1024 saturate. Null ids are candidates only. Other columns are ignored; an
    empty table gives no rows.

    1. Vectors near one pivot make a block, which keeps its distances to all pivots and their ranges.
    2. Each query is answered in its own block, which gives a floor for its k-th score.
    3. A query goes to those other blocks only whose ranges allow a score above its floor; there, candidates are scored in the order
       of their own bounds until the next bound is below the k-th score.
    4. The best of all blocks are ranked per query.

    Queries (in groups) meet the blocks' ranges (in rows of ``RANGES`` blocks) and then the blocks in plain shuffles; a block meets at most
    ``GROUPS`` groups in a task. Work grows with what the bounds leave: at worst queries times rows, as in any exact search.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    d = dimension(df, vector_col)
    found_at = find_pivots(rows.filter("v IS NOT NULL"), d, pivots) if d else np.zeros((1, 0))
    blocks = cut(make_blocks(rows, d, found_at), "blocks")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, d)
                asked = np.flatnonzero(block.known & (block.ids % every == 0))
                for part, first in enumerate(range(0, len(asked), QUERIES)):
                    some, floors, found = asked[first : first + QUERIES], [], []
                    for i in some.tolist():
                        best = Best(k)
                        search_block(block.x, block.ids, block.norm, block.near, block.x[i], block.norm[i], block.near[i], best, i)
                        floors.append(_not_above(best.floor))
                        found.append(_found(row["block"], i, int(block.ids[i]), best))
                    data, kind = _pack(block.x[some])
                    group = [row["block"], part, some.astype("<i4").tobytes(), block.ids[some].tobytes(), data, kind, block.near[some].astype("<f4").tobytes(), np.array(floors, dtype=np.float64).tobytes()]
                    head = {n: pa.array([v], t) for (n, t), v in zip(_GROUP_TYPES.items(), group, strict=True)}
                    inside = pa.StructArray.from_arrays(list((f := _found_batch([r for x in found for r in x])).values()), names=list(f))
                    yield pa.RecordBatch.from_pydict(head | {"found": pa.ListArray.from_arrays(pa.array([0, len(inside)], pa.int32()), inside)})

    groups = cut(blocks.drop("low", "high").mapInArrow(at_home, f"{_GROUP_SCHEMA}, found array<struct<{_FOUND_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"), "queries")
    first = groups.select(F.explode("found").alias("f")).select("f.*")

    chunks = max(1, -(-blocks.count() // RANGES))
    ranges = blocks.groupBy(F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk")).agg(
        F.collect_list(F.struct("block", "low", "high", "norm")).alias("ranges")
    )
    ranges = cut(ranges, "ranges")
    salts = 1 + groups.count() // GROUPS

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                near = np.frombuffer(row["near"], "<f4").reshape(-1, len(found_at)).astype(np.float64)
                floors = np.frombuffer(row["floors"])
                x = _unpack(row["data"], row["kind"], d)
                q_norm = (x**2).sum(axis=1)
                low, high, norm = (np.array([r[n] for r in row["ranges"]]) for n in ("low", "high", "norm"))
                go = np.zeros((len(x), len(norm)), dtype=bool)
                for q in range(len(x)):
                    apart = np.maximum(np.maximum(low - near[q], near[q] - high), 0).max(axis=1)
                    apart -= _SLACK * (np.sqrt(norm) * 3 + near[q].max())
                    go[q] = _bound(norm, apart, q_norm[q]) >= floors[q]
                for b in np.flatnonzero(go.any(axis=0)).tolist():
                    if row["ranges"][b]["block"] == row["home"]:
                        continue
                    some = np.flatnonzero(go[:, b])
                    data, kind = _pack(x[some])
                    group = [
                        row["home"], row["part"], np.frombuffer(row["rows"], "<i4")[some].tobytes(), np.frombuffer(row["query_ids"], "<i8")[some].tobytes(),
                        data, kind, near[some].astype("<f4").tobytes(), floors[some].tobytes(),
                    ]
                    head = {n: pa.array([v], t) for (n, t), v in zip(_GROUP_TYPES.items(), group, strict=True)}
                    yield pa.RecordBatch.from_pydict({"block": pa.array([row["ranges"][b]["block"]], pa.int64())} | head)

    asking = groups.drop("found").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    planned = asking.join(ranges, "chunk").mapInArrow(plan, f"block bigint, {_GROUP_SCHEMA}")
    planned = planned.withColumn("salt", F.pmod(F.xxhash64("home", "part"), F.lit(salts)).cast("int"))

    # A block comes first in its task, then the groups of queries that it may answer.
    held = blocks.select("block", "ids", "known", "data", "kind", "near").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = held.unionByName(planned, allowMissingColumns=True)
    met = both.repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("home").asc_nulls_first(), "part")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["home"] is None:
                    block, number = row, row["block"]
                    continue
                if isinstance(block, dict):
                    block = Block(block, d)
                x = _unpack(row["data"], row["kind"], d)
                near = np.frombuffer(row["near"], "<f4").reshape(len(x), -1).astype(np.float64)
                floors, ids, at = np.frombuffer(row["floors"]), np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["rows"], "<i4")
                found = []
                for q in range(len(x)):
                    best = Best(k, floors[q])
                    search_block(block.x, block.ids, block.norm, block.near, x[q], (x[q] ** 2).sum(), near[q], best)
                    found += _found(row["home"], int(at[q]), int(ids[q]), best)
                assert row["block"] == number
                yield pa.RecordBatch.from_pydict(_found_batch(found))

    found = first.unionByName(met.mapInArrow(answer, _FOUND_SCHEMA))
    order = Window.partitionBy("home", "row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), F.col("score").cast("decimal(38,0)").alias("score"))


_GROUP_TYPES = {
    "home": pa.int64(), "part": pa.int32(), "rows": pa.binary(), "query_ids": pa.binary(), "data": pa.binary(), "kind": pa.string(),
    "near": pa.binary(), "floors": pa.binary(),
}
