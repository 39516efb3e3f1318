"""Embedding whitening from an exact integer scatter that is counted on bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut
from millrace.llm.vectors import dimension, usable

#: What is added to every integer entry.
OFFSET = 100_000
#: Rows whose bit planes are counted together.
BLOCK = 4096
#: A component with less than this part of the largest variance counts as having none.
NO_VARIANCE = 1e-12
_WIDE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with ``sums`` per dimension; unit ``axes`` (columns) by falling ``variances``; ``trace`` of the covariance."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    trace: float


def _row_sums(counts: np.ndarray) -> np.ndarray:
    """Sums of the rows of a matrix of bytes of at most 64, eight bytes at a time in lanes of 16 bits."""
    lanes = np.uint64(0x00FF00FF00FF00FF)
    eight = counts.view(np.uint64)
    sums = ((eight & lanes) + (eight >> np.uint64(8) & lanes)).sum(axis=1, dtype=np.uint64)
    return (sums * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.int64)


def block_scatter(x: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sums and cross-products (exact Python integers) of the rows of an int64 matrix.

    Entries are shifted by their dimension's least value in the block and taken apart into bit planes; a plane's bits of 64 rows
    are one word. The number of rows in which two bits are both set is the popcount of the AND of their planes; weighted by both
    bits' values these counts add up to the cross-products of the shifted entries, from which the shift is taken out again.
    """
    n, d = x.shape
    least = x.min(axis=0)
    shifted = (x - least).T
    width = max(int(shifted.max()).bit_length(), 1)
    padded = np.zeros((d, width, (n + 511) // 512 * 512), dtype=bool)
    for b in range(width):
        padded[:, b, :n] = shifted >> b & 1
    padded = padded.reshape(d * width, -1)
    used = np.flatnonzero(padded.any(axis=1))
    planes = np.packbits(padded[used], axis=1, bitorder="little").view(np.uint64)
    weight = np.array([1 << int(b) for b in used % width], dtype=object)
    both = np.zeros((len(used), len(used)), dtype=np.int64)
    for p in range(len(used)):
        both[p, p:] = _row_sums(np.bitwise_count(planes[p] & planes[p:]))
    both = both + np.triu(both, 1).T
    if 2 * width + n.bit_length() < 53:  # every sum below is then a whole double
        weight = weight.astype(np.float64)
    member = np.zeros((d, len(used)), dtype=weight.dtype)
    member[used // width, np.arange(len(used))] = weight
    own = [int(s) for s in member @ both.diagonal()]
    cross = member @ both.astype(weight.dtype) @ member.T
    cross = (cross if weight.dtype == object else cross.astype(np.int64)).astype(object)
    low = np.array([int(m) for m in least], dtype=object)
    sums = np.array(own, dtype=object)
    cross = cross + np.outer(low, sums) + np.outer(sums, low) + n * np.outer(low, low)
    return list(sums + n * low), cross


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = 8) -> Whitening:
    """Principal components of all vectors that take part, each entry as ``floor(1024 * entry) + 100000``.

    Every task adds up the exact scatter of its blocks and returns one row per pair of dimensions; Spark sums these, so the driver
    gets d * (d + 3) / 2 + 1 integers, however many vectors there are. The covariance is centred in integers
    (n * cross - sum * sum, over n * n) before it becomes a matrix of doubles. Which vectors take part is told in
    ``millrace.llm.vectors``. If none does, n is 0 and there are no components.
    """
    d = dimension(df, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for batch in batches:
            _, whole = usable(batch.column(0), d)
            for first in range(0, len(whole), BLOCK):
                x = whole[first : first + BLOCK].astype(np.int64) + OFFSET
                own, products = block_scatter(x)
                n, sums, cross = n + len(x), sums + own, cross + products
        if n:
            i, j = np.triu_indices(d)
            values = [Decimal(n), *map(Decimal, sums), *map(Decimal, cross[i, j])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[-1, np.full(d, -1), i], pa.int32()), pa.array(np.r_[-1, np.arange(d), j], pa.int32()), pa.array(values, _WIDE)],
                names=["i", "j", "v"],
            )

    if not d:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    parts = df.select(F.col(vector_col)).mapInArrow(run, "i int, j int, v decimal(38,0)")
    found = {(r["i"], r["j"]): int(r["v"]) for r in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    n = found.get((-1, -1), 0)
    if not n:
        return Whitening(0, (), np.zeros((d, 0)), np.zeros(0), 0.0)
    sums = tuple(found[-1, j] for j in range(d))
    covariance = np.zeros((d, d))
    for i, j in combinations_with_replacement(range(d), 2):
        covariance[i, j] = covariance[j, i] = (n * found[i, j] - sums[i] * sums[j]) / (n * n)
    trace = sum(n * found[i, i] - sums[i] * sums[i] for i in range(d)) / (n * n)
    variances, axes = np.linalg.eigh(covariance)
    first = np.argsort(variances)[::-1][: min(components, d)]
    return Whitening(n, sums, axes[:, first], variances[first], trace)


def exact_deviation(v: np.ndarray) -> list[int]:
    """Sum of squares of each row of an int64 or object matrix, exactly."""
    if v.dtype == object or (len(v) and max(int(v.max()), -int(v.min())) >= 1 << 53):
        return [sum(e * e for e in map(int, row)) for row in v]
    high, low = v >> 26, v & ((1 << 26) - 1)
    parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]


def transform(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, deviation decimal(38,0), whitened array<double>`` for every row whose vector takes part.

    ``deviation`` is the exact sum of squares of n * x - sum (null beyond 38 digits); ``whitened`` has one entry per component of
    the model, null for a component without variance.
    """
    d, kind = len(model.sums), df.schema[id_col].dataType.simpleString()
    sums, k = np.array(model.sums, dtype=object), len(model.variances)
    has = model.variances > NO_VARIANCE * max(model.variances.max(initial=0.0), 0.0)
    scaled = np.where(has, model.axes / np.sqrt(np.where(has, model.variances, 1.0)), 0.0)
    most = max(map(abs, model.sums), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = usable(batch.column(1), d)
            for first in range(0, len(at), BLOCK):
                x = whole[first : first + BLOCK].astype(np.int64) + OFFSET
                if model.n * max(int(x.max()), -int(x.min())) + most < 1 << 62:
                    centred = x * model.n - sums.astype(np.int64)
                else:
                    centred = x.astype(object) * model.n - sums
                white = (centred.astype(np.float64) / model.n) @ scaled
                values = pa.array(white.ravel(), mask=np.tile(~has, len(x)))
                deviation = [Decimal(v) if v < 10**38 else None for v in exact_deviation(centred)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), values)
                ids = batch.column(0).take(pa.array(at[first : first + BLOCK]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(deviation, _WIDE), lists], names=["id", "deviation", "whitened"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    return rows.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>").withColumnRenamed("id", id_col)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest entry of whitened's covariance, measured over all ``rows``, less the identity; None without a component."""
    k = [c for c in range(len(model.variances)) if model.variances[c] > NO_VARIANCE * model.variances[0]]
    if not k or model.variances[0] <= 0:
        return None
    pairs = list(combinations_with_replacement(k, 2))
    found = rows.agg(*[F.covar_pop(F.get("whitened", F.lit(a)), F.get("whitened", F.lit(b))).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """Vectors whitened by the principal components of all of them: ``id_col, component, n, deviation, whitened, explained,
    identity_error``, one row per vector that takes part and component (numbered from 1 by falling variance).

    The components are fitted on all vectors (``fit_whitening``); the whitened vectors are written to the shared folder, and the
    identity error is measured on what was written. Null vectors, those with null or non-finite entries, and those of another
    length than most take no part; entries beyond 2^52 / 1024 saturate. Null and repeated ids are kept as they are:
    every row is a vector. A component without variance (one vector, equal vectors, fewer vectors than components) has a null
    ``whitened``; ``explained`` is null if nothing varies. An empty table gives no rows; other columns are ignored.
    """
    model = fit_whitening(df, vector_col, components)
    rows = cut(transform(df, model, id_col, vector_col), "whitened")
    error = identity_error(rows, model)
    explained = [float(v / model.trace) if model.trace > 0 else None for v in model.variances]
    shares = F.array(*[F.lit(e).cast("double") for e in explained]) if explained else F.array().cast("array<double>")
    spread = rows.select(F.col(id_col), "deviation", F.posexplode("whitened").alias("c", "whitened"))
    return spread.select(
        id_col,
        (F.col("c") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("c")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
