"""Whitening and top-k search against brute force, and on odd tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from support import SF

from millrace.llm import registry, topk, whitening
from millrace.llm.topk import top_k
from millrace.llm.whitening import OFFSET, block_scatter, exact_deviation, fit_whitening, whiten

VEC = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    return df.withColumns({c: F.lit("clash") for c in ("id", "v", "n", "block", "cell", "home", "row", "rank", "score", "query_id", "deviation", "component")})


def whole(v):
    return [math.floor(1024 * float(np.float32(e))) for e in v]


def takes_part(v, d):
    return v is not None and len(v) == d and all(e is not None and math.isfinite(e) for e in v)


def random_rows(seed, n, d, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(d)]) for i in range(n)]


ODD = [
    *random_rows(1, 70, 3),
    (100, None),
    (200, [1.0, None, 2.0]),
    (300, [math.nan, 0.0, 0.0]),
    (400, [math.inf, 0.0, 0.0]),
    (500, [1.0, 2.0]),
    (600, []),
    (None, [0.5, 0.5, 0.5]),
    (None, [0.5, 0.5, 0.5]),
    (700, [1e30, -1e30, 0.0]),
    (800, [0.25, -0.25, 0.125]),
    (800, [0.25, -0.25, 0.125]),
    (800, [-2.0, 1.0, 3.0]),
]


@given(st.lists(st.lists(st.integers(-(2**52), 2**52), min_size=3, max_size=3), min_size=1, max_size=70))
@settings(max_examples=60, deadline=None)
def test_bit_planes_give_exact_sums_and_cross_products(rows):
    x = np.array(rows, dtype=np.int64)
    sums, cross = block_scatter(x)
    exact = x.astype(object)
    assert list(sums) == list(exact.sum(axis=0)) and (cross == exact.T @ exact).all()
    assert exact_deviation(x) == [sum(e * e for e in row) for row in rows]


def test_bit_planes_of_whole_blocks():
    x = np.random.default_rng(5).integers(0, 1 << 11, (whitening.BLOCK, 5)) + OFFSET
    assert (block_scatter(x)[1] == x.T @ x).all()


def brute_whitening(x):
    x = np.array(x, dtype=object) + OFFSET
    n, sums = len(x), x.sum(axis=0)
    covariance = np.array([[float((n * (x[:, i] * x[:, j]).sum() - sums[i] * sums[j]) / n**2) for j in range(x.shape[1])] for i in range(x.shape[1])])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    centred = n * x - sums
    return [int((r * r).sum()) for r in centred], (centred / n).astype(float) @ axes / np.sqrt(values), values / np.trace(covariance)


def check_whitening(df, expected_rows, k):
    deviation, white, share = brute_whitening([whole(v) for _, v in expected_rows])
    got = sorted(df.collect(), key=lambda r: (r["component"], r["deviation"], abs(r["whitened"])))
    assert {r["component"] for r in got} == set(range(1, k + 1)) and len(got) == k * len(expected_rows)
    assert {r["n"] for r in got} == {len(expected_rows)} and all(r["identity_error"] < 1e-9 for r in got)
    for c in range(k):
        mine = [r for r in got if r["component"] == c + 1]
        want = sorted(zip(deviation, [abs(w) for w in white[:, c]], [i for i, _ in expected_rows], strict=True), key=lambda r: (r[0], r[1]))
        assert [int(r["deviation"]) for r in mine] == [w[0] for w in want]
        assert [abs(r["whitened"]) for r in mine] == pytest.approx([w[1] for w in want], rel=1e-6, abs=1e-9)
        assert all(r["explained"] == pytest.approx(share[c], rel=1e-9) for r in mine)


def test_whitening_equals_brute_force(spark):
    rows = random_rows(3, 300, 12)
    check_whitening(whiten(vectors(spark, rows)), rows, 8)


def test_registered_whitening_equals_brute_force_on_the_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(registry.op11_whitening(spark, SF), rows, 8)


def test_whitening_on_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 700]
    check_whitening(whiten(vectors(spark, rows), components=3), [r for r in rows if takes_part(r[1], 3)], 3)
    assert whiten(vectors(spark, ODD)).filter("vec_id = 700").count() == 3
    assert whiten(vectors(spark, [])).collect() == [] and whiten(vectors(spark, [(1, None), (2, [])])).collect() == []


def test_what_does_not_vary_has_no_component(spark):
    same = whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert len(same) == 8 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in same)
    line = whiten(vectors(spark, [(i, [float(i), 1.0]) for i in range(4)])).orderBy("component", "vec_id").collect()
    assert [r["whitened"] is None for r in line] == [False] * 4 + [True] * 4 and line[0]["identity_error"] < 1e-9


def test_the_driver_gets_a_row_per_pair_of_dimensions_only(spark):
    model = fit_whitening(vectors(spark, random_rows(4, 50, 4)))
    assert model.n == 50 and model.axes.shape == (4, 4) and list(model.variances) == sorted(model.variances, reverse=True)


def brute_top_k(rows, d, k=10, every=100):
    some = [(i, whole(v)) for i, v in rows if takes_part(v, d)]
    out = []
    for a, (i, q) in enumerate(some):
        if i is not None and i % every == 0:
            scored = [(-sum(x * y for x, y in zip(q, v, strict=True)), j is None, j or 0, j) for b, (j, v) in enumerate(some) if b != a]
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(sorted(scored, key=lambda t: t[:3])[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], int(r["score"])) for r in df.collect()), key=repr)


def test_top_k_on_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 700]
    assert found(top_k(vectors(spark, rows))) == brute_top_k(rows, 3)
    assert found(top_k(vectors(spark, rows), k=200, every=1)) == brute_top_k(rows, 3, 200, 1)
    huge = [(i, [2.0**40, float(-i)]) for i in range(30)]  # products beyond whole doubles
    assert found(top_k(vectors(spark, huge), every=10)) == brute_top_k(huge, 2, every=10)
    assert found(top_k(vectors(spark, []))) == [] and found(top_k(vectors(spark, [(0, None)]))) == []
    assert found(top_k(vectors(spark, [(0, [1.0])]))) == []


@pytest.mark.parametrize("seed", range(2))
def test_top_k_over_many_small_blocks(spark, monkeypatch, seed):
    for name, value in {"BLOCK": 16, "LEAST_BLOCK": 4, "QUERIES": 3, "RANGES": 4, "GROUPS": 2, "STEP": 5}.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 6) for i in range(200)]  # one vector holds a third of the rows
    assert found(top_k(vectors(spark, rows), every=20, pivots=6)) == brute_top_k(rows, 6, every=20)


def test_bounds_are_above_every_score_and_most_candidates_are_not_scored(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16)) * 1024
    x = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 30)
    pivots = np.vstack([np.zeros(16), centres])
    near, norm = topk.distances(x, pivots).astype("<f4").astype(float), (x**2).sum(axis=1)
    for i in range(0, 2000, 97):
        bounds, scores = topk.upper_bounds(norm, near, norm[i], near[i]), topk.inner(x, x[i])
        assert (bounds >= scores).all()
        tenth = np.sort(np.delete(scores, i))[-10]
        assert (bounds >= tenth).sum() < 400
