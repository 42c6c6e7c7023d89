"""Hard negatives (op11) against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.llm import hard_negatives
from fleetscope.llm.common import workers_import

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, path string, place int"


def frame(spark, rows):
    workers_import(spark)
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)


def brute(rows, is_anchor, k=5, low=80, high=100):
    valid = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
             if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, v, y in valid:
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in valid if j != i]
        alike = sorted((x for x in scored if x[2] == y), key=by_rank)[:k]
        for p, j, _ in alike:
            window = sorted((x for x in scored if x[2] != y and low * p <= 100 * x[0] <= high * p), key=by_rank)[:k]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(window, 1)]
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **options).collect()), key=str)


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 0.5
    return [(i, [float(x) for x in centres[i % 6] + rng.normal(size=dims) * 0.2], i % 4) for i in range(n)]


@pytest.mark.parametrize("block,group,chunk", [(1024, 256, 8), (16, 4, 2)])
def test_equal_to_all_scores(spark, block, group, chunk):
    rows = clustered(300, 9, 1) + [(1000 + i, [0.25] * 9, i % 2) for i in range(60)]  # a vector that many rows share
    got = found(frame(spark, rows), block_rows=block, group_rows=group, chunk=chunk, curve_dims=4, curve_bits=3)
    assert got == brute(rows, lambda i: i % 10 == 0) and got


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = clustered(60, 4, 2)
    rows += [(100, None, 1), (110, [1.0, None, 0.0, 0.0], 1), (120, [float("nan"), 0.0, 0.0, 0.0], 2), (130, [float("inf"), 0.0, 0.0, 0.0], 2),
             (140, [0.5, 0.5, 0.5, 0.5], None), (150, [], 1), (160, [0.5, 0.25], 1), (170, [0.5] * 7, 2), (None, [0.5] * 4, 1),
             (None, [0.4] * 4, 2), (180, [-0.5] * 4, 3), (190, [0.0] * 4, 0)]
    rows += [(200 + i, [rng.choice([0.5, 0.25])] * 4, i % 3) for i in range(20)]  # ties
    assert found(frame(spark, rows), block_rows=8, group_rows=4, chunk=2) == brute(rows, lambda i: i % 10 == 0)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(0, [], 1), (10, [], 2)])) == []
    assert found(frame(spark, [(0, None, None)])) == []


def test_scores_beyond_doubles(spark):
    rows = [(i, [1e4 * (i + 1), 3.0, -7e5], i % 2) for i in range(30)]
    assert found(frame(spark, rows), block_rows=8, group_rows=4) == brute(rows, lambda i: i % 10 == 0)
    huge = [(i, [1e30, 1e30], i % 2) for i in range(12)]  # clamped to a long
    assert {r[4:] for r in found(frame(spark, huge))} == {((1 << 63) - 1, (1 << 63) - 1)}


def test_bounds_hold(spark):
    rows = [(i, [float(x) for x in np.eye(6)[i * 6 // 600] * 2 + 0.001 * (i % 7)], i % 2) for i in range(600)]
    least, most = hard_negatives._bounds(np.array([[2.0, -1.0]]), np.array([[0.0, 1.0]]), np.array([[3.0, 4.0]]))
    assert (round(least[0, 0], 6), round(most[0, 0], 6)) == (-4, 5)
    assert found(frame(spark, rows), block_rows=50, group_rows=10) == brute(rows, lambda i: i % 10 == 0)


def test_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = hard_negatives.hilbert(cells, 3)
    path = cells[np.argsort(place)]
    assert sorted(place) == list(range(512)) and set(np.abs(np.diff(path, axis=0)).sum(axis=1)) == {1}
