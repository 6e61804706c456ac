"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def brute(rows, positives=5, most=3, low=50, high=95):
    seen = []
    for i, v, g in rows:
        if i is None or v is None or g is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        g = (g + 1) % 10 if i % 7 == 0 else g
        row = (i, g, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in seen:
            seen.append(row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, g, v in seen:
        if i % 50:
            continue
        every = sorted((-dot(v, w), j, h == g) for j, h, w in seen if j != i)
        for s, j, _ in [x for x in every if x[2]][:positives]:
            inside = [(n, t) for t, n, same in every if not same and low * -s <= 100 * -t <= high * -s][:most]
            out += [(i, j, k + 1, n, -s, -t) for k, (n, t) in enumerate(inside)]
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, g, "x") for i, v, g in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = negatives.mined(df, F.col("vec_id") % 50 == 0, label=label, **more)
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, dims, labels=10, spread=1.0):
    r = np.random.default_rng(seed)
    centre = r.normal(0, spread, (labels, dims))
    out = []
    for i in range(n):
        g = int(r.integers(labels))
        out.append((i, [float(np.float32(x)) for x in centre[g] / 4 + r.normal(0, 0.2, dims)], g))
    return out


@pytest.mark.parametrize("seed,n,dims,labels", [(0, 600, 16, 10), (1, 400, 7, 3), (2, 300, 1, 10), (3, 2600, 8, 2)])
def test_lists_equal_brute_force(spark, seed, n, dims, labels):
    rows = vectors(seed, n, dims, labels)
    want = brute(rows)
    assert len(want) > 20
    assert found(spark, rows) == want


def test_blocks_of_anchors_give_the_same(spark):
    rows = vectors(5, 700, 12)
    assert found(spark, rows, block=3) == brute(rows)


def test_other_sizes_and_windows(spark):
    rows = vectors(6, 500, 10)
    assert found(spark, rows, positives=2, negatives=4, low=10, high=60) == brute(rows, 2, 4, 10, 60)


def test_ties_copies_and_repeated_rows(spark):
    rows = vectors(7, 300, 6, spread=0.5)
    rows += [(1000 + k, rows[3][1], rows[3][2]) for k in range(200)]  # a vector that many ids share
    rows += [(1300 + k, rows[50][1], (rows[50][2] + 1) % 10) for k in range(50)]
    rows += rows[:120]  # repeated rows count once
    assert found(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = vectors(8, 160, 5)
    rows += [(None, rows[0][1], 1), (200, None, 1), (250, [1.0, None, 0.0], 2), (300, [float("nan")] * 5, 1), (350, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (400, rows[0][1], None), (450, [], 3), (500, [0.5, 0.25], 4), (550, [0.0] * 5, 3), (600, [x * 1000 for x in rows[1][1]], 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []  # no positive
    assert found(spark, [(0, [1.0], 1), (2, [1.0], 1)]) == []  # no negative


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="63 bits"):
        found(spark, [(0, [1e20, 0.0], 1), (2, [1.0, 0.0], 1)])
    with pytest.raises(Exception, match="63 bits"):
        found(spark, [(0, [8e6] * 5, 1), (2, [1.0, 0.0], 1)])


def test_bounds_hold_and_leave_few_candidates():
    r = random.Random(1)
    m = np.array([[int(r.gauss(0, 32)) for _ in range(15)] for _ in range(4000)], np.int32)
    grid = negatives.Grid(m[:500], m.min(0).astype(np.int64), m.max(0).astype(np.int64))
    anchors = m[:20]
    cells = grid.cells(m)
    up, low = negatives.bounds(grid.tables(anchors, True), cells), negatives.bounds(grid.tables(anchors, False), cells)
    exact = m.astype(np.int64) @ anchors.T.astype(np.int64)
    assert (low <= exact).all() and (exact <= up).all()
    fifth = np.sort(exact, axis=0)[-6]
    assert (up >= fifth).sum() < 0.1 * up.size


def test_long_vectors_are_held_in_fewer_rows(spark):
    assert negatives._at_once(64) == (256, 65_536) and negatives._at_once(4096) == (8, 2048)
    rows = vectors(11, 160, 1200, 4)
    assert found(spark, rows) == brute(rows)
