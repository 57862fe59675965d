"""Hard negatives against SQL, brute force and awkward rows; curve and zone maps by themselves."""

import math

import numpy as np
import pytest
from compare import connect, difference

from abstain_eval.llm import hard_negatives, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, block long, score double"


def brute(rows, step=50):
    """All rows against all anchors, in whole numbers."""
    found = {}
    for i, x, label in rows:
        if i is None or label is None or not x or any(v is None or not math.isfinite(v) for v in x):
            continue
        found[(i, label, tuple(math.floor(256 * v) for v in x))] = None
    rows, out = list(found), []
    for a, label, q in rows:
        if a % step:
            continue
        scored = [(-sum(u * v for u, v in zip(q, r, strict=True)), i, other) for i, other, r in rows if i != a and len(r) == len(q)]
        scored.sort()
        for s, p, _ in [t for t in scored if t[2] == label][:5]:
            fits = [(-t, i) for t, i, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k + 1, i, -s, t) for k, (t, i) in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, 0.5) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df).collect())


def test_query_agrees_with_sql(spark):
    sql = queries.ORACLES["op12_hard_negatives"]
    assert difference(spark, connect(SMALL), queries.op12_hard_negatives, sql, SMALL) == ""


def test_small_blocks_against_brute_force(spark, monkeypatch):
    """Clusters that zone maps can tell apart, ties, and blocks, groups and pages of a few rows."""
    for name, size in (("BLOCK", 16), ("GROUP", 3), ("PAGE", 5), ("HELD_GROUPS", 1)):
        monkeypatch.setattr(hard_negatives, name, size)
    draw = np.random.default_rng(5)
    centres = draw.normal(0, 3, (4, 6))
    rows = [(i, (centres[i % 4] + draw.normal(0, 0.4, 6)).round(1).tolist(), int(draw.integers(3))) for i in range(400)]
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(60)]  # one very common vector
    assert mined(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0, 2.0], 1), (1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [1.0, nan], 1), (5, [1.0, inf], 2), (6, [1.0, 2.0], None)]
    fine = [(0, [1.0, 1.0], 1), (50, [1.0, 1.0], 2), (50, [1.0, 1.0], 2), (7, [1.0, 1.0], 1), (8, [0.7, 0.7], 2), (9, [0.7, 0.7], 2)]
    other = [(100, [1.0, 0.0, 0.0], 1), (101, [1.0, 0.0, 0.0], 1), (102, [0.8, 0.0, 0.0], 3), (150, [-1.0], 1), (151, [1.0], 1), (200, [0.0, 0.0], 9)]
    assert mined(spark, odd + fine + other) == brute(odd + fine + other)
    assert mined(spark, odd) == mined(spark, []) == mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_large_components(spark):
    """Scores beyond 2 ** 53 stay exact; vectors whose scores could leave 64 bits take no part."""
    rows = [(0, [4e6, 1.0], 1), (1, [4e6, 2.0], 1), (2, [3e6, 3.0], 2), (3, [3e6, 4.0], 2), (4, [3e6, 3.5], 2)]
    assert mined(spark, rows) == brute(rows) and len(mined(spark, rows)) == 3
    assert mined(spark, rows + [(5, [1e9, 0.0], 1), (6, [1e300, 0.0], 2)]) == brute(rows)


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_curve_visits_every_place_by_single_steps(dims):
    side = np.arange(8)
    points = np.array(np.meshgrid(*[side] * dims)).reshape(dims, -1).T
    keys = hard_negatives.hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(8**dims))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    draw = np.random.default_rng(2)
    rows, anchors = draw.integers(-900, 900, (50, 7)), draw.integers(-900, 900, (9, 7))
    least, most = hard_negatives.bounds(anchors, rows.min(0)[None], rows.max(0)[None])
    scores = anchors @ rows.T
    assert (scores >= least).all() and (scores <= most).all()
