"""Nearest neighbours at real width: ties, few vectors and near ties against brute force."""

import numpy as np
import pytest

from abstain_eval.llm import cross_polytope

SCHEMA = "vec_id long, embedding array<double>"


def found(spark, rows, **options):
    out = {}
    frame = spark.createDataFrame([(i, np.asarray(x, float).tolist()) for i, x in rows], SCHEMA)
    for r in cross_polytope.nearest_neighbours(frame, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_multiples_of_a_vector_are_ties(spark):
    x = np.random.default_rng(0).normal(size=64)
    rows = [(i, x * i) for i in range(1, 20)] + [(50, x * 0.1), (60, -x)]
    assert [i for i, _ in found(spark, rows)[50]] == [1, 2, 3, 4, 5]
    assert all(abs(s - 1) < 1e-12 and s <= 1 for _, s in found(spark, rows)[50])
    exact = [(i, x * 2.0**i) for i in range(1, 20)] + [(50, x)]
    assert found(spark, exact)[50] == [(i, found(spark, exact)[50][0][1]) for i in range(1, 6)]


def test_few_vectors_are_all_found(spark):
    draw = np.random.default_rng(1)
    for n in (2, 4, 6, 13):
        rows = [(i * 25, draw.normal(size=64)) for i in range(n)]
        units = {i: x / np.linalg.norm(x) for i, x in rows}
        got = found(spark, rows)
        for i in (i for i, _ in rows if i % 50 == 0):
            want = sorted(((-units[i] @ u, j) for j, u in units.items() if j != i))[:5]
            assert len(got[i]) == len(want)
            if n <= 6:  # all there are
                assert [j for j, _ in got[i]] == [j for _, j in want]
    opposite = [(0, np.eye(64)[0]), (1, -np.eye(64)[0]), (2, np.eye(64)[1]), (3, np.zeros(64))]
    assert found(spark, opposite)[0] == [(2, 0.0), (1, -1.0)]


@pytest.mark.parametrize("width", [3, 64])
def test_ties_between_directions_go_to_lesser_ids(spark, width):
    """Many directions at one cosine, more than a block keeps at first."""
    rows = [(50, np.eye(width)[0])]
    for i in range(1, 40):
        x = np.eye(width)[0] * 3
        x[1 + i % (width - 1)] = 4 if i % 2 else -4
        rows.append((i, x * (1 + i % 3)))
    assert found(spark, rows)[50] == [(i, 0.6) for i in range(1, 6)]
