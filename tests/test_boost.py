"""Boosted trees against exhaustive search, and boosted rounds of imputation."""

import numpy as np
import pytest

from abstain_eval.operators import boost, impute


def stump(rows, columns, target):
    """The best single split by trying all: (gain, column, threshold)."""
    best = (0.0, None, None)
    for c in columns:
        values = np.unique(rows[:, c])
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            left, right = target[rows[:, c] <= cut], target[rows[:, c] > cut]
            gain = ((target - target.mean()) ** 2).sum() - ((left - left.mean()) ** 2).sum() - ((right - right.mean()) ** 2).sum()
            if gain > best[0] + 1e-9:
                best = (gain, c, cut)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_first_splits_are_the_best_ones(seed):
    draw = np.random.default_rng(seed)
    rows = draw.integers(0, 12, (80, 4)).astype(float)
    target = rows[:, 1] ** 2 - 3 * rows[:, 2] + draw.normal(size=80)
    forest = boost.grown(rows, [0, 1, 2], target, 1, 2, 1.0)
    _, column, cut = stump(rows, [0, 1, 2], target)
    assert (forest.features[0, 0], forest.thresholds[0, 0]) == (column, cut)
    for side, place in ((rows[:, column] <= cut, 1), (rows[:, column] > cut, 2)):
        _, column_below, cut_below = stump(rows[side], [0, 1, 2], target[side])
        assert forest.features[0, place] == column_below
        # Bins are those of all rows, so a bound may lie elsewhere in the same gap.
        here = rows[side][:, column_below]
        assert ((here <= cut_below) == (here <= forest.thresholds[0, place])).all()
    fitted = forest.predict(rows)
    leaves = [target[fitted == v].mean() for v in np.unique(fitted)]
    assert np.allclose(leaves, np.unique(fitted))


def test_boosting_explains_more_with_every_tree():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(2000, 3))  # more values than bins
    target = np.sin(3 * rows[:, 0]) + rows[:, 1]
    errors = [np.abs(boost.grown(rows, [0, 1, 2], target, n, 3, 0.1).predict(rows) - target).mean() for n in (1, 10, 100)]
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.2


def test_nothing_to_learn_from():
    rows = np.ones((5, 2))
    assert boost.grown(rows, [1], np.arange(5.0), 3, 3, 0.1).predict(rows).tolist() == [2.0] * 5
    assert boost.grown(rows[:0], [1], np.zeros(0), 3, 3, 0.1).predict(rows).tolist() == [0.0] * 5
    assert boost.grown(rows, [], np.arange(5.0), 3, 3, 0.1).predict(rows[:0]).tolist() == []


def gapped(spark, n=600):
    draw = np.random.default_rng(4)
    a, b = draw.integers(0, 20, n).astype(float), draw.integers(0, 5, n).astype(float)
    rows = [(i, x if i % 7 else None, 3 * x + y if i % 5 != 1 else float("nan"), y, "t") for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, extra string"), a, b


def test_rounds_find_what_is_missing(spark):
    df, a, b = gapped(spark)
    fitted, done = impute.fit_imputation(df, ["a", "b", "c"], rounds=3)
    rows = {r["id"]: r for r in done.collect()}
    assert len(rows) == 600 and done.columns == df.columns
    error = np.mean([abs(rows[i]["b"] - (3 * a[i] + b[i])) for i in range(600) if i % 5 == 1])
    assert error < 4 and np.std(3 * a + b) > 15  # where a is missing too, only c is known
    assert all(rows[i]["a"] == a[i] for i in range(600) if i % 7)
    assert fitted.rounds == len(fitted.forests) <= 3 and set(fitted.forests[0]) == {"a", "b", "c"}


def test_chain_is_saved_and_used_on_new_rows(spark, tmp_path):
    df, _, _ = gapped(spark)
    settings = impute.Boosting(trees=5, fit_rows=200)
    fitted, _ = impute.fit_imputation(df, ["a", "b", "c"], settings, rounds=2)
    fitted.save(spark, str(tmp_path))
    loaded = impute.FittedImputation.load(spark, str(tmp_path))
    new = spark.createDataFrame([(1, 4.0, None, None), (2, None, None, None), (3, 1.0, 2.0, 3.0)], "id int, a double, b double, c double")
    filled = [tuple(r) for r in loaded.transform(new).orderBy("id").collect()]
    assert filled == [tuple(r) for r in fitted.transform(new).orderBy("id").collect()]
    assert filled[2] == (3, 1.0, 2.0, 3.0) and all(v is not None for r in filled for v in r)
    assert loaded.transform(new.limit(0)).collect() == []


def test_sample_is_bounded_and_hangs_on_rows_alone(spark):
    df, _, _ = gapped(spark)
    settings = impute.Boosting(fit_rows=50)
    some = impute._fitting_rows(df, ["a", "b", "c"], 600, settings)
    again = impute._fitting_rows(df.repartition(5), ["a", "b", "c"], 600, settings)
    assert some.shape == (50, 3) and np.array_equal(some, again, equal_nan=True)
    equal = spark.range(1000).selectExpr("1.0D as a", "cast(null as double) as b", "2.0D as c")
    assert impute._fitting_rows(equal, ["a", "b", "c"], 1000, settings).shape == (50, 3)


def test_unknown_estimator(spark):
    with pytest.raises(ValueError, match="unknown estimator"):
        impute.fit_imputation(gapped(spark)[0], ["a"], "forest")


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_values_by_codes_equal_those_by_levels(depth):
    rng = np.random.default_rng(depth)
    rows = np.round(rng.normal(size=(3000, 6)), 1)
    forest = boost.grown(rows[:500], [1, 2, 3, 4, 5], rows[:500, 0] + rows[:500, 1] * rows[:500, 2], 20, depth, 0.1)
    forest.features[3, -1], forest.thresholds[3, -1] = boost.NO_SPLIT, np.inf
    rows[::7, 2] = np.nan
    assert (forest._predict_by_code(rows) == forest._predict_by_level(rows)).all()
    assert (forest.predict(rows) == forest._predict_by_level(rows)).all() and len(forest.predict(rows[:0])) == 0


def same_forests(one, two):
    assert one.rounds == two.rounds and one.means == two.means
    for a, b in zip(one.forests, two.forests, strict=True):
        for c in a:
            assert a[c].base == b[c].base and all(np.array_equal(getattr(a[c], x), getattr(b[c], x)) for x in ("features", "thresholds", "leaves"))


def test_trees_are_fitted_on_all_rows(spark):
    n = 12_000
    rows = [(i, float(i % 5), None if i % 11 == 3 else float((i * i) % 97) + 40 * (i % 5 > 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    fitted, _ = impute.fit_imputation(df, ["a", "b"], impute.Boosting(trees=1, depth=1, step=1.0), rounds=1)
    a, b = (np.array([np.nan if r[i] is None else r[i] for r in rows]) for i in (1, 2))
    known, forest = ~np.isnan(b), fitted.forests[0]["b"]
    assert (forest.features[0, 0], forest.thresholds[0, 0]) == (0, 1.5)
    want = [b[known & side].mean() - b[known].mean() for side in (a < 1.5, a > 1.5)]
    assert np.allclose(forest.leaves[0], want, atol=1e-5) and np.isclose(forest.base, b[known].mean(), atol=1e-5)


def test_blocks_of_rows_grow_the_same_trees(spark, monkeypatch):
    df, _, _ = gapped(spark, 1500)
    df = df.selectExpr("*", "cast(id % 3 as double) as flag", "1.0D as same", "if(id % 50 = 0, null, id * 0.001D) as many")
    columns, settings = ["a", "b", "c", "flag", "same", "many"], impute.Boosting(trees=7, step=0.3)
    whole, filled = impute.fit_imputation(df, columns, settings, rounds=3)
    monkeypatch.setattr(impute, "AT_ONCE", 100)
    monkeypatch.setattr(impute, "BLOCK_ROWS", 150)
    blocks, filled_in_blocks = impute.fit_imputation(df.repartition(3), columns, settings, rounds=3)
    same_forests(whole, blocks)
    assert sorted(filled.collect()) == sorted(filled_in_blocks.collect())
    small = impute.Boosting(trees=2, fit_rows=300)
    sampled, _ = impute.fit_imputation(df, columns, small, rounds=1)
    monkeypatch.setattr(impute, "AT_ONCE", 1000)
    same_forests(sampled, impute.fit_imputation(df, columns, small, rounds=1)[0])


def test_a_column_is_summed_up_by_rank():
    draw = np.random.default_rng(2)
    cells = np.concatenate([draw.normal(size=40_000), np.zeros(20_000)])
    parts = [boost.Summary.of(p).short(1000) for p in np.array_split(draw.permutation(cells), 7)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merged(p).short(1000)
    assert whole.weights.sum() == len(cells) and len(whole.values) <= 1000 and 0.0 in whole.values
    exact = boost.Summary.of(cells)
    assert np.array_equal(exact.bin_values(), np.unique(np.quantile(cells, np.arange(1, 513) / 512, method="lower")))
    rank = np.searchsorted(np.sort(cells), whole.bin_values(), side="right") / len(cells)
    rank_of_exact = np.searchsorted(np.sort(cells), exact.bin_values(), side="right") / len(cells)
    assert abs(len(rank) - len(rank_of_exact)) <= 2
    assert max(np.abs(rank_of_exact - r).min() for r in rank) < 0.005


def test_residuals_beyond_32_bits_are_kept():
    for residual in (np.array([[5.0, 0.0, -7.0]]), np.array([[2.0**40, 0.0, -(2.0**31)]])):
        assert (impute._packed(residual) == residual).all()
