"""Case tables: contract, imputation, splits, generation and the preparation job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.checks.common import clinical, raw_cases
from abstain_eval.operators import clinical as c
from abstain_eval.operators import encode, impute, order, synthesize, validate
from abstain_eval.plans import prepare as plan
from abstain_eval.sources import cases as source


def test_settings_are_checked():
    with pytest.raises(ValueError):
        k.PrepConfig(test_size=1.0)
    with pytest.raises(ValueError):
        k.PrepConfig(n_synthetic=-1)
    with pytest.raises(ValueError):
        k.PrepConfig(task="other")


def test_missing_file_is_named(spark):
    with pytest.raises(FileNotFoundError):
        source.read_cases(spark, "/tmp/no-such-case-table.csv")


def test_csv_missing_tokens_and_repeated_header(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("id,age,age\n1,NA,5\n2,,nan\n")
    read = source.read_cases(spark, str(path))
    assert [tuple(r) for r in read.collect()] == [("1", None, "5"), ("2", None, None)]
    names = source.header_names(spark, str(path))
    found = {(r["check"], r["column"]) for r in validate.header_violations(spark, names).collect()}
    assert ("duplicate_column", "age") in found and ("missing_column", "sc") in found


def test_contract_failures_raise(spark, small):
    raw = raw_cases(spark, small)
    validate.assert_valid(validate.violations(raw))
    with pytest.raises(ValueError, match="missing_column sc"):
        validate.assert_valid(validate.violations(raw.drop("sc")))
    odd = raw.withColumn("htn", F.when(F.col("id") == "5", "sometimes").otherwise(F.col("htn")))
    with pytest.raises(ValueError, match="unsupported_value htn sometimes"):
        validate.assert_valid(validate.violations(odd))


def test_declared_sex_column_is_accepted(spark, small):
    raw = raw_cases(spark, small).withColumn("gender", F.lit("female"))
    validate.assert_valid(validate.violations(raw, sex_column="gender"))
    assert validate.clean_cases(raw, "gender").filter("gender = 'female'").count() == raw.count()


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = encode.scale(df, encode.fit_ranges(df, ["a", "b"]), ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.0, 0.0)]


def test_unfitted_ranges_raise(spark):
    with pytest.raises(RuntimeError):
        encode.load_ranges(spark, "/tmp/no-such-ranges")


def test_low_creatinine_is_floored(spark):
    df = spark.createDataFrame([(-0.2, 48.0, "female"), (0.4, 48.0, "female")], "sc double, age double, sex string")
    low, floor = [r.egfr for r in c.with_egfr(df).collect()]
    assert low == floor > 0


def test_tie_between_thresholds_goes_down(spark):
    row = spark.range(1).select(c.nearest_threshold(F.lit(45.0)).alias("n")).first().n
    assert (row.threshold, row.margin) == (30.0, 15.0)


def brute_imputation(x, rounds):
    """Plain least squares chain in numpy."""
    x, missing = x.copy(), np.isnan(x)
    x[missing] = np.broadcast_to(np.nanmean(x, axis=0), x.shape)[missing]
    for _ in range(rounds):
        for j in np.argsort(missing.sum(axis=0), kind="stable"):
            if not missing[:, j].any():
                continue
            others = np.column_stack([np.ones(len(x)), np.delete(x, j, axis=1)])
            seen = ~missing[:, j]
            weights, *_ = np.linalg.lstsq(others[seen], x[seen, j], rcond=None)
            x[~seen, j] = others[~seen] @ weights
    return x


def test_linear_chain_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 3))
    x = np.column_stack([base, base @ [1.0, 2.0, -1.0] + rng.normal(size=60) * 0.1])
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    fitted, done = impute.fit_imputation(
        df, ["a", "b", "c", "d"], lambda: impute.linear(0.0), rounds=2, tolerance=0.0
    )
    got = np.array([tuple(r)[1:] for r in done.orderBy("id").collect()])
    assert np.allclose(got, brute_imputation(x, 2), atol=1e-6)
    again = np.array([tuple(r)[1:] for r in fitted.transform(df).orderBy("id").collect()])
    assert np.allclose(got, again, atol=1e-9)


def test_empty_column_cannot_be_imputed(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    with pytest.raises(ValueError, match="b"):
        impute.fit_imputation(df, ["a", "b"])


def test_boosted_trees_leave_no_gap(spark):
    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i % 7) * 2) for i in range(80)]
    _, done = impute.fit_imputation(
        spark.createDataFrame(rows, "id int, a double, b double"), ["a", "b"], lambda: impute.gbt(trees=5), rounds=1
    )
    worst = max(abs(r.b - 2 * r.a) for r in done.collect())
    assert worst < 3


def test_split_sizes_and_stability(spark, small):
    cases = clinical(spark, small)
    split = order.stratified_split(cases, "class", ["case_id"], 0.2, 7)
    counts = {(r["class"], r.is_test): r["count"] for r in split.groupBy("class", "is_test").count().collect()}
    assert counts == {(0, True): 150, (0, False): 600, (1, True): 150, (1, False): 600}
    again = order.stratified_split(cases.repartition(3), "class", ["case_id"], 0.2, 7)
    assert split.select("case_id", "is_test").exceptAll(again.select("case_id", "is_test")).isEmpty()


def test_split_with_one_dominant_stratum(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 970, "big").otherwise("small").alias("s"))
    split = order.stratified_split(df, "s", ["id"], 0.1, 1)
    counts = {r["s"]: r["count"] for r in split.filter("is_test").groupBy("s").count().collect()}
    assert counts == {"big": 97, "small": 3}


def test_shuffle_is_a_permutation(spark):
    got = order.seeded_shuffle(spark.range(5000), ["id"], 5).collect()
    assert sorted(r.row_idx for r in got) == list(range(5000))
    assert [r.id for r in sorted(got, key=lambda r: r.row_idx)] != sorted(r.id for r in got)


def test_one_row_stage_uses_its_mean(spark, small):
    cases = c.derive_features(clinical(spark, small).limit(1))
    stats = synthesize.fit_stage_stats(cases)
    made = synthesize.generate(stats, 3).collect()
    source_row = cases.first()
    assert len(made) == 3 and all(r.bu == round(source_row.bu, 4) for r in made)


def test_synthetic_values_stay_in_bounds(spark, small):
    made = synthesize.generate(synthesize.fit_stage_stats(c.derive_features(clinical(spark, small))), 500)
    assert made.count() == 500
    for name, (low, high) in k.CONTINUOUS_BOUNDS.items():
        assert made.filter((F.col(name) < low) | (F.col(name) > high) | F.col(name).isNull()).isEmpty()


def test_400_rows_give_84_and_90_records(spark, small):
    raw = raw_cases(spark, small).filter("cast(id as int) < 400")
    detection = plan.prepare(
        raw, k.PrepConfig(seed=11, n_synthetic=4, estimator="linear", rounds=1)
    )
    records = detection.records.collect()
    assert len(records) == 84 and set(records[0].features) == set(k.REDUCED_FEATURES)
    assert detection.imputed.filter(" or ".join(f"{x} is null" for x in k.FULL_FEATURES)).isEmpty()
    assert sorted(r.row_idx for r in records) == list(range(84))
    cases = detection.imputed.withColumn("case_id", F.col("id").cast("bigint"))
    split = order.stratified_split(c.derive_features(cases), "ckd_stage", ["case_id"], 0.2, 42)
    train, test = split.filter("not is_test"), split.filter("is_test")
    made = synthesize.generate(synthesize.fit_stage_stats(train), 10)
    progression = c.build_records(synthesize.merge_cases(test, made), "progression")
    assert progression.count() == 90
    row = progression.first()
    assert set(row.baseline) == set(row.current) == set(k.REDUCED_FEATURES)


def test_null_strata_and_single_rows(spark):
    rows = [(i, None if i % 4 == 0 else "b") for i in range(40)]
    split = order.stratified_split(spark.createDataFrame(rows, "id long, s string"), "s", ["id"], 0.2, 1)
    got = {r["s"]: (r["n"], r["t"]) for r in split.groupBy("s").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert got == {None: (10, 2), "b": (30, 6)}
    with pytest.raises(ValueError, match="too few rows"):
        order.refuse_small_strata(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, s string"), "s")


def test_findings_are_counted(spark, small):
    raw = raw_cases(spark, small).withColumn("sc", F.concat(F.lit("bad"), F.col("id")))
    with pytest.raises(ValueError, match=r"1500 findings.* and 1480 more"):
        validate.assert_valid(validate.number_violations(raw))
