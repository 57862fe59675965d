"""Hand tables with known metric values."""

import math

import pytest

from abstain_eval import contracts as k
from abstain_eval.operators import metrics as m

SCHEMA = (
    "run_id string, prediction string, ground_truth string, abstained boolean, confidence double, "
    "ckd_stage int, should_abstain boolean"
)


def table(spark, *rows):
    full = [("r", *row, *[None] * (6 - len(row))) for row in rows]
    return spark.createDataFrame(full, SCHEMA)


def one(scores):
    rows = scores.collect()
    assert len(rows) == 1
    return rows[0]


def test_abstention_counts_as_wrong(spark):
    row = one(m.accuracy(table(spark, ("0", "0", False), ("0", "1", False), (None, "0", True))))
    assert row.value == pytest.approx(1 / 3)
    assert row.n_abstained == 1 and '"n_correct":1' in row.details


def test_neutral_abstention_is_left_out(spark):
    row = one(m.accuracy(table(spark, ("0", "0", False), (None, "0", True)), True))
    assert row.value == 1.0 and row.n_evaluated == 1


def test_balanced_accuracy_with_abstention(spark):
    row = one(m.balanced_accuracy(table(spark, ("0", "0", False), ("0", "0", False), ("0", "1", True))))
    assert row.value == 0.5


def test_balanced_accuracy_of_text_labels(spark):
    rows = [("stable", "stable", False), ("worsening", "worsening", False), ("stable", "improving", False)]
    assert one(m.balanced_accuracy(table(spark, *rows))).value == pytest.approx(2 / 3)
    unseen = [("improving", "stable", False), ("worsening", "worsening", False)]
    assert one(m.balanced_accuracy(table(spark, *unseen))).value == 0.5


def test_balanced_accuracy_needs_two_classes(spark):
    row = one(m.balanced_accuracy(table(spark, ("0", "0", False), ("0", "0", False))))
    assert row.value is None and row.reason == k.NEEDS_TWO_CLASSES


def test_plus_sign_matches_but_has_another_key(spark):
    rows = table(spark, ("+1", "1", False), ("0", "0", False))
    assert one(m.accuracy(rows)).value == 1.0
    assert one(m.balanced_accuracy(rows)).value == 0.5


def test_answer_rate_by_stage(spark):
    rows = table(
        spark, ("0", "0", False, None, 3), (None, "1", True, None, 3), ("1", "1", False, None, 2),
        ("1", "1", False, None, None), ("1", "1", False, None, -4),
    )
    row = one(m.answer_rate(rows))
    assert row.value == pytest.approx(4 / 5)
    assert row.breakdown == {"stage_2": 1.0, "stage_3": 0.5, "unknown_stage": 1.0}


def test_selective_accuracy(spark):
    row = one(m.selective_accuracy(table(spark, ("0", "0", False), (None, "1", True))))
    assert row.value == 1.0 and row.n_evaluated == 1
    none = one(m.selective_accuracy(table(spark, (None, "1", True))))
    assert none.value is None and none.reason == k.NO_ANSWERED


def test_calibration_bins(spark):
    rows = table(
        spark, ("1", "1", False, 0.9), ("0", "0", False, 0.8), ("1", "1", False, 0.85), ("0", "0", False, 0.75)
    )
    bins = {r.bin: r for r in m.reliability_bins(rows, 5).collect()}
    assert len(bins) == 5 and bins[0]["count"] == 0 and bins[0].gap is None
    assert bins[4]["count"] == 3 and bins[4].gap == pytest.approx(0.15)
    assert bins[3]["count"] == 1 and bins[3].gap == pytest.approx(0.25)
    assert one(m.expected_calibration_error(rows, 5)).value == pytest.approx(0.175)


def test_calibration_without_confidence(spark):
    row = one(m.expected_calibration_error(table(spark, ("1", "1", False, None))))
    assert row.value is None and row.reason == k.NO_CONFIDENCE and row.n_evaluated == 0
    with pytest.raises(ValueError):
        m.reliability_bins(table(spark, ("1", "1", False, 0.5)), 1)


def test_nan_confidence_counts_as_one(spark):
    bins = m.reliability_bins(table(spark, ("1", "1", False, math.nan)), 5).filter("count > 0").collect()
    assert [(b.bin, b.mean_confidence) for b in bins] == [(4, 1.0)]


def test_brier(spark):
    rows = table(spark, ("1", "1", False, 1.0), ("0", "1", False, 0.8))
    assert one(m.brier_score(rows)).value == pytest.approx(0.32)
    row = one(m.brier_score(table(spark, ("2", "2", False, 0.7))))
    assert row.value is None and row.reason == k.NOT_BINARY and row.n_evaluated == 1


def test_deferral_alignment(spark):
    rows = table(spark, ("0", "0", False, None, None, True), ("0", "0", False, None, None, False))
    row = one(m.deferral_alignment(rows))
    assert row.value == 0.5 and row.n_evaluated == 2
    none = one(m.deferral_alignment(table(spark, ("0", "0", False))))
    assert none.value is None and none.reason == k.NO_FLAG


def test_bundle_equals_single_metrics(spark):
    rows = table(
        spark, ("1", "1", False, 0.9, 1, True), ("0", "1", False, 0.4, 2, False), (None, "0", True, None, 2, True),
        ("1", "0", False, 0.6, None, None), (" 1 ", "1", False, None, 1, False),
    )
    bundle = {r.metric: r for r in m.score_runs(rows).collect()}
    assert set(bundle) == set(m.METRICS)
    for name, metric in m.METRICS.items():
        single, whole = one(metric(rows)), bundle[name]
        assert single.reason == whole.reason and single.n_evaluated == whole.n_evaluated, name
        assert single.value == pytest.approx(whole.value), name
        assert single.breakdown == pytest.approx(whole.breakdown), name


def test_result_does_not_depend_on_partitions(spark):
    rows = [(str(i % 2), str(i % 3 % 2), i % 5 == 0, (i % 10) / 8, i % 4, i % 3 == 0) for i in range(200)]
    base = table(spark, *rows)
    pick = lambda n: sorted(
        (r.metric, None if r.value is None else round(r.value, 12)) for r in m.score_runs(base.repartition(n)).collect()
    )
    assert pick(1) == pick(7)


def test_rates_sum_to_one(spark):
    rows = table(spark, *[("1", "1", i % 3 == 0) for i in range(10)])
    assert one(m.answer_rate(rows)).value + one(m.abstention_rate(rows)).value == pytest.approx(1.0)


def test_published_counts_give_the_published_scores(spark):
    """Counts of one recorded run: 160 rows, 30 abstained, 123 correct, four filled bins."""
    bins = [(1, 1, 0.76), (5, 3, 0.844), (15, 15, 13.6 / 15), (109, 104, 105.59 / 109)]
    rows = [("1", "1" if i < hits else "2", False, conf, None, False) for n, hits, conf in bins for i in range(n)]
    rows += [(None, "2", True, None, None, True)] * 30
    got = {r.metric: r.value for r in m.score_runs(table(spark, *rows)).collect()}
    assert got["accuracy"] == pytest.approx(0.76875)
    assert got["selective_accuracy"] == pytest.approx(123 / 130)
    assert got["deferral_alignment"] == 1.0
    assert got["expected_calibration_error"] == pytest.approx(0.0342307692, abs=1e-6)
