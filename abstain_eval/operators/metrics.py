"""Metrics over evaluation rows, for many runs at once.

Every metric first counts per run and stage (or class, or bin) with partial aggregation
on the mapper, and folds the few counted rows into one row per run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.functions.labels import binary_label, label_key, labels_match
from abstain_eval.functions.numbers import finite_or_null, ratio

SCORE_COLUMNS = [
    "run_id", "metric", "value", "breakdown", "n_evaluated", "n_abstained", "reason", "details",
]


def stage_of() -> Column:
    """Stage of a row; absent and negative stages share -1."""
    return F.greatest(F.coalesce(F.col("ckd_stage"), F.lit(-1)), F.lit(-1)).cast("int")


def stage_name(stage: Column) -> Column:
    return F.when(stage < 0, F.lit("unknown_stage")).otherwise(
        F.concat(F.lit("stage_"), stage.cast("string"))
    )


def clamped_confidence() -> Column:
    """Confidence in [0, 1]; NaN counts as 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))


def bin_index(confidence: Column, n_bins: int) -> Column:
    return F.least((confidence * n_bins).cast("int"), F.lit(n_bins - 1))


def usable_for_calibration() -> Column:
    return ~F.col("abstained") & F.col("confidence").isNotNull() & F.col("prediction").isNotNull()


def label_hit() -> Column:
    """Prediction matches the truth, whatever the abstention flag."""
    return labels_match("prediction", "ground_truth")


def key_hit() -> Column:
    """Answered with the same class key as the truth."""
    same = label_key("prediction") == label_key("ground_truth")
    return ~F.col("abstained") & F.coalesce(same, F.lit(False))


def answered_rows(evaluations: DataFrame) -> DataFrame:
    return evaluations.filter(~F.col("abstained"))


def abstained_rows(evaluations: DataFrame) -> DataFrame:
    return evaluations.filter("abstained")


def calibration_rows(evaluations: DataFrame) -> DataFrame:
    return evaluations.filter(usable_for_calibration())


def confidence_complete(evaluations: DataFrame) -> DataFrame:
    """Per run: does every answered row carry a confidence."""
    lacking = ~F.col("abstained") & F.col("confidence").isNull()
    return evaluations.groupBy("run_id").agg((F.count_if(lacking) == 0).alias("complete"))


def with_label_keys(evaluations: DataFrame) -> DataFrame:
    return evaluations.withColumns(
        {
            "truth_key": label_key("ground_truth"),
            "prediction_key": label_key("prediction"),
            "is_match": label_hit(),
        }
    )


def _named_map(entries: Column) -> Column:
    """Map out of a collected list of at most one small struct per stage or bin."""
    return F.map_from_entries(F.array_sort(entries))


def _empty_breakdown() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))


def _score(
    df: DataFrame,
    metric: str,
    value: Column,
    n_evaluated: Column,
    breakdown: Column | None = None,
    reason: Column | None = None,
    details: Column | None = None,
) -> DataFrame:
    no_text = F.lit(None).cast("string")
    return df.select(
        "run_id",
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        (_empty_breakdown() if breakdown is None else breakdown).alias("breakdown"),
        n_evaluated.cast("bigint").alias("n_evaluated"),
        F.col("n_abstained"),
        (no_text if reason is None else reason).alias("reason"),
        (no_text if details is None else details).alias("details"),
    )


def _stage_counts(evaluations: DataFrame, scored: Column, positive: Column) -> DataFrame:
    """One row per run: scored and positive rows, abstentions and the per-stage rates."""
    per_stage = evaluations.groupBy("run_id", stage_of().alias("stage")).agg(
        F.count_if(scored).alias("scored"),
        F.count_if(scored & positive).alias("positive"),
        F.count_if("abstained").alias("abstained"),
    )
    entry = F.struct(stage_name(F.col("stage")), ratio("positive", "scored"))
    return per_stage.groupBy("run_id").agg(
        F.sum("scored").alias("scored"),
        F.sum("positive").alias("positive"),
        F.sum("abstained").alias("n_abstained"),
        _named_map(F.collect_list(F.when(F.col("scored") > 0, entry))).alias("breakdown"),
    )


def _reason_when(undefined: Column, reason: str) -> Column:
    return F.when(undefined, F.lit(reason))


def accuracy(evaluations: DataFrame, abstention_is_neutral: bool = False) -> DataFrame:
    """Share of matching rows; an abstention is wrong, or left out when neutral."""
    answered = ~F.col("abstained")
    scored = answered if abstention_is_neutral else F.lit(True)
    counts = _stage_counts(evaluations, scored, answered & label_hit())
    return _score(
        counts,
        "accuracy",
        ratio("positive", "scored"),
        F.col("scored"),
        F.col("breakdown"),
        _reason_when(F.col("scored") == 0, k.NO_ANSWERED),
        F.when(
            F.col("scored") > 0,
            F.to_json(
                F.struct(
                    F.col("positive").alias("n_correct"),
                    (F.col("scored") - F.col("positive")).alias("n_incorrect"),
                    F.lit(abstention_is_neutral).alias("treat_abstention_as_neutral"),
                )
            ),
        ),
    )


def selective_accuracy(evaluations: DataFrame) -> DataFrame:
    """Share of matching rows among the answered ones."""
    counts = _stage_counts(evaluations, ~F.col("abstained"), label_hit())
    return _score(
        counts,
        "selective_accuracy",
        ratio("positive", "scored"),
        F.col("scored"),
        F.col("breakdown"),
        _reason_when(F.col("scored") == 0, k.NO_ANSWERED),
        F.when(
            F.col("scored") > 0,
            F.to_json(
                F.struct(
                    F.col("positive").alias("n_correct"),
                    (F.col("scored") - F.col("positive")).alias("n_incorrect"),
                )
            ),
        ),
    )


def _rate(evaluations: DataFrame, metric: str, positive: Column) -> DataFrame:
    counts = _stage_counts(evaluations, F.lit(True), positive)
    answered = F.struct((F.col("scored") - F.col("n_abstained")).alias("n_answered"))
    return _score(
        counts, metric, ratio("positive", "scored"), F.col("scored"), F.col("breakdown"),
        details=F.to_json(answered),
    )


def abstention_rate(evaluations: DataFrame) -> DataFrame:
    return _rate(evaluations, "abstention_rate", F.col("abstained"))


def answer_rate(evaluations: DataFrame) -> DataFrame:
    return _rate(evaluations, "answer_rate", ~F.col("abstained"))


def balanced_accuracy(evaluations: DataFrame) -> DataFrame:
    """Mean over true classes of the class hit rate, overall and per stage."""
    per_class = evaluations.groupBy(
        "run_id", stage_of().alias("stage"), label_key("ground_truth").alias("truth_key")
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(key_hit()).alias("hits"),
        F.count_if("abstained").alias("abstained"),
    )
    # The counted rows are few, so both groupings of them are cheap.
    both = per_class.groupingSets(
        [["run_id", "truth_key"], ["run_id", "stage", "truth_key"]],
        "run_id", "stage", "truth_key",
    ).agg(
        F.grouping("stage").alias("overall"),
        F.sum("rows").alias("rows"),
        F.sum("hits").alias("hits"),
        F.sum("abstained").alias("abstained"),
    )
    means = both.groupBy("run_id", "overall", "stage").agg(
        F.avg(ratio("hits", "rows")).alias("score"),
        F.count(F.lit(1)).alias("classes"),
        F.sum("rows").alias("rows"),
        F.sum("abstained").alias("abstained"),
    )
    overall = F.col("overall") == 1
    entry = F.struct(stage_name(F.col("stage")), F.col("score"))
    per_run = means.groupBy("run_id").agg(
        F.max(F.when(overall, F.col("score"))).alias("score"),
        F.max(F.when(overall, F.col("classes"))).alias("classes"),
        F.max(F.when(overall, F.col("rows"))).alias("rows"),
        F.max(F.when(overall, F.col("abstained"))).alias("n_abstained"),
        _named_map(
            F.collect_list(F.when(~overall & (F.col("classes") >= 2), entry))
        ).alias("breakdown"),
    )
    defined = F.col("classes") >= 2
    return _score(
        per_run,
        "balanced_accuracy",
        F.when(defined, F.col("score")),
        F.col("rows"),
        F.when(defined, F.col("breakdown")).otherwise(_empty_breakdown()),
        _reason_when(~defined, k.NEEDS_TWO_CLASSES),
    )


def deferral_alignment(evaluations: DataFrame) -> DataFrame:
    """Agreement of abstention with the deferral flag over the rows that carry one."""
    flag, abstained = F.col("should_abstain"), F.col("abstained")
    counts = evaluations.groupBy("run_id").agg(
        F.count("should_abstain").alias("labeled"),
        F.count_if(flag & abstained).alias("defer_when_needed"),
        F.count_if(~flag & ~abstained).alias("answer_when_safe"),
        F.count_if(~flag & abstained).alias("abstain_when_should_answer"),
        F.count_if(flag & ~abstained).alias("answer_when_should_defer"),
        F.count_if(abstained).alias("n_abstained"),
    )
    return _score(
        counts,
        "deferral_alignment",
        ratio(F.col("defer_when_needed") + F.col("answer_when_safe"), "labeled"),
        F.col("labeled"),
        reason=_reason_when(F.col("labeled") == 0, k.NO_FLAG),
        details=F.when(
            F.col("labeled") > 0,
            F.to_json(F.struct(F.col("labeled").alias("n_labeled"), _confusion().alias("confusion"))),
        ),
    )


def _confusion() -> Column:
    return F.struct(
        "defer_when_needed", "answer_when_safe",
        "abstain_when_should_answer", "answer_when_should_defer",
    )


def _bin_counts(evaluations: DataFrame, n_bins: int) -> DataFrame:
    confidence = clamped_confidence()
    return calibration_rows(evaluations).groupBy(
        "run_id", bin_index(confidence, n_bins).alias("bin")
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(label_hit()).alias("hits"),
        F.sum(confidence).alias("confidence_sum"),
    )


def _bin_struct(n_bins: int, prefix: str = "") -> Column:
    """The reliability row of one filled bin."""
    accuracy_, mean_ = ratio("hits", "count"), ratio("confidence_sum", "count")
    return F.struct(
        F.col("bin"),
        (F.col("bin") / F.lit(float(n_bins))).alias("low"),
        ((F.col("bin") + 1) / F.lit(float(n_bins))).alias("high"),
        F.col("count"),
        accuracy_.alias("accuracy"),
        mean_.alias("mean_confidence"),
        F.abs(accuracy_ - mean_).alias("gap"),
    )


def _all_bins(filled: Column, n_bins: int) -> Column:
    """Complete a map bin -> row with the empty bins, in order."""
    low = lambda b: b / F.lit(float(n_bins))
    empty = lambda b: F.struct(
        b.alias("bin"), low(b).alias("low"), low(b + 1).alias("high"),
        F.lit(0).cast("bigint").alias("count"),
        *[F.lit(None).cast("double").alias(c) for c in ("accuracy", "mean_confidence", "gap")],
    )
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: F.coalesce(filled[b], empty(b))
    )


def _filled_map(n_bins: int) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(F.col("bin"), _bin_struct(n_bins))))


def reliability_bins(evaluations: DataFrame, n_bins: int = k.N_BINS) -> DataFrame:
    """Count, accuracy, mean confidence and gap of every bin, empty bins included."""
    _check_bins(n_bins)
    per_run = _bin_counts(evaluations, n_bins).groupBy("run_id").agg(_filled_map(n_bins).alias("m"))
    return per_run.select("run_id", F.inline(_all_bins(F.col("m"), n_bins)))


def _check_bins(n_bins: int) -> None:
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")


def expected_calibration_error(evaluations: DataFrame, n_bins: int = k.N_BINS) -> DataFrame:
    """Bin-weighted gap between accuracy and mean confidence over equal-width bins."""
    _check_bins(n_bins)
    confidence, usable = clamped_confidence(), usable_for_calibration()
    # Unusable rows stay in a null bin so that every run keeps its abstention count.
    binned = evaluations.groupBy(
        "run_id", F.when(usable, bin_index(confidence, n_bins)).alias("bin")
    ).agg(
        F.count_if(usable).alias("count"),
        F.count_if(usable & label_hit()).alias("hits"),
        F.sum(F.when(usable, confidence)).alias("confidence_sum"),
        F.count_if("abstained").alias("abstained"),
    )
    return _calibration_score(binned.groupBy("run_id").agg(*_calibration_columns(n_bins)), n_bins)


def _calibration_columns(n_bins: int, filled: Column | None = None) -> list[Column]:
    filled = F.col("bin").isNotNull() if filled is None else filled
    row = _bin_struct(n_bins)
    gap = F.abs(ratio("hits", "count") - ratio("confidence_sum", "count"))
    name = F.concat(F.lit("bin_"), F.col("bin").cast("string"), F.lit("_gap"))
    return [
        F.sum(F.when(filled, F.col("count"))).alias("usable"),
        F.sum(F.when(filled, F.col("count") * gap)).alias("weighted_gap"),
        F.sum("abstained").alias("n_abstained"),
        _named_map(F.collect_list(F.when(filled, F.struct(name, gap)))).alias("gaps"),
        F.map_from_entries(F.collect_list(F.when(filled, F.struct(F.col("bin"), row)))).alias("bins"),
    ]


def _calibration_score(per_run: DataFrame, n_bins: int) -> DataFrame:
    undefined = F.coalesce(F.col("usable"), F.lit(0)) == 0
    details = F.to_json(
        F.struct(F.lit(n_bins).alias("n_bins"), _all_bins(F.col("bins"), n_bins).alias("bins")),
        {"ignoreNullFields": "false"},
    )
    return _score(
        per_run,
        "expected_calibration_error",
        ratio("weighted_gap", "usable"),
        F.coalesce(F.col("usable"), F.lit(0)),
        F.col("gaps"),
        _reason_when(undefined, k.NO_CONFIDENCE),
        F.when(~undefined, details),
    )


def _brier_columns() -> dict[str, Column]:
    """Squared error and the not-binary mark of a usable row."""
    usable = usable_for_calibration()
    truth, prediction = binary_label("ground_truth"), binary_label("prediction")
    positive = F.when(prediction == 1, clamped_confidence()).otherwise(1.0 - clamped_confidence())
    return {
        "squared_error": F.sum(F.when(usable, F.pow(positive - truth, F.lit(2.0)))),
        "not_binary": F.count_if(usable & (truth.isNull() | prediction.isNull())),
    }


def brier_score(evaluations: DataFrame) -> DataFrame:
    """Mean squared error of the positive-class probability; binary runs only."""
    columns = _brier_columns()
    per_run = evaluations.groupBy("run_id").agg(
        F.count_if(usable_for_calibration()).alias("usable"),
        columns["squared_error"].alias("squared_error"),
        columns["not_binary"].alias("not_binary"),
        F.count_if("abstained").alias("n_abstained"),
    )
    return _brier_of(per_run)


def _brier_of(per_run: DataFrame) -> DataFrame:
    return _score(
        per_run,
        "brier_score",
        F.when(F.col("not_binary") == 0, ratio("squared_error", "usable")),
        F.col("usable"),
        reason=F.when(F.col("usable") == 0, k.NO_CONFIDENCE).when(
            F.col("not_binary") > 0, k.NOT_BINARY
        ),
    )


def _judged(evaluations: DataFrame) -> DataFrame:
    """Label comparisons of every row, made once and then only counted."""
    return evaluations.withColumns(
        {
            "_match": label_hit(),
            "_same_key": key_hit(),
            "_truth_key": label_key("ground_truth"),
            "_truth": binary_label("ground_truth"),
            "_guess": binary_label("prediction"),
            "_usable": usable_for_calibration(),
            "_sure": clamped_confidence(),
        }
    )


def score_cube(evaluations: DataFrame, n_bins: int = k.N_BINS) -> DataFrame:
    """Counts by run, stage, true class and confidence bin: the one pass over the rows."""
    usable, match, sure = F.col("_usable"), F.col("_match"), F.col("_sure")
    flag, abstained = F.col("should_abstain"), F.col("abstained")
    positive = F.when(F.col("_guess") == 1, sure).otherwise(1.0 - sure)
    not_binary = F.col("_truth").isNull() | F.col("_guess").isNull()
    return _judged(evaluations).groupBy(
        "run_id",
        stage_of().alias("stage"),
        F.col("_truth_key").alias("truth_key"),
        F.when(usable, bin_index(sure, n_bins)).alias("bin"),
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(abstained).alias("abstained"),
        F.count_if(~abstained & match).alias("correct"),
        F.count_if("_same_key").alias("key_hits"),
        F.count("should_abstain").alias("labeled"),
        F.count_if(flag & abstained).alias("defer_when_needed"),
        F.count_if(~flag & ~abstained).alias("answer_when_safe"),
        F.count_if(~flag & abstained).alias("abstain_when_should_answer"),
        F.count_if(flag & ~abstained).alias("answer_when_should_defer"),
        F.count_if(usable).alias("count"),
        F.count_if(usable & match).alias("hits"),
        F.sum(F.when(usable, sure)).alias("confidence_sum"),
        F.sum(F.when(usable, F.pow(positive - F.col("_truth"), F.lit(2.0)))).alias("squared_error"),
        F.count_if(usable & not_binary).alias("not_binary"),
    )


_COUNTED = [
    "rows", "abstained", "correct", "key_hits", "labeled", "defer_when_needed",
    "answer_when_safe", "abstain_when_should_answer", "answer_when_should_defer",
    "count", "hits", "confidence_sum", "squared_error", "not_binary",
]


def score_runs(evaluations: DataFrame, n_bins: int = k.N_BINS) -> DataFrame:
    """All eight metrics of every run as long rows, from a single pass over the rows.

    The cube is folded by grouping sets into one level per breakdown, class means are
    taken per (run, stage), and one wide row per run is opened into metric rows.
    """
    _check_bins(n_bins)
    levels = score_cube(evaluations, n_bins).groupingSets(
        [
            ["run_id"], ["run_id", "stage"], ["run_id", "bin"],
            ["run_id", "truth_key"], ["run_id", "stage", "truth_key"],
        ],
        "run_id", "stage", "truth_key", "bin",
    ).agg(
        (F.grouping("stage") == 0).alias("by_stage"),
        (F.grouping("truth_key") == 0).alias("by_class"),
        (F.grouping("bin") == 0).alias("by_bin"),
        *[F.sum(c).alias(c) for c in _COUNTED],
    )
    class_rate = F.when(F.col("by_class"), ratio("key_hits", "rows"))
    folded = levels.groupBy(
        "run_id", "by_stage", "stage", "by_bin", "bin",
    ).agg(
        F.avg(class_rate).alias("class_mean"),
        F.count_if("by_class").alias("classes"),
        *[F.sum(F.when(~F.col("by_class"), F.col(c))).alias(c) for c in _COUNTED],
    )
    total = ~F.col("by_stage") & ~F.col("by_bin")
    stage = F.col("by_stage")
    filled = F.col("by_bin") & F.col("bin").isNotNull()
    answered = F.col("rows") - F.col("abstained")
    gap = F.abs(ratio("hits", "count") - ratio("confidence_sum", "count"))
    gap_name = F.concat(F.lit("bin_"), F.col("bin").cast("string"), F.lit("_gap"))

    def per_stage(value: Column, keep: Column | None = None) -> Column:
        entry = F.struct(stage_name(F.col("stage")), value)
        return _named_map(F.collect_list(F.when(stage if keep is None else stage & keep, entry)))

    wide = folded.groupBy("run_id").agg(
        *[F.max(F.when(total, F.col(c))).alias(c) for c in [*_COUNTED, "class_mean", "classes"]],
        per_stage(ratio("correct", "rows")).alias("m_accuracy"),
        per_stage(ratio("correct", answered), answered > 0).alias("m_selective"),
        per_stage(ratio("abstained", "rows")).alias("m_abstention"),
        per_stage(ratio(answered, "rows")).alias("m_answer"),
        per_stage(F.col("class_mean"), F.col("classes") >= 2).alias("m_balanced"),
        F.sum(F.when(filled, F.col("count") * gap)).alias("weighted_gap"),
        _named_map(F.collect_list(F.when(filled, F.struct(gap_name, gap)))).alias("gaps"),
        F.map_from_entries(
            F.collect_list(F.when(filled, F.struct(F.col("bin"), _bin_struct(n_bins))))
        ).alias("bins"),
    )
    usable = F.coalesce(F.col("count"), F.lit(0))
    two_classes = F.col("classes") >= 2
    n_answered = F.struct(answered.alias("n_answered"))
    no_text, none = F.lit(None).cast("string"), _empty_breakdown()

    def row(metric, value, breakdown, n, reason=no_text, details=no_text) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
            breakdown.alias("breakdown"),
            n.cast("bigint").alias("n_evaluated"),
            F.col("abstained").alias("n_abstained"),
            reason.alias("reason"),
            details.alias("details"),
        )

    bins_json = F.to_json(
        F.struct(F.lit(n_bins).alias("n_bins"), _all_bins(F.col("bins"), n_bins).alias("bins")),
        {"ignoreNullFields": "false"},
    )
    rows = F.array(
        row(
            "abstention_rate", ratio("abstained", "rows"), F.col("m_abstention"), F.col("rows"),
            details=F.to_json(n_answered),
        ),
        row(
            "accuracy", ratio("correct", "rows"), F.col("m_accuracy"), F.col("rows"),
            details=F.to_json(F.struct(
                F.col("correct").alias("n_correct"),
                (F.col("rows") - F.col("correct")).alias("n_incorrect"),
                F.lit(False).alias("treat_abstention_as_neutral"),
            )),
        ),
        row(
            "answer_rate", ratio(answered, "rows"), F.col("m_answer"), F.col("rows"),
            details=F.to_json(n_answered),
        ),
        row(
            "balanced_accuracy", F.when(two_classes, F.col("class_mean")),
            F.when(two_classes, F.col("m_balanced")).otherwise(none), F.col("rows"),
            _reason_when(~two_classes, k.NEEDS_TWO_CLASSES),
        ),
        row(
            "brier_score", F.when(F.col("not_binary") == 0, ratio("squared_error", usable)), none,
            usable,
            F.when(usable == 0, k.NO_CONFIDENCE).when(F.col("not_binary") > 0, k.NOT_BINARY),
        ),
        row(
            "deferral_alignment",
            ratio(F.col("defer_when_needed") + F.col("answer_when_safe"), "labeled"),
            none, F.col("labeled"), _reason_when(F.col("labeled") == 0, k.NO_FLAG),
            F.when(F.col("labeled") > 0, F.to_json(
                F.struct(F.col("labeled").alias("n_labeled"), _confusion().alias("confusion"))
            )),
        ),
        row(
            "expected_calibration_error", ratio("weighted_gap", usable), F.col("gaps"), usable,
            _reason_when(usable == 0, k.NO_CONFIDENCE), F.when(usable > 0, bins_json),
        ),
        row(
            "selective_accuracy", ratio("correct", answered), F.col("m_selective"), answered,
            _reason_when(answered == 0, k.NO_ANSWERED),
            F.when(answered > 0, F.to_json(F.struct(
                F.col("correct").alias("n_correct"),
                (answered - F.col("correct")).alias("n_incorrect"),
            ))),
        ),
    )
    return wide.select("run_id", F.inline(rows)).select(*SCORE_COLUMNS)


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "accuracy": accuracy,
    "balanced_accuracy": balanced_accuracy,
    "expected_calibration_error": expected_calibration_error,
    "brier_score": brier_score,
    "answer_rate": answer_rate,
    "selective_accuracy": selective_accuracy,
    "abstention_rate": abstention_rate,
    "deferral_alignment": deferral_alignment,
}
ACCURACY_METRICS = ["accuracy", "balanced_accuracy"]
CALIBRATION_METRICS = ["expected_calibration_error", "brier_score"]
ABSTENTION_METRICS = [
    "answer_rate", "selective_accuracy", "abstention_rate", "deferral_alignment",
]


def breakdown_rows(scores: DataFrame) -> DataFrame:
    """One row per run, metric and breakdown key."""
    return scores.select("run_id", "metric", F.explode("breakdown").alias("part", "part_value"))


def undefined_metrics(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("value").isNull()).select("run_id", "metric", "reason", "n_evaluated")


def user_metric(
    evaluations: DataFrame, name: str, aggregates: dict[str, Column], value: Column
) -> DataFrame:
    """A metric given as aggregate columns and an expression over them."""
    per_run = evaluations.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_evaluated"),
        F.count_if("abstained").alias("n_abstained"),
        *[c.alias(alias) for alias, c in aggregates.items()],
    )
    return _score(per_run, name, value, F.col("n_evaluated"))


def user_metric_in_pandas(
    evaluations: DataFrame,
    name: str,
    partial: Callable,
    merge: Callable,
    partial_schema: str,
) -> DataFrame:
    """A metric in pandas that never holds a whole run.

    ``partial`` turns one Arrow batch (rows of any runs) into additive parts per run: a
    ``run_id`` column and the numeric columns of ``partial_schema``. Spark adds the parts up,
    and ``merge`` gets the sums of a run as a one-row frame and returns the value.
    """

    def parts_of(batches):
        for batch in batches:
            yield partial(batch)

    def values_of(batches):
        import pandas as pd

        for sums in batches:
            values = [float(merge(sums.iloc[[i]])) for i in range(len(sums))]
            yield pd.DataFrame({"run_id": sums["run_id"], "metric": name, "value": values})

    parts = evaluations.mapInPandas(parts_of, f"run_id string, {partial_schema}")
    sums = parts.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "run_id"])
    return sums.mapInPandas(values_of, "run_id string, metric string, value double")


def with_finite_values(scores: DataFrame) -> DataFrame:
    return scores.withColumn("value", finite_or_null("value"))
