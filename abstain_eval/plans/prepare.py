"""The preparation job: raw case table to evaluation records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.contracts import PrepConfig
from abstain_eval.operators import clinical, encode, impute, order, synthesize, validate
from abstain_eval.session import cut_lineage

STRATUM = {"detection": "class", "staging": "ckd_stage", "progression": "ckd_stage"}


@dataclass
class Prepared:
    """Tables of one preparation."""

    clean: DataFrame
    imputed: DataFrame
    imputation: impute.FittedImputation
    ranges: DataFrame
    scaled: DataFrame
    train: DataFrame
    stats: DataFrame
    cases: DataFrame
    records: DataFrame
    description: DataFrame  # counts of cases and records
    missing: DataFrame  # rows and missing values of the raw table


def impute_frame(
    frame: DataFrame, config: PrepConfig
) -> tuple[impute.FittedImputation, DataFrame]:
    """Imputed clinical frame, rows keyed by id, target rounded."""
    columns = [*k.NOMINAL_COLUMNS, *k.NUMERIC_FEATURES, k.TARGET_COLUMN]
    make = impute.Boosting(seed=config.seed) if config.estimator == "gbt" else config.estimator
    if config.fit_on == "all":
        fitted, imputed = impute.fit_imputation(frame, columns, make, config.rounds)
    else:
        marked = order.stratified_split(frame, k.TARGET_COLUMN, [k.ID_COLUMN], config.test_size, config.seed)
        fitted, _ = impute.fit_imputation(
            marked.filter(~F.col("is_test")).drop("is_test"), columns, make, config.rounds
        )
        imputed = fitted.transform(frame)
    return fitted, encode.round_target(imputed)


def prepare(
    raw: DataFrame, config: PrepConfig | None = None, check: bool = True, names: Sequence[str] | None = None
) -> Prepared:
    """Validate, clean, encode, impute, derive, split, extend and build the records.

    ``names`` is the header as the file has it (``header_names``); readers rename repeated columns.
    """
    config = config or PrepConfig()
    if check:
        validate.assert_valid(validate.violations(raw, names, config.sex_column))
    clean = validate.clean_cases(raw, config.sex_column)
    keep = [config.sex_column] if config.sex_column else []
    fitted, frame = impute_frame(encode.encoded_frame(clean, keep), config)
    imputed = cut_lineage(frame)
    # The reduced or full frame in [0, 1], for classical models; numbered only where it is used.
    numbered = order.seeded_shuffle(imputed, [k.ID_COLUMN], config.seed, "impute")
    scaled, ranges = encode.fit_scale(numbered, config.features, ["row_idx"])
    cased = imputed.withColumn("case_id", F.col(k.ID_COLUMN).cast("bigint"))
    engineered = clinical.derive_features(
        cased, config.seed, "case_id", config.split_stage_3, config.sex_column
    )
    order.refuse_small_strata(engineered, STRATUM[config.task])
    split = order.stratified_split(
        engineered, STRATUM[config.task], ["case_id"], config.test_size, config.seed
    )
    train, test = split.filter(~F.col("is_test")), split.filter("is_test")
    stats = cut_lineage(synthesize.fit_stage_stats(train))
    made = synthesize.generate(stats, config.n_synthetic, config.seed) if config.n_synthetic else None
    cases = synthesize.merge_cases(test, made, config.seed)
    records = clinical.build_records(cases, config.task, config.features, config.seed)
    described = synthesize.describe_cases(cases, records)
    missing = validate.missing_profile(clean)
    return Prepared(clean, imputed, fitted, ranges, scaled, train, stats, cases, records, described, missing)
