"""Clinical features, task labels, deferral flags and two-visit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.functions.numbers import bounded_number, clamp, hash_uniform, round_half_up
from abstain_eval.operators.encode import feature_columns


def require_columns(df: DataFrame, needed: list[str], step: str) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{step} needs columns {missing}")
    return df


def sex_from_creatinine(seed: int, key: str) -> Column:
    """Draw of sex; low creatinine makes female more likely."""
    chance = None
    for upper, p in k.SEX_BY_CREATININE:
        at_most = F.col("sc") <= upper
        chance = F.when(at_most, p) if chance is None else chance.when(at_most, p)
    chance = chance.otherwise(k.SEX_OTHERWISE)
    return F.when(hash_uniform(seed, "sex", key) < chance, "female").otherwise("male")


def sex_from_prevalence(seed: int, *keys) -> Column:
    return F.when(hash_uniform(seed, "sex_prevalence", *keys) < k.MALE_PREVALENCE, "male").otherwise("female")


def with_egfr(df: DataFrame, creatinine="sc", age="age", sex="sex") -> DataFrame:
    """Add the filtration rate (CKD-EPI 2021), two decimals.

    Built in steps so that each power is taken once per row.
    """
    female = F.coalesce(F.col(sex) == "female", F.lit(False))
    bounded = df.withColumns(
        {
            "_sc": bounded_number(creatinine, k.MIN_CREATININE, k.MIN_CREATININE),
            "_age": bounded_number(age, k.MIN_AGE, k.MIN_AGE),
            "_female": female,
        }
    )
    kappa = F.when(F.col("_female"), k.EGFR_KAPPA["female"]).otherwise(k.EGFR_KAPPA["male"])
    scaled = bounded.withColumn("_scaled", F.col("_sc") / kappa)
    low = F.when(F.col("_female"), k.EGFR_ALPHA["female"]).otherwise(k.EGFR_ALPHA["male"])
    exponent = F.when(F.col("_scaled") < 1, low).otherwise(k.EGFR_HIGH_EXPONENT)
    by_age = F.pow(F.lit(k.EGFR_AGE_FACTOR), F.col("_age"))
    factor = F.when(F.col("_female"), k.EGFR_FEMALE_FACTOR).otherwise(1.0)
    rate = k.EGFR_BASE * F.pow(F.col("_scaled"), exponent) * by_age * factor
    return (
        scaled.withColumn("_rate", rate)
        .withColumn("egfr", round_half_up("_rate", 2))
        .drop("_sc", "_age", "_female", "_scaled", "_rate")
    )


def stage_from_egfr(rate, split_stage_3: bool = False) -> Column:
    rate = F.col(rate) if isinstance(rate, str) else rate
    floors = k.SPLIT_STAGE_FLOORS if split_stage_3 else k.STAGE_FLOORS
    lowest = k.LOWEST_SPLIT_STAGE if split_stage_3 else k.LOWEST_STAGE
    chain = None
    for floor, stage in floors:
        chain = F.when(rate >= floor, stage) if chain is None else chain.when(rate >= floor, stage)
    return chain.otherwise(lowest)


def derive_features(
    df: DataFrame,
    seed: int = 42,
    key: str = "case_id",
    split_stage_3: bool = False,
    sex_column: str | None = None,
) -> DataFrame:
    """Add sex, egfr and ckd_stage; all narrow."""
    require_columns(df, ["sc", "age", *([sex_column] if sex_column else [])], "feature derivation")
    sex = F.col(sex_column) if sex_column else sex_from_creatinine(seed, key)
    return (
        df.withColumn("sex", sex)
        .transform(with_egfr)
        .withColumn("ckd_stage", stage_from_egfr("egfr", split_stage_3))
    )


def nearest_threshold(rate) -> Column:
    """Struct of the nearest stage threshold (the lower one on a tie) and its margin."""
    rate = F.col(rate) if isinstance(rate, str) else rate
    candidates = F.array(
        *[F.struct(F.abs(rate - t).alias("d"), F.lit(t).alias("t")) for t in k.EGFR_THRESHOLDS]
    )
    best = F.array_min(candidates)
    return F.struct(
        best.getField("t").alias("threshold"), round_half_up(best.getField("d"), 2).alias("margin")
    )


def with_threshold(df: DataFrame) -> DataFrame:
    near = df.withColumn("_near", nearest_threshold("egfr"))
    return near.withColumns(
        {
            "nearest_egfr_stage_threshold": F.col("_near.threshold"),
            "egfr_threshold_margin": F.col("_near.margin"),
        }
    ).drop("_near")


def with_deferral(df: DataFrame, task: str) -> DataFrame:
    """Should the model abstain, and why. Needs the threshold columns."""
    label, stage = F.col("class"), F.col("ckd_stage")
    conflict = ((label == 1) & (stage >= 3)) | ((label == 0) & (stage <= 2))
    conflict = F.lit(False) if task == "staging" else conflict
    near = F.col("egfr_threshold_margin") <= k.DEFERRAL_MARGIN
    threshold = F.col("nearest_egfr_stage_threshold").cast("int").cast("string")
    reasons = F.concat_ws(
        ";",
        F.when(conflict, F.lit("label_stage_conflict")),
        F.when(near, F.concat(F.lit("egfr_near_threshold:"), threshold)),
    )
    return df.withColumns(
        {
            "should_abstain": conflict | near,
            "deferral_reason": F.when(reasons == "", F.lit("none")).otherwise(reasons),
        }
    )


def progression_direction(seed: int) -> Column:
    stage, index = F.col("ckd_stage"), F.col("row_idx")
    risk = stage + F.col("htn") + F.col("dm") + clamp("al", high=5.0) / 2.0
    bucket = F.pmod(F.lit(seed) + index * 17 + stage * 13, F.lit(10))
    calm = (stage <= 2) & (F.col("htn") < 0.5) & (F.col("dm") < 0.5) & (F.col("al") <= 1)
    return (
        F.when((risk >= 5.5) | ((stage >= 3) & (bucket < 6)), "worsening")
        .when(calm & (bucket < 3), "stable")
        .when((F.col("hemo") >= 11.5) & (bucket >= 7), "improving")
        .otherwise("stable")
    )


def progression_ambiguous(seed: int) -> Column:
    bucket = F.pmod(F.lit(seed) + F.col("row_idx") * 19 + F.col("ckd_stage") * 7, F.lit(10))
    close = F.lit(False)
    for threshold in k.EGFR_THRESHOLDS:
        close = close | (F.abs(F.col("egfr") - threshold) <= k.AMBIGUITY_MARGIN)
    return (bucket < 3) | close


def _between(c: Column, marker: str) -> Column:
    return clamp(c, *k.CONTINUOUS_BOUNDS[marker])


def _at_least(c: Column, marker: str) -> Column:
    return clamp(c, low=k.CONTINUOUS_BOUNDS[marker][0])


def _at_most(c: Column, marker: str) -> Column:
    return clamp(c, high=k.CONTINUOUS_BOUNDS[marker][1])


def clear_baseline(direction: Column) -> dict[str, Column]:
    """Earlier values of the five moving markers for a plain direction."""
    sc, bu, al, hemo, pcv = (F.col(c) for c in ("sc", "bu", "al", "hemo", "pcv"))
    worse, better = direction == "worsening", direction == "improving"

    def by_direction(when_worse: Column, when_better: Column, otherwise: Column) -> Column:
        return F.when(worse, when_worse).when(better, when_better).otherwise(otherwise)

    return {
        "sc": by_direction(_at_least(sc * 0.86, "sc"), _at_most(sc * 1.16, "sc"), sc * 0.99),
        "bu": by_direction(_at_least(bu * 0.88, "bu"), _at_most(bu * 1.12, "bu"), bu * 0.98),
        "al": by_direction(_at_least(al - 1.0, "al"), _at_most(al + 1.0, "al"), al),
        "hemo": by_direction(_at_most(hemo + 0.7, "hemo"), _at_least(hemo - 0.6, "hemo"), hemo),
        "pcv": by_direction(_at_most(pcv + 2.0, "pcv"), _at_least(pcv - 2.0, "pcv"), pcv),
    }


def mixed_baseline() -> dict[str, Column]:
    """Earlier values with opposing small moves; the sign follows the row's parity."""
    sign = F.when(F.pmod(F.col("row_idx"), F.lit(2)) == 1, -1.0).otherwise(1.0)
    return {
        "sc": _between(F.col("sc") * (1.0 + sign * 0.035), "sc"),
        "bu": _between(F.col("bu") * (1.0 - sign * 0.055), "bu"),
        "al": _between(F.col("al") + sign * 0.5, "al"),
        "hemo": _between(F.col("hemo") - sign * 0.35, "hemo"),
        "pcv": _between(F.col("pcv") + sign * 1.0, "pcv"),
    }


def with_progression(df: DataFrame, seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """Direction, ambiguity and the baseline visit (columns ``baseline_<feature>``)."""
    columns = columns or k.REDUCED_FEATURES
    marked = df.withColumns(
        {
            "progression_direction": progression_direction(seed),
            "progression_ambiguous": progression_ambiguous(seed),
        }
    )
    clear, mixed = clear_baseline(F.col("progression_direction")), mixed_baseline()
    ambiguous = F.col("progression_ambiguous")
    earlier = {}
    for c in columns:
        value = F.when(ambiguous, mixed[c]).otherwise(clear[c]) if c in clear else F.col(c)
        earlier[f"baseline_{c}"] = value.cast("double")
    visits = marked.withColumns(earlier)
    return visits.withColumns({name: round_half_up(name, 4) for name in earlier})


def override_deferral(df: DataFrame) -> DataFrame:
    """An ambiguous trajectory asks for abstention whatever the deferral rule says."""
    ambiguous = F.col("progression_ambiguous")
    reason = F.lit("ambiguous_progression_trajectory")
    return df.withColumns(
        {
            "should_abstain": ambiguous | F.col("should_abstain"),
            "deferral_reason": F.when(ambiguous, reason).otherwise(F.col("deferral_reason")),
        }
    )


def task_label(task: str) -> Column:
    source = {"detection": "class", "staging": "ckd_stage", "progression": "progression_direction"}
    return F.col(source[task]).cast("string")


def _feature_map(columns: list[str], prefix: str = "") -> Column:
    pairs = [part for c in columns for part in (F.lit(c), F.col(prefix + c).cast("double"))]
    return F.create_map(*pairs)


RECORD_COLUMNS = [
    "case_id", "row_idx", "task", "features", "baseline", "current", "trajectory_months",
    "label", "metadata",
]


def build_records(df: DataFrame, task: str, features: str = "reduced", seed: int = 42) -> DataFrame:
    """Evaluation records: visible features, label and hidden metadata."""
    columns = feature_columns(features)
    flagged = df.transform(with_threshold).transform(with_deferral, task)
    empty = F.lit(None).cast("map<string,double>")
    if task == "progression":
        ready = flagged.transform(with_progression, seed, columns).transform(override_deferral)
        shown = empty
        baseline, current = _feature_map(columns, "baseline_"), _feature_map(columns)
        months, ambiguous = F.lit(k.TRAJECTORY_MONTHS), F.col("progression_ambiguous")
    else:
        extra = ["egfr", "nearest_egfr_stage_threshold", "egfr_threshold_margin"]
        ready = flagged
        shown = _feature_map(columns + (extra if task == "staging" else []))
        baseline, current = empty, empty
        months, ambiguous = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    metadata = F.struct(
        "egfr", "ckd_stage", "sex", "class", "should_abstain", "deferral_reason",
        ambiguous.alias("progression_ambiguous"),
    )
    return ready.select(
        "case_id", "row_idx", F.lit(task).alias("task"), shown.alias("features"),
        baseline.alias("baseline"), current.alias("current"), months.alias("trajectory_months"),
        task_label(task).alias("label"), metadata.alias("metadata"),
    )
