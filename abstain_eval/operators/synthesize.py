"""Per-stratum statistics and synthetic cases drawn from them, by the contract of a domain.

Numbers are drawn from a clipped normal distribution, nominal columns of the codes 0 and 1 by the
share of ones, and other nominal columns by the shares of their codes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abstain_eval import contracts as k
from abstain_eval.functions.joins import sized_side
from abstain_eval.functions.numbers import (
    clamp, digest_normal, draw_digest, hash_uniform, round_half_up,
)
from abstain_eval.operators.clinical import (
    require_columns, sex_from_prevalence, stage_from_egfr, with_egfr,
)
from abstain_eval.operators.order import seeded_shuffle
from abstain_eval.schema import KIDNEY, Contract

MIN_STD = 1e-6


def drawn_numbers(contract: Contract) -> list[str]:
    """The numeric features in the order of the case table."""
    return [r.name for r in contract.rules if r.kind == "number" and r.feature]


def is_flag(column: str, contract: Contract) -> bool:
    return {code for _, code in contract.by_name[column].codes} == {0.0, 1.0}


def fit_stage_stats(cases: DataFrame, contract: Contract = KIDNEY) -> DataFrame:
    """One row per stratum: rows, mean and sample deviation of numbers, shares of flags and codes."""
    needed = [*contract.feature_set("full"), contract.strata, contract.target]
    require_columns(cases, list(dict.fromkeys(needed)), "fitting stage statistics")
    aggregates = [F.count(F.lit(1)).alias("n")]
    for c in drawn_numbers(contract):
        aggregates += [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    for c in contract.nominal:
        if is_flag(c, contract):
            aggregates.append(F.avg(c).alias(f"mean_{c}"))
        else:
            codes = enumerate(code for _, code in contract.by_name[c].codes)
            aggregates += [F.avg((F.col(c) == code).cast("double")).alias(f"share_{c}_{i}") for i, code in codes]
    return cases.groupBy(contract.strata).agg(*aggregates)


def stage_stats_long(stats: DataFrame, contract: Contract = KIDNEY) -> DataFrame:
    """The same as rows (stratum, feature, kind, mean, std, n); a code's share has its column and text as feature."""
    none = F.lit(None).cast("double")

    def entry(feature: str, kind: str, mean: str, std: Column) -> Column:
        return F.struct(F.lit(feature).alias("feature"), F.lit(kind).alias("kind"), F.col(mean).alias("mean"), std.alias("std"))

    rows = [entry(c, "continuous", f"mean_{c}", F.col(f"std_{c}")) for c in drawn_numbers(contract)]
    for c in contract.nominal:
        if is_flag(c, contract):
            rows.append(entry(c, "binary", f"mean_{c}", none))
        else:
            rows += [entry(f"{c}={v}", "share", f"share_{c}_{i}", none) for i, (v, _) in enumerate(contract.by_name[c].codes)]
    return stats.select(contract.strata, "n", F.inline(F.array(*rows)))


def stage_shares(stats: DataFrame, stratum: str = KIDNEY.strata) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    return stats.select(stratum, "n", (F.col("n") / total).alias("share"))


def allocate_rows(stats: DataFrame, n: int, stratum: str = KIDNEY.strata) -> DataFrame:
    """Rows per stratum: floor of the share, the rest to the most common (lowest) one."""
    floored = stage_shares(stats, stratum).withColumn("_rows", F.floor(F.col("share") * n).cast("bigint"))
    rest = F.lit(n).cast("bigint") - F.sum("_rows").over(Window.partitionBy())
    first = F.row_number().over(Window.orderBy(F.col("share").desc(), stratum)) == 1
    return floored.select(stratum, (F.col("_rows") + F.when(first, rest).otherwise(0)).alias("rows"))


def stage_rows(spark: SparkSession, allocation: DataFrame, n: int, stratum: str = KIDNEY.strata) -> DataFrame:
    """n rows (stratum, draw_idx), spread over tasks by a range scan.

    The allocation has one row per stratum, so its running bounds enter as one small array.
    """
    until = F.sum("rows").over(Window.orderBy(stratum))
    bounds = allocation.select(stratum, "rows", until.alias("upto")).agg(
        F.array_sort(F.collect_list(F.struct("upto", stratum, "rows"))).alias("b")
    )
    ids = spark.range(n).withColumn("_bounds", bounds.scalar())
    return ids.withColumn(
        "_b", F.filter("_bounds", lambda b: b.getField("upto") > F.col("id"))[0]
    ).select(
        F.col("_b")[stratum].alias(stratum),
        (F.col("id") - F.col("_b.upto") + F.col("_b.rows")).alias("draw_idx"),
    )


def clipped_value(column: str, contract: Contract = KIDNEY) -> Column:
    """Stratum mean plus the scaled normal draw ``_z_<column>``, clipped to the column's bounds."""
    mean, std = F.col(f"mean_{column}"), F.coalesce(F.col(f"std_{column}"), F.lit(0.0))
    value = mean + F.when(std < MIN_STD, F.lit(0.0)).otherwise(std * F.col(f"_z_{column}"))
    rule = contract.by_name[column]
    return clamp(value, rule.low, rule.high)


def draw_flag(column: str, seed: int, columns: list[str], stratum: str = KIDNEY.strata) -> Column:
    """0/1 draw with the stratum's share; one half when no share was fitted."""
    name = f"mean_{column}"
    share = F.coalesce(F.col(name), F.lit(0.5)) if name in columns else F.lit(0.5)
    return (hash_uniform(seed, column, stratum, "draw_idx") < clamp(share, 0.0, 1.0)).cast("double")


def draw_code(column: str, seed: int, contract: Contract) -> Column:
    """One of the column's codes by their shares in the stratum; the last one when no share was fitted."""
    drawn = hash_uniform(seed, column, contract.strata, "draw_idx")
    codes = [code for _, code in contract.by_name[column].codes]
    upto, chain = F.lit(0.0), None
    for i, code in enumerate(codes[:-1]):
        upto = upto + F.coalesce(F.col(f"share_{column}_{i}"), F.lit(0.0))
        chain = F.when(drawn < upto, code) if chain is None else chain.when(drawn < upto, code)
    return F.lit(codes[-1]) if chain is None else chain.otherwise(codes[-1])


def class_of_stage() -> Column:
    return F.when(F.col("ckd_stage") <= 2, 1).otherwise(0)


def stage_age() -> Column:
    chain = None
    for stage, age in k.STAGE_AGE.items():
        hit = F.col("ckd_stage") == stage
        chain = F.when(hit, age) if chain is None else chain.when(hit, age)
    return chain.otherwise(k.OTHER_STAGE_AGE)


def kidney_extras(cases: DataFrame, seed: int) -> DataFrame:
    """Class, sex and eGFR of drawn cases, from their stage."""
    keys = ["ckd_stage", "draw_idx"]
    drawn = cases.withColumns(
        {"class": class_of_stage(), "sex": sex_from_prevalence(seed, *keys), "_stage_age": stage_age()}
    )
    return with_egfr(drawn, "sc", "_stage_age", "sex").drop("_stage_age")


def generate(
    stats: DataFrame,
    n: int,
    seed: int = 42,
    contract: Contract = KIDNEY,
    derive: Callable[[DataFrame, int], DataFrame] | None = kidney_extras,
) -> DataFrame:
    """n synthetic cases. Each draw hangs on (seed, feature, stratum, draw_idx) alone.

    ``derive`` adds what a domain computes from drawn values; a domain whose strata are its
    labels needs none.
    """
    spark, stratum = stats.sparkSession, contract.strata
    fitted = sized_side(stats)
    rows = stage_rows(spark, allocate_rows(fitted, n, stratum), n, stratum).join(fitted.drop("n"), stratum)
    # One projection per step, so that every digest and logarithm is computed once per row.
    numbers, keys = drawn_numbers(contract), [stratum, "draw_idx"]
    digests = rows.withColumns({f"_d_{c}": draw_digest(seed, c, *keys) for c in numbers})
    normals = digests.withColumns({f"_z_{c}": digest_normal(F.col(f"_d_{c}")) for c in numbers})

    def coded(c: str) -> Column:
        return draw_flag(c, seed, stats.columns, stratum) if is_flag(c, contract) else draw_code(c, seed, contract)

    values = normals.select(
        *keys, *[clipped_value(c, contract).alias(c) for c in numbers], *[coded(c).alias(c) for c in contract.nominal]
    )
    rounded = values.withColumns({c: round_half_up(c, 4) for c in numbers})
    return derive(rounded, seed) if derive else rounded


CASE_COLUMNS = [*k.FULL_FEATURES, "class", "sex", "egfr", "ckd_stage"]


def merge_cases(real: DataFrame, synthetic: DataFrame | None, seed: int = 42) -> DataFrame:
    """Held-out and synthetic cases in one seeded order, with ``case_id`` = ``row_idx``."""
    origin = real.select(
        F.lit(False).alias("is_synthetic"),
        F.concat(F.lit("r"), F.col("case_id").cast("string")).alias("origin"),
        *CASE_COLUMNS,
    )
    if synthetic is not None:
        made = synthetic.select(
            F.lit(True).alias("is_synthetic"),
            F.concat_ws("_", F.lit("s"), F.col("ckd_stage"), F.col("draw_idx")).alias("origin"),
            *CASE_COLUMNS,
        )
        origin = origin.unionByName(made)
    return seeded_shuffle(origin, ["origin"], seed, "merge").withColumn("case_id", F.col("row_idx"))


def describe_cases(cases: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Counts (section, name, n): origin, label, stage, and from the records direction and deferral.

    Cases are first counted by all four keys together; the grouping sets work on that.
    """
    cube = cases.groupBy("is_synthetic", "class", "ckd_stage", _stage_disagrees().alias("odd")).count()
    counted = cube.groupingSets(
        [["is_synthetic"], ["class"], ["ckd_stage"], ["odd"], []],
        "is_synthetic", "class", "ckd_stage", "odd",
    ).agg(F.grouping_id().alias("g"), F.sum("count").alias("n"))
    section = (
        F.when(F.col("g") == 0b0111, "origin")
        .when(F.col("g") == 0b1011, "label")
        .when(F.col("g") == 0b1101, "stage")
        .when(F.col("g") == 0b1110, "egfr_stage")
        .otherwise("total")
    )
    name = (
        F.when(F.col("g") == 0b0111, F.when(F.col("is_synthetic"), "synthetic").otherwise("real"))
        .when(F.col("g") == 0b1011, F.concat(F.lit("class_"), F.col("class").cast("string")))
        .when(F.col("g") == 0b1101, F.concat(F.lit("stage_"), F.col("ckd_stage").cast("string")))
        .when(F.col("g") == 0b1110, F.when(F.col("odd"), "disagrees").otherwise("agrees"))
        .otherwise("cases")
    )
    rows = counted.select(section.alias("section"), name.alias("name"), "n")
    if records is None:
        return rows
    flags = records.groupBy("task", "label", F.col("metadata.should_abstain").alias("s")).count()
    direction = flags.filter("task = 'progression'").groupBy(F.col("label").alias("name")).agg(
        F.sum("count").alias("n")
    )
    deferral = flags.agg(F.coalesce(F.sum(F.when(F.col("s"), F.col("count"))), F.lit(0)).alias("n"))
    return rows.unionByName(
        direction.select(F.lit("progression").alias("section"), "name", "n")
    ).unionByName(
        deferral.select(F.lit("deferral").alias("section"), F.lit("should_abstain").alias("name"), "n")
    )


def _stage_disagrees() -> Column:
    """The assigned stage is not the stage of the eGFR value."""
    return stage_from_egfr("egfr") != F.col("ckd_stage")
