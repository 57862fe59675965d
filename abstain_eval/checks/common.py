"""Shared pieces of the queries and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.functions.numbers import round_half_up
from abstain_eval.plans import derived as d

Query = Callable[[SparkSession, str], DataFrame]

DIGITS = 9


def r9(c) -> Column:
    return round_half_up(c, DIGITS)


def q9(expr: str) -> str:
    """The same rounding in DuckDB."""
    return f"(case when ({expr}) < 0 then -floor(-({expr}) * 1e9 + 0.5) / 1e9 else floor(({expr}) * 1e9 + 0.5) / 1e9 end)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r9(c) for c in names})


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derive(spark, sf_dir, d.EVALUATIONS)


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derive(spark, sf_dir, d.CLINICAL_CASES)


def raw_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derive(spark, sf_dir, d.RAW_CASES)


def dirty_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.derive(spark, sf_dir, d.DIRTY_CASES)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = d.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return d.spread(keys, "k")


EV = f"with e as ({d.EVALUATIONS}), f as (select *, lower(trim(prediction)) = ground_truth and prediction is not null as hit, coalesce(ckd_stage, -1) as stage, case when ckd_stage is null then 'unknown_stage' else 'stage_' || ckd_stage end as part, not abstained and confidence is not null and prediction is not null as usable, least(cast(trunc(confidence * 15) as int), 14) as bin from e)"


def md5_uniform(text: str, part: int = 0) -> str:
    return f"(('0x' || substr({text}, {1 + 13 * part}, 13))::bigint / 4503599627370496.0::double)"


def digest(stream: str, *keys: str, seed: int = 42) -> str:
    parts = " || '|' || ".join(f"cast({key} as varchar)" for key in keys)
    return f"md5('{seed}|{stream}|' || {parts})"
