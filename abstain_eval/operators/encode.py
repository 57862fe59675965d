"""Encoding, scaling and feature selection of clean case tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abstain_eval import contracts as k
from abstain_eval.operators.order import numbered
from abstain_eval.schema import KIDNEY, Contract


def code_of(column: str, contract: Contract = KIDNEY) -> Column:
    """Ordinal code of a nominal cell; missing and unknown values stay missing."""
    chain = None
    for value, code in contract.by_name[column].codes:
        hit = F.col(column) == value
        chain = F.when(hit, float(code)) if chain is None else chain.when(hit, float(code))
    return chain


def encode_nominal(clean: DataFrame, contract: Contract = KIDNEY) -> DataFrame:
    return clean.withColumns({c: code_of(c, contract) for c in contract.nominal})


def label_classes(df: DataFrame, column: str) -> DataFrame:
    """Distinct labels in sorted order with their codes 0, 1, ...; there may be any number of them."""
    labels = df.select(F.col(column).alias("label")).filter("label is not null").distinct()
    return numbered(labels, ["label"], "code").select("label", F.col("code").cast("int").alias("code"))


def encode_target(clean: DataFrame, contract: Contract = KIDNEY) -> DataFrame:
    """Label to its code, 0, 1, ... in the contract's order."""
    chain = None
    for code, label in enumerate(contract.labels):
        hit = F.col(contract.target) == label
        chain = F.when(hit, code) if chain is None else chain.when(hit, code)
    return clean.withColumn(contract.target, chain)


def encoded_frame(clean: DataFrame, keep: list[str] | None = None, contract: Contract = KIDNEY) -> DataFrame:
    """Nominal codes, numbers and target code, in this order, behind the id."""
    encoded = clean.transform(encode_nominal, contract).transform(encode_target, contract)
    numbers = [F.col(c).cast("double").alias(c) for c in contract.numbers]
    return encoded.select(contract.id, *(keep or []), *contract.nominal, *numbers, contract.target)


def fill_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing cells to the column mean, taken in the same query."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m"))
    ready = df.withColumn("_means", means.scalar())
    return ready.withColumns(
        {c: F.coalesce(F.col(c), F.col("_means").getField(c)) for c in columns}
    ).drop("_means")


def round_target(df: DataFrame, target: str = k.TARGET_COLUMN) -> DataFrame:
    """Nearest integer class, halves to even."""
    return df.withColumn(target, F.bround(target, 0).cast("int"))


def feature_columns(features: str) -> list[str]:
    return k.REDUCED_FEATURES if features == "reduced" else k.FULL_FEATURES


def scaled_columns(features: str, contract: Contract = KIDNEY) -> list[str]:
    """Order of the scaled frame: that of the feature set, or nominal before numeric."""
    return contract.feature_set(features)


def project_features(
    df: DataFrame, features: str, keep: list[str] | None = None, contract: Contract = KIDNEY
) -> DataFrame:
    return df.select(*(keep or []), *scaled_columns(features, contract), contract.target)


def fit_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum per column as rows (column, low, high)."""
    bounds = df.agg(
        *[F.min(c).alias(f"low_{c}") for c in columns], *[F.max(c).alias(f"high_{c}") for c in columns]
    )
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"low_{c}").cast("double").alias("low"),
            F.col(f"high_{c}").cast("double").alias("high"),
        )
        for c in columns
    ]
    return bounds.select(F.inline(F.array(*entries)))


def scale(df: DataFrame, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """Map each column's fitted range to [0, 1]; a constant column maps to 0.

    The ranges (one row per feature) enter as a scalar subquery. Values outside the fitted
    range leave [0, 1].
    """
    entry = F.struct(F.col("column"), F.struct("low", "high"))
    fitted = ranges.filter(F.col("column").isin(columns)).agg(
        F.map_from_entries(F.collect_list(entry)).alias("r")
    )
    ready = df.withColumn("_ranges", fitted.scalar())

    def scaled(c: str) -> Column:
        bounds = F.col("_ranges")[c]
        width = bounds.getField("high") - bounds.getField("low")
        part = F.try_divide(F.col(c) - bounds.getField("low"), width)
        return F.when(width == 0, F.col(c) - bounds.getField("low")).otherwise(part)

    return ready.withColumns({c: scaled(c) for c in columns}).drop("_ranges")


def ceil_binary(df: DataFrame, contract: Contract = KIDNEY) -> DataFrame:
    present = [r.name for r in contract.rules if r.ceiled and r.name in df.columns]
    return df.withColumns({c: F.ceil(c).cast("double") for c in present})


def fit_scale(
    df: DataFrame, features: str, keep: list[str] | None = None, contract: Contract = KIDNEY
) -> tuple[DataFrame, DataFrame]:
    """Scaled frame and the fitted ranges."""
    frame = project_features(df, features, keep, contract)
    ranges = fit_ranges(frame, scaled_columns(features, contract))
    return apply_scale(frame, ranges, features, keep, contract), ranges


def apply_scale(
    df: DataFrame, ranges: DataFrame, features: str, keep: list[str] | None = None, contract: Contract = KIDNEY
) -> DataFrame:
    """Scale new rows with fitted ranges."""
    frame = scale(project_features(df, features, keep, contract), ranges, scaled_columns(features, contract))
    return frame if features == "full" else ceil_binary(frame, contract)


def save_ranges(ranges: DataFrame, path: str) -> None:
    ranges.write.mode("overwrite").parquet(path)


def load_ranges(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise RuntimeError(f"no fitted ranges at {path!r}: fit and save them first") from error


def class_correlations(df: DataFrame, columns: list[str], target: str = k.TARGET_COLUMN) -> DataFrame:
    """Pearson correlation of each column with the target, from one aggregate."""
    measured = df.agg(*[F.corr(c, F.col(target).cast("double")).alias(c) for c in columns])
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("r"))
        for i, c in enumerate(columns)
    ]
    return measured.select(F.inline(F.array(*entries)))


def select_by_correlation(df: DataFrame, columns: list[str], target: str = k.TARGET_COLUMN) -> DataFrame:
    """Chosen features in order: strong positive, strong negative, then the fixed ones."""
    fixed = k.ALWAYS_SELECTED
    group = (
        F.when(F.col("r") >= k.POSITIVE_CORRELATION, 0)
        .when(F.col("r") <= k.NEGATIVE_CORRELATION, 1)
        .when(F.col("feature").isin(fixed), 2)
    )
    fixed_rank = F.when(F.col("feature") == fixed[0], 0).otherwise(1)
    chosen = class_correlations(df, columns, target).withColumn("grp", group).filter("grp is not null")
    place = F.when(F.col("grp") == 2, fixed_rank).otherwise(F.col("position"))
    # At most one row per feature of the contract.
    rank = F.row_number().over(Window.orderBy("grp", place))
    return chosen.select(rank.alias("rank"), "feature", "r")
