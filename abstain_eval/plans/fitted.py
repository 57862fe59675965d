"""The preparation of rows with stored parameters: codes, imputation chain and ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from abstain_eval import contracts as k
from abstain_eval.operators import encode, impute

COLUMNS = [*k.NOMINAL_COLUMNS, *k.NUMERIC_FEATURES, k.TARGET_COLUMN]


@dataclass
class FittedPreparation:
    """Fit once on an encoded frame, then use on new rows: impute, round, select, scale, ceil."""

    features: str = "reduced"
    imputation: impute.FittedImputation | None = None
    ranges: DataFrame | None = None

    def fit(self, frame: DataFrame, estimator="gbt", rounds: int = 10) -> FittedPreparation:
        self.imputation, done = impute.fit_imputation(frame, COLUMNS, estimator, rounds)
        selected = encode.project_features(encode.round_target(done), self.features, [k.ID_COLUMN])
        self.ranges = encode.fit_ranges(selected, encode.scaled_columns(self.features))
        return self

    def transform(self, frame: DataFrame) -> DataFrame:
        """Scaled features of new rows of an encoded frame."""
        if self.imputation is None or self.ranges is None:
            raise RuntimeError("this preparation is not fitted: call fit or load first")
        done = encode.round_target(self.imputation.transform(frame))
        return encode.apply_scale(done, self.ranges, self.features, [k.ID_COLUMN])

    def save(self, spark: SparkSession, path: str) -> None:
        if self.imputation is None or self.ranges is None:
            raise RuntimeError("this preparation is not fitted: call fit or load first")
        self.imputation.save(spark, f"{path}/imputation")
        encode.save_ranges(self.ranges, f"{path}/ranges-{self.features}")

    @staticmethod
    def load(spark: SparkSession, path: str, features: str = "reduced") -> FittedPreparation:
        try:
            chain = impute.FittedImputation.load(spark, f"{path}/imputation")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise RuntimeError(f"no fitted preparation at {path!r}: fit and save one first") from error
        return FittedPreparation(features, chain, encode.load_ranges(spark, f"{path}/ranges-{features}"))
