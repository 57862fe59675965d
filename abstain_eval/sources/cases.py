"""Reading raw case tables."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.contracts import CSV_MISSING_TOKENS


def read_cases(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Read a CSV (or parquet) case table with every column as text."""
    try:
        if fmt == "csv":
            raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
        else:
            raw = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no case table at {path!r}; pass the path of a local copy") from error
        raise
    cells = []
    for name in raw.columns:
        cell = F.col(f"`{name}`").cast("string")
        cells.append(F.when(~cell.isin(CSV_MISSING_TOKENS), cell).alias(name))
    return raw.select(*cells)


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names as written in the file's first line, repeated names kept."""
    line = spark.read.text(path).first()
    if line is None:
        return []
    return next(csv.reader([line[0]]), [])
