"""Adding columns whose expressions must be evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns as output of a one-row generator.

    A filter on a plain column is pushed below the projection and repeats its expression;
    with a parser in it the work multiplies at every step. Generator output stays put.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))
