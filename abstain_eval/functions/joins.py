"""Joining a large table with a fitted one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abstain_eval.session import cut_lineage

BROADCAST_ROWS = 10_000


def sized_side(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a fitted table; broadcast it only when it is counted to be small.

    A larger one is joined by shuffle, where AQE splits skewed keys.
    """
    fitted = cut_lineage(small)
    is_small = fitted.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(fitted) if is_small else fitted
