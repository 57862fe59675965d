"""The scoring job: evaluation rows of many runs to scores and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from abstain_eval.operators import metrics, runs


@dataclass
class Scored:
    scores: DataFrame
    summary: DataFrame


def score(evaluations: DataFrame, run_table: DataFrame) -> Scored:
    return Scored(metrics.score_runs(evaluations), runs.execution_summary(evaluations, run_table))
