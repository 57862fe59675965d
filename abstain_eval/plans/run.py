"""A whole evaluation: records to answers, scores, summary, findings, report and documents."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abstain_eval.operators import metrics, runs, validate
from abstain_eval.plans.evaluate import Evaluated, run_rounds
from abstain_eval.session import cut_lineage
from abstain_eval.sources import documents
from abstain_eval.sources.ledger import CallLedger


@dataclass
class RunResult:
    evaluated: Evaluated
    evaluations: DataFrame
    scores: DataFrame
    summary: DataFrame
    findings: DataFrame
    report: DataFrame
    pieces: DataFrame


def evaluate_runs(
    records: DataFrame,
    answer: Callable[[Iterator], Iterator],
    models: DataFrame,
    suite: DataFrame,
    batch_size: int = 8,
    max_concurrency: int = 8,
    on_malformed: str = "error",
    ledger: CallLedger | None = None,
) -> RunResult:
    """Run all of ``models`` (run_id, model, suite as JSON text); ``suite`` has (run_id, name, text).

    Runs without a single evaluation, and evaluations of runs that are not listed, are findings.
    Scores, summary and evaluations are written once and feed the report and the documents.
    """
    started = time.monotonic()
    done = run_rounds(records, answer, batch_size, on_malformed, max_concurrency, ledger=ledger)
    evaluations = cut_lineage(done.evaluations)
    elapsed = time.monotonic() - started
    table = cut_lineage(
        models.withColumns(
            {"batch_size": F.lit(batch_size), "max_concurrency": F.lit(max_concurrency), "elapsed_seconds": F.lit(elapsed)}
        )
    )
    scores = cut_lineage(metrics.score_runs(evaluations))
    summary = cut_lineage(runs.execution_summary(evaluations, table, records))
    empty = validate.empty_runs(table, evaluations).withColumn("n", F.lit(0).cast("bigint"))
    findings = runs.run_findings(evaluations, table).unionByName(empty)
    report = runs.report_lines(scores, summary, suite, table)
    pieces = documents.full_documents(scores, summary, table, evaluations, runs.prompt_templates(evaluations))
    return RunResult(done, evaluations, scores, summary, findings, report, pieces)
