"""From records to evaluation rows: requests, answers, and further rounds for bad batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abstain_eval.operators import answers, order, requests
from abstain_eval.session import cut_lineage
from abstain_eval.sources.ledger import CallLedger

CASE_KEYS = ("run_id", "batch_id", "task", "round", "attempt")
ROW = [
    "run_id", "batch_id", "slot", "prediction", "abstained", "confidence", "raw_response",
    "input_tokens", "output_tokens", "total_tokens",
]
SENT = "run_id string, batch_id bigint, mode string, size int, round int"
REJECTED = "run_id string, batch_id bigint, size int, reason string, missing_ids array<string>"
ANSWERED = (
    "run_id string, prediction string, abstained boolean, confidence double, raw_response string, input_tokens double, "
    f"output_tokens double, total_tokens double, case_id bigint, prompt {requests.MESSAGES}, prompt_mode string"
)


@dataclass
class Evaluated:
    """``open`` holds the keys of records that wait for rounds after ``pause_after``."""

    evaluations: DataFrame
    quarantine: DataFrame
    requests: DataFrame
    open: DataFrame


def plan_requests(cases: DataFrame) -> DataFrame:
    batch = requests.build_batches(cases.filter("mode = 'batch'"), CASE_KEYS)
    single = requests.single_requests(cases.filter("mode = 'single'"), CASE_KEYS)
    return batch.unionByName(single)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _refuse_repeats(replies: DataFrame) -> None:
    twice = replies.groupBy("run_id", "batch_id").count().filter("count > 1").take(1)
    if twice:
        raise ValueError(f"more than one reply to request {twice[0]['batch_id']} of run {twice[0]['run_id']}")


def ask(
    sent: DataFrame,
    answer: Callable[[Iterator], Iterator],
    max_concurrency: int,
    max_retries: int,
    ledger: CallLedger | None = None,
    job: str = "",
    pacing: requests.Pacing | None = None,
) -> DataFrame:
    """Every request of ``sent`` with its reply and ``outcome``: answered, no_reply, retry or call_failed.

    What ``ledger`` has on record is not asked again. With ``pacing`` calls go out when they are
    due, and ``next_delay`` says how long a repeat has to wait.
    """
    delays = (pacing.base_delay, pacing.max_delay) if pacing else (0.0, 0.0)

    def call(some: DataFrame) -> DataFrame:
        timed = requests.call_times(some, pacing.clock(), pacing.per_second) if pacing else some
        replies = cut_lineage(requests.answer_requests(timed, answer, max_concurrency, pacing))
        _refuse_repeats(replies)
        return replies

    calls = ledger.calls(sent, call, job) if ledger else call(sent)
    calls = calls.drop("task", "mode").withColumn("_replied", F.lit(True))
    facts = sent.select("run_id", "batch_id", "task", "mode", "size", "round", "attempt")
    judged = answers.classify_errors(facts.join(calls, ["run_id", "batch_id"], "left"), max_retries, *delays)
    failed = F.col("error_name").isNotNull() | F.coalesce(F.col("status") >= 400, F.lit(False))
    outcome = (
        F.when(F.col("_replied").isNull(), "no_reply")
        .when(failed & F.col("will_retry"), "retry")
        .when(failed, "call_failed")
        .otherwise("answered")
    )
    # Replies are small and slow to read: adaptive execution would put them in one task.
    tasks = 2 * sent.sparkSession.sparkContext.defaultParallelism
    told = judged.withColumn("outcome", outcome).drop("_replied", "retryable", "will_retry")
    return cut_lineage(told.repartition(tasks, "run_id", "batch_id"))


def run_rounds(
    records: DataFrame,
    answer: Callable[[Iterator], Iterator],
    batch_size: int = 8,
    on_malformed: str = "error",
    max_concurrency: int = 8,
    max_retries: int = 2,
    ledger: CallLedger | None = None,
    pause_after: int | None = None,
    pacing: requests.Pacing | None = None,
) -> Evaluated:
    """Ask, read, and ask rejected batches again in halves, down to single cases.

    Every record ends as one evaluation or as one row of quarantine with a reason; records
    without run_id or case_id, and all that share both, are quarantined before the first call.
    Batches are cut by the records' place in their run, so ``row_idx`` may have gaps. A failed
    call that is worth it is repeated up to ``max_retries`` times; a request without a reply is
    treated as a rejected one.

    With a ``ledger`` every call is on record once it is answered: a job that is started again
    with the same records and ledger asks only what is not. ``pause_after`` ends the job after so
    many rounds. With ``pacing`` calls keep to a rate, and a repeated call waits for its time.

    Requests and replies of a round are written to the shared folder once: they feed several
    tables, and a lost executor must not ask a model twice. Rounds go on until nothing is open;
    sizes halve, so that is after log2(batch_size) + 3 rounds and the retries.
    """
    spark, job = records.sparkSession, uuid.uuid4().hex
    records, refused = answers.refuse_bad_keys(records)
    placed_records = order.dense_positions(records, "run_id", "row_idx", ["case_id"])
    batched = requests.assign_batches(placed_records.withColumn("row_idx", F.col("position")).drop("position"), batch_size)
    one_batch = Window.partitionBy("run_id", "batch_id")
    first = batched.withColumn("size", F.count(F.lit(1)).over(one_batch).cast("int"))
    current = cut_lineage(first.withColumns({"round": F.lit(0), "mode": F.lit("batch"), "attempt": F.lit(0), "not_before": F.lit(0.0)}))
    rows, quarantined, asked = [], [refused], []
    while pause_after is None or len(asked) < pause_after:
        # At most two values.
        modes = {r["mode"] for r in current.select("mode").distinct().collect()}
        if not modes:
            break
        sent = cut_lineage(plan_requests(current))
        asked.append(sent.select("run_id", "batch_id", "mode", "size", "round"))
        waits = current.select("run_id", "batch_id", "not_before").distinct()
        timed = sent.join(waits, ["run_id", "batch_id"]) if pacing else sent
        replies = ask(timed, answer, max_concurrency, max_retries, ledger, job, pacing)
        failed_at = pacing.clock() if pacing else 0.0
        answered = replies.filter("outcome = 'answered'").drop("outcome", "status", "error_name", "attempt", "next_delay")
        tokens = answers.with_usage(answered).drop("usage", "provider", "finish_reason")
        places = current.select("run_id", "batch_id", "slot", "case_id")

        def lost(found: DataFrame, reason: Column) -> DataFrame:
            """Quarantine rows of all cases of some requests."""
            named = found.select("run_id", "batch_id", reason.alias("reason"), "raw_response")
            return named.join(places.drop("slot"), ["run_id", "batch_id"]).drop("batch_id")  # noqa: B023

        why = F.concat_ws(":", F.lit("call_failed"), F.coalesce("error_name", F.col("status").cast("string")))
        quarantined.append(lost(replies.filter("outcome = 'call_failed'"), why))
        got, rejected = [], replies.filter("mode = 'batch' and outcome = 'no_reply'").select(
            "run_id", "batch_id", "size", F.lit("no_reply").alias("reason"), F.array().cast("array<string>").alias("missing_ids")
        )
        if "batch" in modes:
            # Read once: the sound rows and the plan of the next round both need it.
            batches = cut_lineage(answers.read_batches(tokens.filter("mode = 'batch'")))
            got.append(answers.spread_usage(answers.item_rows(batches)).select(*ROW))
            rejected = rejected.unionByName(answers.refused_batches(batches))
        if "single" in modes:
            alone = answers.parse_answers(tokens.filter("mode = 'single'"))
            kept, bad = answers.apply_malformed_policy(alone, on_malformed)
            got.append(kept.withColumn("slot", F.lit(0)).select(*ROW))
            quarantined.append(lost(bad, F.col("malformed")))
            quarantined.append(lost(replies.filter("mode = 'single' and outcome = 'no_reply'"), F.lit("no_reply")))
        placed = _union(got).join(places, ["run_id", "batch_id", "slot"])
        rows.append(answers.attach_prompts(placed, sent).drop("batch_id", "slot"))
        plan = answers.next_round(
            current.select("run_id", "batch_id", "slot", "round", "mode", "case_id"), rejected
        ).withColumns({"attempt": F.lit(0), "not_before": F.lit(0.0)})
        repeated = replies.filter("outcome = 'retry'").select(
            "run_id", "batch_id", (F.col("attempt") + 1).alias("attempt"), (F.lit(failed_at) + F.col("next_delay")).alias("not_before")
        )
        same = current.drop("attempt", "not_before").join(repeated, ["run_id", "batch_id"]).select(
            "run_id", "case_id", (F.col("batch_id") * 2).alias("batch_id"), "slot", "size",
            (F.col("round") + 1).cast("int").alias("round"), "mode", "attempt", "not_before",
        )
        kept_facts = current.drop("batch_id", "slot", "size", "round", "mode", "attempt", "not_before", "case_ref")
        again = kept_facts.join(plan.unionByName(same), ["run_id", "case_id"])
        current = cut_lineage(
            again.withColumn("case_ref", F.concat(F.lit("case_"), F.col("slot").cast("string")))
        )
    if not rows and not refused.take(1):
        raise ValueError("there are no records to evaluate")
    answered = _union(rows) if rows else spark.createDataFrame([], ANSWERED)
    sent_rows = _union(asked) if asked else spark.createDataFrame([], SENT)
    evaluations = answers.evaluation_rows(answered, records)
    return Evaluated(evaluations, _union(quarantined), sent_rows, current.select("run_id", "case_id"))
