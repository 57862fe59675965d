"""Prompts, batches and request payloads."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.functions.numbers import number_text
from abstain_eval.operators.order import dense_positions

MESSAGES = "array<struct<role:string,content:string>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bullet_list(features) -> Column:
    """Lines ``- name: value`` sorted by name, from a map."""
    entries = F.array_sort(F.map_entries(_col(features)))
    lines = F.transform(
        entries,
        lambda e: F.concat(F.lit("- "), e.getField("key"), F.lit(": "), number_text(e.getField("value"))),
    )
    return F.array_join(lines, "\n")


def bullet_list_of(columns: list[str]) -> Column:
    """The same from plain columns; stays in generated code."""
    return F.concat_ws(
        "\n", *[F.concat(F.lit(f"- {c}: "), number_text(c)) for c in sorted(columns)]
    )


def marker_text(body: Column) -> Column:
    return F.concat(F.lit(k.MARKERS_HEADING + "\n"), body, F.lit("\n\n" + k.CLOSING_LINE))


def visit_text(months, baseline: Column, current: Column) -> Column:
    return F.concat(
        F.lit(k.VISIT_INTERVAL), _col(months).cast("string"), F.lit("\n\n"),
        F.lit(k.BASELINE_HEADING + "\n"), baseline,
        F.lit("\n\n" + k.CURRENT_HEADING + "\n"), current,
        F.lit("\n\n" + k.CLOSING_LINE),
    )


def user_text() -> Column:
    """The user turn of a record, by its task."""
    visits = visit_text("trajectory_months", bullet_list("baseline"), bullet_list("current"))
    return F.when(F.col("task") == "progression", visits).otherwise(marker_text(bullet_list("features")))


def system_text(task="task") -> Column:
    chain = None
    for name in k.TASKS:
        hit = _col(task) == name
        text = F.lit(k.SYSTEM_TEXT[name])
        chain = F.when(hit, text) if chain is None else chain.when(hit, text)
    return chain


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def with_messages(records: DataFrame) -> DataFrame:
    """System and user turn of every record."""
    return records.withColumn(
        "messages", F.array(message("system", system_text()), message("user", user_text()))
    )


def assign_batches(records: DataFrame, batch_size: int) -> DataFrame:
    """Batch number, place in the batch and the id the model sees."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    size = F.lit(batch_size)
    slot = F.pmod(F.col("row_idx"), size).cast("int")
    return records.withColumns(
        {
            "batch_id": F.floor(F.col("row_idx") / size).cast("bigint"),
            "slot": slot,
            "case_ref": F.concat(F.lit("case_"), slot.cast("string")),
        }
    )


def batch_user_text(blocks: Column) -> Column:
    return F.concat(
        F.lit(k.BATCH_OPENING + "\n\n"),
        F.array_join(blocks, k.CASE_SEPARATOR),
        F.lit("\n\n" + k.BATCH_CLOSING_LINE),
    )


def batch_messages(task, blocks: Column) -> Column:
    system = F.concat(system_text(task), F.lit("\n\n" + k.BATCH_RULES))
    return F.array(message("system", system), message("user", batch_user_text(blocks)))


def build_batches(batched: DataFrame, keys: tuple[str, ...] = ("run_id", "batch_id", "task")) -> DataFrame:
    """One request per batch. A group holds at most ``batch_size`` cases, whatever the run."""
    rendered = batched.select(
        *keys, "slot", "case_id",
        F.concat(F.lit("Case id: "), F.col("case_ref"), F.lit("\n"), user_text()).alias("block"),
    )
    grouped = rendered.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("slot", "case_id", "block"))).alias("rows")
    )
    return grouped.select(
        *keys,
        F.size("rows").alias("size"),
        F.col("rows.case_id").alias("case_ids"),
        F.lit("batch").alias("mode"),
        batch_messages("task", F.col("rows.block")).alias("messages"),
    )


def single_requests(records: DataFrame, keys: tuple[str, ...] = ("run_id", "batch_id", "task")) -> DataFrame:
    """One request per case, in the shape of a batch of one."""
    return records.transform(with_messages).select(
        *keys, F.lit(1).alias("size"), F.array("case_id").alias("case_ids"),
        F.lit("single").alias("mode"), "messages",
    )


def _nullable(schema: dict) -> dict:
    return {"anyOf": [schema, {"type": "null"}]}


def _answer_fields(task: str) -> dict:
    label = {"type": "string", "enum": k.PROGRESSION_LABELS} if task == "progression" else {"type": "integer"}
    return {
        "abstained": {"type": "boolean"},
        "confidence": _nullable({"type": "number"}),
        "prediction": _nullable(label),
    }


def _closed_object(properties: dict) -> dict:
    return {
        "type": "object",
        "additionalProperties": False,
        "properties": properties,
        "required": list(properties),
    }


def answer_schema(task: str, mode: str) -> dict:
    """Response format of one request."""
    fields = _answer_fields(task)
    if mode == "batch":
        item = _closed_object({"id": {"type": "string"}, **fields})
        schema = _closed_object({"results": {"type": "array", "items": item}})
        name = f"case_{task}_batch_answer"
    else:
        schema, name = _closed_object(fields), f"case_{task}_answer"
    return {"type": "json_schema", "json_schema": {"name": name, "strict": True, "schema": schema}}


def schema_text(task="task", mode="mode") -> Column:
    chain = None
    for t in k.TASKS:
        for m in ("single", "batch"):
            hit = (_col(task) == t) & (_col(mode) == m)
            text = F.lit(json.dumps(answer_schema(t, m)))
            chain = F.when(hit, text) if chain is None else chain.when(hit, text)
    return chain


def answer_schemas(spark: SparkSession) -> DataFrame:
    rows = [(t, m, json.dumps(answer_schema(t, m))) for t in k.TASKS for m in ("single", "batch")]
    return spark.createDataFrame(rows, "task string, mode string, answer_schema string")


def payloads(
    requests: DataFrame,
    model: str,
    temperature: float | None = None,
    max_tokens: int | None = None,
    reasoning_effort: str | None = None,
    exclude_reasoning: bool = True,
) -> DataFrame:
    """JSON body per request; settings left out are absent from the body."""
    reasoning = F.lit(None).cast("struct<reasoning:struct<effort:string,exclude:boolean>>")
    if reasoning_effort is not None:
        reasoning = F.struct(
            F.struct(
                F.lit(reasoning_effort).alias("effort"), F.lit(exclude_reasoning).alias("exclude")
            ).alias("reasoning")
        )
    head = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            F.col("messages"),
            F.lit(temperature).cast("double").alias("temperature"),
            (F.lit(max_tokens).cast("bigint") * F.col("size")).alias("max_tokens"),
            reasoning.alias("extra_body"),
        )
    )
    # The schema is JSON text already, so it is appended to the object's text.
    body = F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"response_format":'), schema_text(), F.lit("}"),
    )
    return requests.withColumn("body", body)


def redact(messages) -> Column:
    """Messages without patient data; the shape of the user turn picks the placeholder."""

    def cover(m: Column) -> Column:
        content = m.getField("content")
        covered = (
            F.when(m.getField("role") != "user", content)
            .when(content.startswith(k.BATCH_OPENING), F.lit(k.REDACTED_BATCH))
            .when(content.startswith(k.MARKERS_HEADING + "\n"), F.lit(k.REDACTED_MARKERS))
            .when(
                content.contains(k.BASELINE_HEADING) & content.contains(k.CURRENT_HEADING),
                F.lit(k.REDACTED_VISITS),
            )
            .otherwise(F.lit(k.REDACTED_OTHER))
        )
        return F.struct(m.getField("role").alias("role"), covered.alias("content"))

    return F.transform(_col(messages), cover)


def plain_prompt(messages) -> Column:
    """Messages as text blocks headed by their role, ending at the assistant's turn."""
    blocks = F.transform(
        _col(messages),
        lambda m: F.concat(F.upper(m.getField("role")), F.lit(":\n"), m.getField("content")),
    )
    return F.concat(F.array_join(blocks, "\n\n"), F.lit("\n\nASSISTANT:\n"))


def fold_system(messages) -> Column:
    """Put the system text in front of the first user turn, for models without that role."""
    messages = _col(messages)
    is_system = lambda m: m.getField("role") == "system"
    system = F.filter(messages, is_system)
    rest = F.filter(messages, lambda m: ~is_system(m))
    text = F.array_join(F.transform(system, lambda m: m.getField("content")), "\n\n")
    first = F.get(rest, F.lit(0))
    joined = message("user", F.concat(text, F.lit("\n\n"), first.getField("content")))
    behind = F.when(F.size(rest) > 1, F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 1, F.lit(1))))
    tail = F.coalesce(behind, F.array().cast(MESSAGES))
    opens_with_user = F.coalesce(first.getField("role") == "user", F.lit(False))
    return (
        F.when(F.size(system) == 0, rest)
        .when(opens_with_user, F.concat(F.array(joined), tail))
        .otherwise(F.concat(F.array(message("user", text)), rest))
    )


ANSWER_SCHEMA = (
    "run_id string, batch_id bigint, task string, mode string, raw_response string, "
    "finish_reason string, usage string, provider string"
)
CALL_SCHEMA = ANSWER_SCHEMA + ", status int, error_name string"


@dataclass(frozen=True)
class Pacing:
    """When calls go out: no more than ``per_second`` in all, and repeats after a growing pause.

    A repeat waits ``base_delay`` seconds, twice as long after each failure, ``max_delay`` at most.
    ``clock`` and ``wait`` run on the driver and in the tasks.
    """

    per_second: float | None = None
    base_delay: float = 1.0
    max_delay: float = 30.0
    clock: Callable[[], float] = time.time
    wait: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        if self.per_second is not None and self.per_second <= 0:
            raise ValueError("per_second must be positive")


def call_times(requests: DataFrame, start: float, per_second: float | None = None, group: str | None = None) -> DataFrame:
    """Add ``due_at``, the time in seconds at which each request may go out.

    Requests of one ``group`` (a provider, say; all, if none is given) are spaced evenly from
    ``start`` on in the order of their batches. A request with ``not_before`` isn't due before it.
    Times are given out once for all tasks, so the rate holds whatever their number.
    """
    earliest = F.coalesce(F.col("not_before"), F.lit(0.0)) if "not_before" in requests.columns else F.lit(0.0)
    if per_second is None:
        return requests.withColumn("due_at", F.greatest(F.lit(float(start)), earliest))
    grouped = requests.withColumn("_group", F.col(group) if group else F.lit(0))
    placed = dense_positions(grouped, "_group", "batch_id", ["run_id"], index="_place")
    spaced = F.lit(float(start)) + F.col("_place") / F.lit(float(per_second))
    return placed.withColumn("due_at", F.greatest(spaced, earliest)).drop("_group", "_place")


REPLY_COLUMNS = tuple(part.split()[0] for part in CALL_SCHEMA.split(", "))
REPLIES_AT_ONCE = 1000  # replies that a calling task hands on together


def each_request(reply: Callable) -> Callable[[Iterator], Iterator]:
    """An answering function out of a function of one request.

    ``reply`` gets a request as a named tuple and returns a dict of what came back (raw_response,
    finish_reason, usage, provider, status, error_name), or None if nothing did; it may raise.
    """
    columns = REPLY_COLUMNS

    def answer(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for request in frame.itertuples(index=False):
                if (found := reply(request)) is not None:
                    keys = {c: getattr(request, c) for c in ("run_id", "batch_id", "task", "mode")}
                    yield pd.DataFrame([keys | found], columns=columns, dtype=object)

    answer.reply = reply
    return answer


def guarded(answer: Callable[[Iterator], Iterator], pacing: Pacing | None = None) -> Callable[[Iterator], Iterator]:
    """``answer`` fed one request at a time; a call that raises becomes a row with its error.

    The function is started anew with the requests that follow, so one failing call costs
    neither the answers before it nor those after it. With ``pacing`` a request is handed out
    when it is due. Replies are gathered and handed on ``REPLIES_AT_ONCE`` at a time, since a frame
    for each costs more than many a call; for the same reason a function of ``each_request`` gets
    its requests without frames.
    """
    columns, most, reply = REPLY_COLUMNS, REPLIES_AT_ONCE, getattr(answer, "reply", None)
    keys = ("run_id", "batch_id", "task", "mode")

    def wait_for(due_at) -> None:
        if pacing and (pause := float(due_at) - pacing.clock()) > 0:
            pacing.wait(pause)

    def failure(request, error: Exception) -> tuple:
        status = getattr(error, "status_code", getattr(error, "status", None))
        found = {c: getattr(request, c) for c in keys} | {"status": status, "error_name": type(error).__name__}
        return tuple(found.get(c) for c in columns)

    def by_request(frames: Iterator) -> Iterator[list[tuple]]:
        for frame in frames:
            for request in frame.itertuples(index=False):
                if pacing:
                    wait_for(request.due_at)
                try:
                    found = reply(request)
                    if found is not None:
                        found = {c: getattr(request, c) for c in keys} | found
                        found = tuple(found.get(c) for c in columns)
                except Exception as error:
                    found = failure(request, error)
                if found is not None:
                    yield [found]

    def by_frame(frames: Iterator) -> Iterator[list[tuple]]:
        rows = (frame.iloc[i : i + 1] for frame in frames for i in range(len(frame)))
        open_rows = []

        def hand_out():
            for row in rows:
                open_rows[:] = [row]
                if pacing:
                    wait_for(row["due_at"].iloc[0])
                yield row

        while True:
            open_rows.clear()
            try:
                for found in answer(hand_out()):
                    none = [None] * len(found)
                    yield list(zip(*(found[c].tolist() if c in found.columns else none for c in columns), strict=True))
                return
            except Exception as error:
                if not open_rows:
                    raise
                yield [failure(next(open_rows[0].itertuples(index=False)), error)]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        held = []
        for some in by_frame(frames) if reply is None else by_request(frames):
            held += some
            if len(held) >= most:
                yield pd.DataFrame(held, columns=columns, dtype=object)
                held = []
        if held:
            yield pd.DataFrame(held, columns=columns, dtype=object)

    return run


def answer_requests(
    requests: DataFrame, answer: Callable[[Iterator], Iterator], max_concurrency: int = 8, pacing: Pacing | None = None
) -> DataFrame:
    """Run a user's answering function over the request table, at most so many calls at a time.

    ``answer`` maps an iterator of pandas frames to frames with the columns of ANSWER_SCHEMA, and
    may add status and error_name. The number of partitions is set outright: prompts are small,
    and adaptive execution would put all calls in one task. With ``pacing`` requests have ``due_at``.
    """
    if max_concurrency < 1:
        raise ValueError("max_concurrency must be at least 1")
    spread = requests.repartition(max_concurrency, "run_id", "batch_id")
    if pacing:
        spread = spread.sortWithinPartitions("due_at")
    return spread.mapInPandas(guarded(answer, pacing), CALL_SCHEMA)
