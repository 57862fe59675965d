"""Run-level summaries: execution, prompts, repeats, outcome counts, best models, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.functions.numbers import finite_or_null, ratio
from abstain_eval.operators.metrics import label_hit


def execution_summary(evaluations: DataFrame, runs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One row per run: rows, planned batches, speed, tokens and prompt counts.

    ``runs`` has run_id, batch_size, max_concurrency, elapsed_seconds and one row per run.
    Input rows are those of ``records``, where given, so that rows in quarantine count as well.
    A run on one side only keeps its row; ``run_findings`` names it. Prompts are counted per
    (mode, text) first, so equal prompts meet once per task.
    """
    has_prompt = F.coalesce(F.size("prompt") > 0, F.lit(False))
    per_prompt = evaluations.groupBy(
        "run_id", F.col("prompt_mode"), F.when(has_prompt, F.to_json("prompt")).alias("p")
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")],
    )
    per_run = per_prompt.groupBy("run_id").agg(
        F.sum("rows").alias("n_evaluated"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.sum("total_tokens").alias("token_total"),
        F.coalesce(F.sum(F.when(F.col("p").isNotNull(), F.col("rows"))), F.lit(0)).alias("n_prompts_captured"),
        F.count("p").alias("prompt_templates_count"),
        F.array_join(
            F.array_sort(F.collect_set(F.when(F.col("prompt_mode") != "", F.col("prompt_mode")))), ","
        ).alias("prompt_modes"),
    )
    # Summaries hold one row per run on both sides.
    known = runs.select("run_id", "batch_size", "max_concurrency", "elapsed_seconds")
    joined = known.join(per_run, "run_id", "full")
    if records is None:
        joined = joined.withColumn("n_input_records", F.coalesce("n_evaluated", F.lit(0)))
    else:
        sent = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_sent"))
        joined = joined.join(sent, "run_id", "full").withColumn("n_input_records", F.coalesce("n_sent", F.lit(0)))
    zero = dict.fromkeys(("n_prompts_captured", "prompt_templates_count"), 0)
    joined = joined.fillna(zero).fillna("", ["prompt_modes"])
    batches = F.ceil(F.col("n_input_records") / F.col("batch_size")).cast("bigint")
    speed = F.when(F.col("elapsed_seconds") > 0, ratio("n_input_records", "elapsed_seconds"))
    return joined.select(
        "run_id", "batch_size", "max_concurrency", "n_input_records",
        batches.alias("n_api_batches"), "elapsed_seconds", speed.alias("records_per_second"),
        "input_tokens", "output_tokens", "token_total", "prompt_modes",
        "n_prompts_captured", "prompt_templates_count",
        F.lit(k.PROMPT_CAPTURE).alias("prompt_capture"),
        F.lit(k.PROMPT_POLICY).alias("prompt_data_policy"),
    )


def run_findings(evaluations: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs of the run table without evaluations, and evaluated runs that it does not list."""
    seen = evaluations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    listed = runs.select("run_id", F.lit(True).alias("listed"))
    check = F.when(F.col("n").isNull(), "run_without_rows").when(F.col("listed").isNull(), "rows_without_run")
    both = listed.join(seen, "run_id", "full").withColumn("check", check).filter("check is not null")
    return both.select("check", F.lit("run_id").alias("column"), F.col("run_id").alias("detail"), F.coalesce("n", F.lit(0)).alias("n"))


def prompt_templates(evaluations: DataFrame) -> DataFrame:
    """Distinct redacted prompts of each run; ``first_row`` gives the order of appearance."""
    shown = evaluations.filter(F.size("prompt") > 0)
    mode = F.when(F.coalesce(F.col("prompt_mode"), F.lit("")) == "", "unknown").otherwise(F.col("prompt_mode"))
    return shown.groupBy(
        "run_id", F.coalesce(F.col("prompt_mode"), F.lit("")).alias("raw_mode"), F.to_json("prompt").alias("prompt")
    ).agg(F.min("row_idx").alias("first_row"), F.count(F.lit(1)).alias("rows"), F.min(mode).alias("prompt_mode")).drop(
        "raw_mode"
    )


def repeat_statistics(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over repeats. Scores carry model and task."""
    return scores.groupBy("model", "task", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("repeats")
    )


OUTCOMES = ["answered", "abstained", "answered_correct", "answered_incorrect", "overall_incorrect"]


def outcome_counts(evaluations: DataFrame) -> DataFrame:
    """Counts of outcomes per run; an abstention is also overall incorrect."""
    answered, hit = ~F.col("abstained"), label_hit()
    return evaluations.groupBy("run_id", "model", "task").agg(
        F.count_if(answered).alias("answered"),
        F.count_if("abstained").alias("abstained"),
        F.count_if(answered & hit).alias("answered_correct"),
        F.count_if(answered & ~hit).alias("answered_incorrect"),
        F.count_if(~(answered & hit)).alias("overall_incorrect"),
    )


def outcome_statistics(evaluations: DataFrame) -> DataFrame:
    """Mean and deviation of the outcome counts over the runs of a model and task."""
    counts = outcome_counts(evaluations)
    entries = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in OUTCOMES]
    return repeat_statistics(counts.select("model", "task", F.inline(F.array(*entries))))


def best_models(statistics: DataFrame) -> DataFrame:
    """Best mean per task and metric, lower or higher as the metric asks; ties by model name."""
    lower = F.col("metric").isin(k.LOWER_IS_BETTER + ["elapsed_seconds", "token_total"])
    signed = F.when(lower, F.col("mean")).otherwise(-F.col("mean"))
    best = F.min(F.struct(signed.alias("s"), F.col("model"), F.col("mean"), F.col("std"))).alias("b")
    return (
        statistics.filter(F.col("mean").isNotNull())
        .groupBy("task", "metric").agg(best)
        .select("task", "metric", "b.model", "b.mean", "b.std")
    )


def metric_label(name) -> Column:
    """Display name, or the key in title case."""
    name = F.col(name) if isinstance(name, str) else name
    chain = None
    for key, label in k.METRIC_NAMES.items():
        chain = F.when(name == key, label) if chain is None else chain.when(name == key, label)
    return chain.otherwise(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


def metric_key(name) -> Column:
    """Key of a display name; other names are lower-cased with underscores."""
    name = F.col(name) if isinstance(name, str) else name
    chain = None
    for key, label in k.METRIC_NAMES.items():
        chain = F.when(name == label, key) if chain is None else chain.when(name == label, key)
    return chain.otherwise(F.lower(F.replace(name, F.lit(" "), F.lit("_"))))


CHARTED = {
    "deferral_alignment": "Deferral Alignment",
    "expected_calibration_error": "Calibration Quality",
    "selective_accuracy": "Selective Accuracy",
}


def chart_series(scores: DataFrame) -> DataFrame:
    """Percent mean and deviation of the three charted measures per task and model."""
    charted = scores.filter(F.col("metric").isin(list(CHARTED)))
    percent = F.col("value") * 100.0
    quality = F.when(F.col("metric") == "expected_calibration_error", 100.0 - percent).otherwise(percent)
    per_metric = repeat_statistics(charted.withColumn("value", quality))
    wide = [
        F.max(F.when(F.col("metric") == key, F.col(part))).alias(f"{series_name(label)}_{part}")
        for key, label in CHARTED.items()
        for part in ("mean", "std")
    ]
    return per_metric.groupBy("task", "model").agg(*wide)


def series_name(label: str) -> str:
    return label.lower().replace(" ", "_")


def call_counts(requests: DataFrame) -> DataFrame:
    """Calls made per run: all, first batches, split batches and single fallbacks."""
    again = F.col("round") > 0
    per_call = requests.select("run_id", "round", "batch_id", "mode").distinct()
    return per_call.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~again).alias("planned_calls"),
        F.count_if(again & (F.col("mode") == "batch")).alias("split_calls"),
        F.count_if(again & (F.col("mode") == "single")).alias("single_calls"),
        F.max("round").alias("last_round"),
    )


def report_lines(
    scores: DataFrame, summary: DataFrame, suite: DataFrame, runs: DataFrame
) -> DataFrame:
    """Text report as rows (run_id, section, ord, line); order by section and ord.

    ``suite`` has (run_id, name, text), ``runs`` (run_id, model). Numbers show four
    decimals, undefined metrics show nan.
    """
    parts = [
        ("input_tokens", "%.4f"), ("max_concurrency", "%d"), ("batch_size", "%d"),
        ("elapsed_seconds", "%.4f"), ("n_api_batches", "%d"), ("n_input_records", "%d"),
        ("n_prompts_captured", "%d"), ("output_tokens", "%.4f"), ("prompt_capture", "%s"),
        ("prompt_data_policy", "%s"), ("prompt_modes", "%s"), ("prompt_templates_count", "%d"),
        ("records_per_second", "%.4f"), ("token_total", "%.4f"),
    ]

    def line(text: Column) -> Column:
        return F.concat(F.lit("  "), text)

    def section(df: DataFrame, number: int, name: Column, text: Column) -> DataFrame:
        return df.select("run_id", F.lit(number).alias("section"), name.alias("ord"), text.alias("line"))

    def heading(number: int, title: str) -> DataFrame:
        rows = F.array(
            F.struct(F.lit("").alias("o"), F.lit("").alias("t")),
            F.struct(F.lit(" 1").alias("o"), F.lit(title).alias("t")),
            F.struct(F.lit(" 2").alias("o"), F.lit("-" * len(title)).alias("t")),
        )
        opened = runs.select("run_id", F.inline(rows))
        return section(opened, number, F.col("o"), F.col("t"))

    title = F.array(
        F.struct(F.lit("1").alias("o"), F.lit("Evaluation report").alias("t")),
        F.struct(F.lit("2").alias("o"), F.lit("=================").alias("t")),
        F.struct(
            F.lit("3").alias("o"),
            F.concat(F.lit("Backend: "), F.coalesce(F.nullif("model", F.lit("")), F.lit("(unknown)"))).alias("t"),
        ),
    )
    value = F.when(F.col("value").isNull(), F.lit("nan")).otherwise(F.format_string("%.4f", "value"))
    counts = F.format_string(" (n_evaluated=%d, n_abstained=%d)", "n_evaluated", "n_abstained")
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("o"),
                F.coalesce(F.when(F.col(name).isNotNull(), F.format_string(form, name)), F.lit("None")).alias("t"),
            )
            for name, form in parts
        ],
        F.struct(
            F.lit("prompt_templates").alias("o"),
            F.format_string("%d redacted template(s)", "prompt_templates_count").alias("t"),
        ),
    )
    return (
        section(runs.select("run_id", F.inline(title)), 0, F.col("o"), F.col("t"))
        .unionByName(heading(1, "Suite"))
        .unionByName(section(suite, 1, F.col("name"), line(F.concat(F.col("name"), F.lit(": "), F.col("text")))))
        .unionByName(heading(2, "Metrics"))
        .unionByName(
            section(
                scores.withColumn("value", finite_or_null("value")), 2, F.col("metric"),
                line(F.concat(metric_label("metric"), F.lit(": "), value, counts)),
            )
        )
        .unionByName(heading(3, "Execution"))
        .unionByName(
            section(
                summary.select("run_id", F.inline(entries)), 3, F.col("o"),
                line(F.concat(F.col("o"), F.lit(": "), F.col("t"))),
            )
        )
        .unionByName(
            section(
                summary.select(
                    "run_id",
                    F.inline(
                        F.array(
                            F.struct(F.lit("1").alias("o"), F.lit("").alias("t")),
                            F.struct(
                                F.lit("2").alias("o"),
                                F.format_string("Total patient rows: %d", "n_input_records").alias("t"),
                            ),
                        )
                    ),
                ),
                4, F.col("o"), F.col("t"),
            )
        )
    )
