"""Run documents: saved metric files in, JSON documents and request files out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.functions.joins import sized_side
from abstain_eval.functions.numbers import finite_or_null
from abstain_eval.functions.text import json_string
from abstain_eval.operators.requests import MESSAGES
from abstain_eval.operators.runs import metric_key
from abstain_eval.session import cut_lineage

SCORE = (
    "struct<name:string,value:double,breakdown:map<string,double>,n_evaluated:bigint,"
    "n_abstained:bigint,details:variant>"
)
EXECUTION = (
    "struct<batch_size:int,max_concurrency:int,n_input_records:bigint,n_api_batches:bigint,"
    "elapsed_seconds:double,records_per_second:double,input_tokens:double,output_tokens:double,"
    "token_total:double,prompt_modes:array<string>,n_prompts_captured:bigint,"
    "prompt_templates_count:bigint,prompt_capture:string,prompt_data_policy:string>"
)
DOCUMENT = f"execution {EXECUTION}, metrics map<string,{SCORE}>"
PATH_PARTS = r"([^/]+)/([^/]+?)(?:_([0-9]+))?\.json$"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Saved metric documents, one row each; task, model and repeat come from the path."""
    read = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", True)
    documents = read.json(path).withColumn("path", F.input_file_name())
    task = F.regexp_extract("path", PATH_PARTS, 1)
    stem = F.regexp_extract("path", PATH_PARTS, 2)
    repeat = F.regexp_extract("path", PATH_PARTS, 3).try_cast("int")
    return documents.select(
        F.concat_ws("/", task, F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("run_id"),
        task.alias("task"),
        F.regexp_replace(stem, F.concat(F.lit("_"), task, F.lit("$")), F.lit("")).alias("model"),
        F.coalesce(repeat, F.lit(1)).alias("repeat"),
        "execution", "metrics",
    )


def document_scores(documents: DataFrame) -> DataFrame:
    """Metric rows of saved documents; display-name keys and plain keys become plain keys."""
    opened = documents.select(
        "run_id", "task", "model", "repeat", F.explode("metrics").alias("key", "score")
    )
    return opened.select(
        "run_id", "task", "model", "repeat", metric_key("key").alias("metric"),
        "score.value", "score.breakdown", "score.n_evaluated", "score.n_abstained",
        F.try_variant_get("score.details", "$.reason", "string").alias("reason"),
        F.to_json("score.details").alias("details"),
    )


def document_execution(documents: DataFrame) -> DataFrame:
    return documents.select("run_id", "task", "model", "repeat", "execution.*")


def json_safe_map(values) -> Column:
    """Map with text keys; NaN and infinite values become null."""
    values = F.col(values) if isinstance(values, str) else values
    texts = F.transform_keys(values, lambda key, _: key.cast("string"))
    return F.transform_values(texts, lambda _, v: finite_or_null(v))


_KEEP_NULLS = {"ignoreNullFields": "false"}


def _score_json() -> Column:
    """One metric as JSON text; ``details`` is JSON text already."""
    head = F.to_json(
        F.struct(
            F.col("metric").alias("name"),
            finite_or_null("value").alias("value"),
            json_safe_map("breakdown").alias("breakdown"),
            "n_evaluated", "n_abstained",
        ),
        _KEEP_NULLS,
    )
    reason = F.when(F.col("reason").isNotNull(), F.to_json(F.struct("reason")))
    details = F.coalesce(reason, F.col("details"), F.lit("{}"))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"details":'), details, F.lit("}"))


def _metrics_json(scores: DataFrame) -> DataFrame:
    """The metrics object of every run; a run has a handful of metrics."""
    entry = F.concat(json_string(F.col("metric")), F.lit(":"), _score_json())
    return scores.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("metric", entry.alias("text")))).alias("m")
    ).select(
        "run_id",
        F.concat(F.lit("{"), F.array_join(F.col("m.text"), ","), F.lit("}")).alias("metrics_json"),
    )


def _execution_json(summary: DataFrame) -> DataFrame:
    fields = [F.col(c) for c in sorted(summary.columns) if c not in ("run_id", "prompt_modes")]
    modes = F.split("prompt_modes", ",").alias("prompt_modes")
    return summary.select("run_id", F.to_json(F.struct(*fields, modes), _KEEP_NULLS).alias("execution_json"))


def metric_documents(scores: DataFrame, summary: DataFrame) -> DataFrame:
    """Compact document per run with metrics and execution only; a run on one side has the other empty."""
    joined = _metrics_json(scores).join(_execution_json(summary), "run_id", "full").filter("run_id is not null")
    execution, metrics = (F.coalesce(c, F.lit("{}")) for c in ("execution_json", "metrics_json"))
    return joined.select(
        "run_id", F.concat(F.lit('{"execution":'), execution, F.lit(',"metrics":'), metrics, F.lit("}")).alias("document")
    )


ROW_FIELDS = [
    "case_id", "task", "ckd_stage", "ground_truth", "prediction", "abstained", "confidence",
    "should_abstain", "raw_response", "prompt", "prompt_mode", "input_tokens", "output_tokens",
    "total_tokens",
]


def _listed(df: DataFrame, section: int, position: str, text: Column) -> DataFrame:
    """Pieces of a JSON list: every entry but a run's first starts with a comma.

    Positions may repeat or be null (these come last), so the texts are written with an id of
    their own, and the first entry is one id. A run may hold most rows: its one-row side is
    broadcast when the runs are few.
    """
    place = F.coalesce(F.col(position).cast("bigint") * 2 + 1, F.lit(2**62))
    held = cut_lineage(
        df.filter("run_id is not null")
        .select("run_id", place.alias("ord"), text.alias("text"), F.monotonically_increasing_id().alias("_id"))
    )
    first = sized_side(held.groupBy("run_id").agg(F.min(F.struct("ord", "_id")).alias("_first")))
    opens = (F.col("ord") == F.col("_first.ord")) & (F.col("_id") == F.col("_first._id"))
    return held.join(first, "run_id").select(
        "run_id", F.lit(section).alias("section"), F.when(opens, F.col("ord") - 1).otherwise(F.col("ord")).alias("ord"),
        F.concat(F.when(opens, F.lit("")).otherwise(F.lit(",")), "text").alias("text"),
    )


def full_documents(
    scores: DataFrame,
    summary: DataFrame,
    runs: DataFrame,
    evaluations: DataFrame | None = None,
    templates: DataFrame | None = None,
) -> DataFrame:
    """Full document per run as ordered pieces (run_id, section, ord, text).

    A run can hold any number of rows, so its document is never put together in one task:
    the pieces of a run joined in (section, ord) order are one JSON document. ``runs`` has
    run_id, model and suite (a JSON object as text); ``templates`` are the distinct prompts. Every
    run that any of these tables names has a document; what a table lacks of it is empty.
    """
    if evaluations is None:
        sizes = scores.groupBy("run_id").agg(F.max("n_evaluated").alias("_listed"))
    else:
        sizes = evaluations.groupBy("run_id").agg(F.count(F.lit(1)).alias("_listed"))
    joined = (
        runs.select("run_id", "model", "suite").join(_metrics_json(scores), "run_id", "full")
        .join(_execution_json(summary), "run_id", "full").join(sizes, "run_id", "full").filter("run_id is not null")
        .fillna({"model": "", "suite": "{}", "metrics_json": "{}", "execution_json": "{}"}).fillna({"_listed": 0})
    )
    extras = F.col("execution_json")
    open_extras = F.concat(
        F.substring(extras, F.lit(1), F.length(extras) - 1),
        F.when(extras == "{}", F.lit('"prompt_templates":[')).otherwise(F.lit(',"prompt_templates":[')),
    )
    with_rows, with_templates = evaluations is not None, templates is not None
    fixed = [
        (0, F.concat(
            F.lit('{"backend_name":'), json_string(F.col("model")),
            F.lit(',"evaluation_results":[' if with_rows else ""),
        )),
        (2, F.concat(
            F.lit("]" if with_rows else ""), F.lit(',"extras":'), open_extras if with_templates else extras
        )),
        (4, F.concat(
            F.lit("]}" if with_templates else ""), F.lit(',"metrics":'), F.col("metrics_json"),
            F.lit(',"n_evaluation_results":'), F.col("_listed").cast("string"),
            F.lit(',"suite":'), F.col("suite"), F.lit("}"),
        )),
    ]
    parts = F.array(
        *[F.struct(F.lit(n).alias("section"), F.lit(0).cast("bigint").alias("ord"), t.alias("text")) for n, t in fixed]
    )
    pieces = joined.select("run_id", F.inline(parts))
    if with_rows:
        fields = [
            (finite_or_null(c).alias(c) if c == "confidence" else F.col(c))
            for c in ROW_FIELDS if c in evaluations.columns
        ]
        row = F.to_json(F.struct(*fields), _KEEP_NULLS)
        pieces = pieces.unionByName(_listed(evaluations, 1, "row_idx", row))
    if with_templates:
        entry = F.concat(
            F.lit('{"prompt_mode":'), json_string(F.col("prompt_mode")), F.lit(',"prompt":'), F.col("prompt"), F.lit("}")
        )
        pieces = pieces.unionByName(_listed(templates, 3, "first_row", entry))
    return pieces


def write_documents(pieces: DataFrame, path: str) -> None:
    """Write document pieces in order, one folder per run; files in name order join to JSON."""
    ordered = pieces.repartitionByRange("run_id", "section", "ord").sortWithinPartitions(
        "run_id", "section", "ord"
    )
    ordered.select("run_id", "text").write.partitionBy("run_id").text(path)


ROW = (
    "case_id bigint, task string, ckd_stage int, ground_truth string, prediction string, abstained boolean, confidence double, "
    f"should_abstain boolean, raw_response string, prompt {MESSAGES}, prompt_mode string, input_tokens double, "
    "output_tokens double, total_tokens double"
)
EXTRAS, METRICS = r'^\]?,"extras":', r'^(\]\})?,"metrics":'
OPEN_TEMPLATES = '"prompt_templates":['


@dataclass
class SavedRuns:
    """Full documents as tables: heads (run_id, backend_name, suite, n_evaluation_results), rows, templates, scores, execution."""

    heads: DataFrame
    rows: DataFrame
    templates: DataFrame
    scores: DataFrame
    execution: DataFrame


def read_full_documents(spark: SparkSession, path: str) -> SavedRuns:
    """Read what ``write_documents`` wrote.

    A document is never read as a whole: each line is a piece, and how it begins says which
    section it is of. So a document of any length is split over tasks like any text file.
    """
    lines = spark.read.schema("value string, run_id string").text(path)
    value = F.col("value")
    kind = (
        F.when(value.startswith('{"backend_name":'), "head").when(value.rlike(EXTRAS), "extras").when(value.rlike(METRICS), "end")
        .when(value.rlike(r'^,?\{"prompt_mode":'), "template").otherwise("row")
    )
    named = lines.withColumn("kind", kind)
    entry = F.regexp_replace("value", "^,", "")

    def part(of: str, text: Column, schema: str) -> DataFrame:
        return named.filter(F.col("kind") == of).select("run_id", F.from_json(text, schema).alias("p"))

    opened = F.concat(F.regexp_replace("value", r',"evaluation_results":\[$', ""), F.lit("}"))
    heads = part("head", opened, "backend_name string").select("run_id", "p.*")
    ended = F.concat(F.lit('{"metrics":'), F.regexp_replace("value", METRICS, ""))
    ends = part("end", ended, f"metrics map<string,{SCORE}>, n_evaluation_results bigint, suite variant")
    given = F.regexp_replace("value", EXTRAS, "")
    extras = F.when(given.endswith(OPEN_TEMPLATES), F.concat(given, F.lit("]}"))).otherwise(given)
    execution = part("extras", F.concat(F.lit('{"execution":'), extras, F.lit("}")), f"execution {EXECUTION}").select("run_id", "p.execution.*")
    plain = ends.select("run_id", F.lit(None).cast("string").alias("task"), F.lit(None).cast("string").alias("model"), F.lit(1).alias("repeat"), "p.metrics")
    facts = ends.select("run_id", F.to_json("p.suite").alias("suite"), "p.n_evaluation_results")
    return SavedRuns(
        heads.join(facts, "run_id", "full"),
        part("row", entry, ROW).select("run_id", "p.*"),
        part("template", entry, f"prompt_mode string, prompt {MESSAGES}").select("run_id", "p.*"),
        document_scores(plain).drop("task", "model", "repeat"),
        execution,
    )


def write_request_file(payloads: DataFrame, path: str) -> None:
    """JSON lines for an offline batch service: one request with its id per line."""
    custom_id = F.concat_ws("-", "run_id", F.col("batch_id").cast("string"))
    line = F.concat(F.lit('{"custom_id":'), json_string(custom_id), F.lit(',"body":'), F.col("body"), F.lit("}"))
    payloads.select(line.alias("value")).write.text(path)
