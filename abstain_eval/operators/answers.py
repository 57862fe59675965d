"""Reading model answers: single JSON objects, phrases, and batches of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.functions.joins import sized_side
from abstain_eval.functions.numbers import clamp
from abstain_eval.functions.steps import add_once
from abstain_eval.functions.text import normalised, strip
from abstain_eval.operators.requests import redact
from abstain_eval.session import cut_lineage

FENCE = "```"
END = "~end~"
ANSWER_FIELDS = "struct<abstained variant, confidence variant, prediction variant>"
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NON_FINITE = r"^[+-]?(nan|inf|infinity)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_json_text(df: DataFrame, raw: str) -> DataFrame:
    """Add ``_blob``, the JSON part of an answer."""
    stripped = add_once(df, {"_stripped": strip(raw)})
    return add_once(stripped, {"_blob": json_text("_stripped")}).drop("_stripped")


def json_text(stripped) -> Column:
    """The JSON part of an answer: a fence's body, the whole text, or first to last brace.

    A fence decides even when its body is empty. Text positions instead of one pattern keep
    long answers linear.
    """
    s = _col(stripped)
    opening = F.instr(s, FENCE)
    closing = F.call_function("locate", F.lit(FENCE), s, opening + 3)
    body = F.substring(s, opening + 3, closing - opening - 3)
    fenced = strip(F.regexp_replace(body, "^(?i)json", ""))
    first = F.instr(s, "{")
    last = F.length(s) - F.length(F.substring_index(s, "}", -1))
    return (
        F.when((opening > 0) & (closing > 0), fenced)
        .when(s.startswith("{") & s.endswith("}"), s)
        .when((first > 0) & (last > first), F.substring(s, first, last - first + 1))
    )


def kind_of(value: Column) -> Column:
    """JSON type of a variant: VOID, BOOLEAN, STRING, a number type, ARRAY..., OBJECT..."""
    return F.schema_of_variant(value)


def _number_kind(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _get(value: Column, kind: str, path: str = "$") -> Column:
    return F.try_variant_get(value, path, kind)


def truth_of(value: Column, kind: Column) -> Column:
    """Truthiness by JSON type; the texts "false" and "no" count as true."""
    return F.coalesce(
        F.when(kind == "BOOLEAN", _get(value, "boolean"))
        .when(kind == "STRING", F.length(_get(value, "string")) > 0)
        .when(_number_kind(kind), _get(value, "double") != 0)
        .when(kind.startswith("ARRAY"), _get(value, "variant", "$[0]").isNotNull())
        .when(kind.startswith("OBJECT"), kind != "OBJECT<>"),
        F.lit(False),
    )


def confidence_of(value: Column, kind: Column) -> Column:
    """Number in [0, 1] out of a number, a number's text or a boolean."""
    text = strip(_get(value, "string"))
    digits = F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")
    special = F.lower(text)
    from_text = (
        F.when(digits.rlike(FLOAT), digits.try_cast("double"))
        .when(special.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
        .when(special.rlike(NON_FINITE), F.when(special.startswith("-"), 0.0).otherwise(1.0))
    )
    number = (
        F.when(kind == "STRING", from_text)
        .when(kind == "BOOLEAN", F.when(_get(value, "boolean"), 1.0).otherwise(0.0))
        .when(_number_kind(kind), _get(value, "double"))
    )
    return F.when(F.isnan(number), number).otherwise(clamp(number, 0.0, 1.0))


def _whole_number(value: Column, kind: Column) -> Column:
    """Number cut to an integer, as text."""
    return F.coalesce(
        F.when(kind == "BIGINT", _get(value, "bigint").cast("string")), _cut(_get(value, "double"))
    )


def _cut(number: Column) -> Column:
    toward_zero = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(
        F.abs(number) < 1e15, toward_zero.cast("bigint").cast("string")
    ).otherwise(number.try_cast("decimal(38,0)").cast("string"))


def _integer_text(text: Column) -> Column:
    """Canonical integer of a text, any sign and leading zeros."""
    digits = F.regexp_replace(text, "_", "")
    return F.coalesce(digits.try_cast("decimal(38,0)").cast("string"), digits)


def prediction_of(value: Column, kind: Column, task, abstained: Column) -> Column:
    """Struct (value, error): the prediction in canonical text, or why it cannot be read."""
    text = _get(value, "string")
    trimmed, flat = strip(text), normalised(text)
    is_text, is_number = kind == "STRING", _number_kind(kind)
    absent = value.isNull() | (kind == "VOID") | (is_text & (text == "null"))
    flag = F.when(_get(value, "boolean"), F.lit("1")).otherwise(F.lit("0"))
    as_json = _get(value, "string")

    kept = (
        F.when(absent | (is_text & (text == "")), None)
        .when(is_text, text)
        .when(kind == "BOOLEAN", flag)
        .otherwise(as_json)
    )
    detection = (
        F.when(is_number, _whole_number(value, kind))
        .when(kind == "BOOLEAN", flag)
        .when(is_text & trimmed.rlike(INTEGER), _integer_text(trimmed))
    )
    other = (
        F.when(is_number, _whole_number(value, kind))
        .when(is_text & trimmed.rlike("^[0-9]+$"), _integer_text(trimmed))
        .when(is_text, flat)
        .otherwise(F.lower(as_json))
    )
    answered = F.when(absent, None).when(_col(task) == "detection", detection).otherwise(other)
    unreadable = ~abstained & ~absent & (_col(task) == "detection") & detection.isNull()
    return F.struct(
        F.when(abstained, kept).otherwise(answered).alias("value"),
        F.when(unreadable, F.lit("prediction_not_an_integer")).alias("error"),
    )


def says_abstain(raw) -> Column:
    return F.lower(_col(raw)).rlike("|".join(k.ABSTAIN_PHRASES))


def answer_object(blob: Column) -> Column:
    """The three answer fields of a JSON object, null when the text is no JSON object.

    The object is read inside another one that ends in a mark, so text behind a complete
    object is noticed. Repeated keys keep the last value.
    """
    wrapped = F.concat(F.lit('{"d":'), blob, F.lit(f',"{END}":true}}'))
    read = F.from_json(
        wrapped, f"struct<d {ANSWER_FIELDS}, `{END}` boolean>", {"allowSingleQuotes": "false"}
    )
    return F.when(read.getField(END), read.getField("d"))


def _typed(df: DataFrame, fields: dict[str, Column], task) -> DataFrame:
    """Add _read (prediction and error), _abstains and _sure from variant fields."""
    base = add_once(df, {f"_{name}": value for name, value in fields.items()})
    kinds = add_once(base, {f"_{name}_kind": kind_of(F.col(f"_{name}")) for name in fields})
    flagged = add_once(
        kinds,
        {
            "_abstains": truth_of(F.col("_abstained"), F.col("_abstained_kind")),
            "_sure": confidence_of(F.col("_confidence"), F.col("_confidence_kind")),
        },
    )
    read = prediction_of(F.col("_prediction"), F.col("_prediction_kind"), task, F.col("_abstains"))
    typed = add_once(flagged, {"_read": read})
    return typed.drop(*[f"_{n}" for n in fields], *[f"_{n}_kind" for n in fields])


def parse_answers(responses: DataFrame, raw: str = "raw_response", task: str = "task") -> DataFrame:
    """Add prediction, abstained, confidence, parse_path and parse_error.

    ``parse_path`` is json, phrase (an abstaining phrase in text that is no JSON object) or
    none. All steps are narrow.
    """
    found = add_once(with_json_text(responses, raw), {"_d": answer_object(F.col("_blob"))})
    names = ("abstained", "confidence", "prediction")
    typed = _typed(found, {n: F.col("_d").getField(n) for n in names}, task)
    is_json = F.col("_d").isNotNull()
    phrase = ~is_json & F.coalesce(says_abstain(raw), F.lit(False))
    return typed.withColumns(
        {
            "prediction": F.when(is_json, F.col("_read.value")),
            "abstained": F.when(is_json, F.col("_abstains")).otherwise(phrase),
            "confidence": F.when(is_json, F.col("_sure")),
            "parse_path": F.when(is_json, "json").when(phrase, "phrase").otherwise("none"),
            "parse_error": F.when(is_json, F.col("_read.error")),
        }
    ).drop("_blob", "_d", "_read", "_sure", "_abstains")


def malformed_reason() -> Column:
    """Why an answer says nothing: unreadable prediction, empty, or no field at all."""
    says_nothing = F.col("prediction").isNull() & ~F.col("abstained") & F.col("confidence").isNull()
    return (
        F.when(F.col("parse_error").isNotNull(), F.col("parse_error"))
        .when(F.coalesce(strip("raw_response"), F.lit("")) == "", "empty_response")
        .when(says_nothing, "no_readable_answer")
    )


def apply_malformed_policy(parsed: DataFrame, on_malformed: str = "error") -> tuple[DataFrame, DataFrame]:
    """Usable answers and quarantined ones.

    With ``error`` malformed rows go to quarantine with a reason; with ``abstain`` they are
    kept as abstentions and nothing is quarantined.
    """
    marked = parsed.withColumn("malformed", malformed_reason())
    bad = F.col("malformed").isNotNull()
    if on_malformed == "error":
        return marked.filter(~bad), marked.filter(bad)
    if on_malformed != "abstain":
        raise ValueError(f"unknown policy: {on_malformed!r}")
    kept = marked.withColumns(
        {
            "prediction": F.when(~bad, F.col("prediction")),
            "confidence": F.when(~bad, F.col("confidence")),
            "abstained": bad | F.col("abstained"),
        }
    )
    return kept, marked.filter(F.lit(False))


def strict_json(blob: Column) -> Column:
    """Variant of a text that is JSON from end to end, else null."""
    read = F.try_parse_json(F.concat(F.lit("["), blob, F.lit(f',"{END}"]')))
    whole = F.try_variant_get(read, "$[1]", "string") == END
    return F.when(whole, F.try_variant_get(read, "$[0]", "variant"))


def repaired_json(blob) -> Column:
    """Parse, and if that fails add missing commas, drop trailing ones, or do both."""
    blob = _col(blob)
    between = F.regexp_replace(blob, r"\}\s*\{", "},{")
    trailing = lambda text: F.regexp_replace(text, r",\s*([}\]])", "$1")
    return F.coalesce(
        strict_json(blob), strict_json(between), strict_json(trailing(blob)), strict_json(trailing(between))
    )


def _item_ids(items: Column) -> Column:
    """Ids of the result objects; other entries have none."""
    return F.transform(items, lambda i: F.try_variant_get(i, "$.id", "string"))


def read_batches(responses: DataFrame, raw: str = "raw_response", task: str = "task") -> DataFrame:
    """Verdict per batch: add items (in case order), missing ids and the reason for rejection.

    Needs ``size``. A batch is one row, and its results are matched to slots inside the row,
    so nothing is shuffled. The last of several results for an id counts; unknown ids are
    left out.
    """
    document = add_once(with_json_text(responses, raw), {"_doc": repaired_json("_blob")})
    listed = add_once(document, {"_items": F.try_variant_get("_doc", "$.results", "array<variant>")})
    # Last result first, so that the first hit of an id is its last result.
    back = add_once(listed, {"_back": F.reverse("_items"), "_expected": _slot_names(F.col("size"))})
    ids = add_once(back, {"_ids": _item_ids(F.col("_back"))})
    absent = F.filter("_expected", lambda e: ~F.array_contains(F.col("_ids"), e))
    checked = add_once(ids, {"missing_ids": F.when(F.col("_items").isNotNull(), absent)})
    reason = (
        F.when(F.coalesce(strip(raw), F.lit("")) == "", "empty_response")
        .when(F.col("_blob").isNull(), "no_json")
        .when(F.col("_doc").isNull(), "malformed_json")
        .when(F.col("_items").isNull(), "no_results")
        .when(F.size("missing_ids") > 0, "missing_ids")
    )
    ordered = F.transform(
        "_expected",
        lambda e: F.element_at(F.col("_back"), F.array_position(F.col("_ids"), e).cast("int")),
    )
    verdict = add_once(checked, {"_form": reason})
    matched = add_once(verdict, {"_matched": F.when(F.col("_form").isNull(), ordered)})
    unreadable = F.exists("_matched", lambda item: _unreadable_item(item, task))
    spoiled = F.when(unreadable, F.lit("prediction_not_an_integer"))
    final = add_once(matched, {"reason": F.coalesce(F.col("_form"), spoiled)})
    return add_once(final, {"items": F.when(F.col("reason").isNull(), F.col("_matched"))}).drop(
        "_blob", "_doc", "_items", "_back", "_ids", "_expected", "_form", "_matched"
    )


def _unreadable_item(item: Column, task) -> Column:
    prediction = F.try_variant_get(item, "$.prediction", "variant")
    abstained = F.try_variant_get(item, "$.abstained", "variant")
    abstains = truth_of(abstained, kind_of(abstained))
    return prediction_of(prediction, kind_of(prediction), task, abstains).getField("error").isNotNull()


def _slot_names(size: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.concat(F.lit("case_"), i.cast("string"))
    )


def item_rows(batches: DataFrame, task: str = "task") -> DataFrame:
    """One parsed row per result of the accepted batches."""
    kept = [c for c in batches.columns if c not in ("items", "missing_ids", "reason", "raw_response")]
    rows = batches.filter("reason is null").select(*kept, F.posexplode("items").alias("slot", "_item"))
    names = ("abstained", "confidence", "prediction")
    typed = _typed(rows, {n: F.try_variant_get("_item", f"$.{n}", "variant") for n in names}, task)
    without_id = F.map_filter(
        F.try_variant_get("_item", "$", "map<string,variant>"), lambda key, _: key != "id"
    )
    return typed.select(
        *kept, "slot",
        F.col("_read.value").alias("prediction"),
        F.col("_abstains").alias("abstained"),
        F.col("_sure").alias("confidence"),
        F.to_json(without_id).alias("raw_response"),
    )


def refused_batches(batches: DataFrame) -> DataFrame:
    """Batches to be asked again, with the reason."""
    return batches.filter("reason is not null").select(
        "run_id", "batch_id", "size", "reason",
        F.coalesce("missing_ids", F.array().cast("array<string>")).alias("missing_ids"),
    )


def parse_batches(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Case rows of sound batches, and the rejected batches with their reason.

    One unreadable prediction rejects its whole batch, which is then asked again in halves.
    """
    batches = responses.transform(read_batches)
    return item_rows(batches), refused_batches(batches)


def next_round(cases: DataFrame, rejected: DataFrame) -> DataFrame:
    """Plan of the next calls: halves of rejected batches; a rejected single case goes alone.

    ``cases`` has (run_id, batch_id, slot, round, mode, case_id) of the round just read. Ids
    double every round, so they stay unique within one.
    """
    failed = rejected.select("run_id", "batch_id", "size").distinct()
    redo = cases.drop("size").join(failed, ["run_id", "batch_id"])
    half = F.floor(F.col("size") / 2).cast("int")
    upper = F.col("slot") >= half
    alone = F.col("size") == 1
    return redo.select(
        "run_id", "case_id",
        (F.col("batch_id") * 2 + F.when(alone | ~upper, 0).otherwise(1)).alias("batch_id"),
        F.when(alone, 0).when(upper, F.col("slot") - half).otherwise(F.col("slot")).cast("int").alias("slot"),
        F.when(alone, 1).when(upper, F.col("size") - half).otherwise(half).cast("int").alias("size"),
        (F.col("round") + 1).cast("int").alias("round"),
        F.when(alone, "single").otherwise("batch").alias("mode"),
    )


def _first_number(document: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.try_variant_get(document, f"$.{p}", "double") for p in paths])


def with_usage(responses: DataFrame, usage: str = "usage", provider: str = "provider") -> DataFrame:
    """Input, output and total tokens from the usage shapes of three providers."""
    parsed = add_once(responses, {"_usage": F.try_parse_json(usage)})

    def read(paths: dict[str, list[str]]) -> Column:
        chain = None
        for name, options in paths.items():
            hit = F.col(provider) == name
            # The third shape falls back to plain usage only when its own block is absent.
            value = _first_number(F.col("_usage"), options)
            if name == "gemini":
                block = F.try_variant_get("_usage", "$.usage_metadata", "variant")
                absent = block.isNull() | F.is_variant_null(block)
                plain = [p.replace("usage_metadata.", "usage.") for p in options]
                value = F.when(absent, _first_number(F.col("_usage"), plain)).otherwise(value)
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        return chain

    return (
        parsed.withColumn("input_tokens", read(k.INPUT_TOKEN_PATHS))
        .withColumn("output_tokens", read(k.OUTPUT_TOKEN_PATHS))
        .withColumn("total_tokens", total_tokens("input_tokens", "output_tokens"))
        .drop("_usage")
    )


def total_tokens(tokens_in, tokens_out) -> Column:
    """Sum of both counts, null only when both are."""
    a, b = _col(tokens_in), _col(tokens_out)
    return F.when(
        a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    )


def spread_usage(rows: DataFrame) -> DataFrame:
    """A batch's tokens in equal parts on its rows; ``size`` is the batch's row count."""
    return rows.withColumns(
        {c: F.col(c) / F.col("size") for c in ("input_tokens", "output_tokens", "total_tokens")}
    )


def attach_prompts(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Redacted prompt and mode of the request each row came from."""
    prompts = requests.select(
        "run_id", "batch_id", redact("messages").alias("prompt"), F.col("mode").alias("prompt_mode")
    )
    return rows.join(prompts, ["run_id", "batch_id"], "left")


def refuse_bad_keys(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be told apart, and those that can't, with a reason.

    Answers are matched to records by run_id and case_id: both must be there, and no two records
    may share them. Repeated keys are few or none, so records are not shuffled to find them.
    """
    absent = F.when(F.col("run_id").isNull(), "no_run_id").when(F.col("case_id").isNull(), "no_case_id")
    keys = records.filter(absent.isNull()).groupBy("run_id", "case_id").agg(F.count(F.lit(1)).alias("n"))
    twice = sized_side(keys.filter("n > 1").select("run_id", "case_id", F.lit("repeated_case_id").alias("_twice")))
    judged = cut_lineage(
        records.withColumn("_absent", absent).join(twice, ["run_id", "case_id"], "left")
        .withColumn("_fault", F.coalesce("_absent", "_twice")).drop("_absent", "_twice")
    )
    refused = judged.filter("_fault is not null").select(
        "run_id", F.col("case_id").cast("bigint").alias("case_id"), F.col("_fault").alias("reason"),
        F.lit(None).cast("string").alias("raw_response"),
    )
    return judged.filter("_fault is null").drop("_fault"), refused


def evaluation_rows(answers: DataFrame, cases: DataFrame) -> DataFrame:
    """Answers with the truth and the hidden metadata of their case."""
    truth = cases.select(
        "run_id", "case_id", "row_idx", "task",
        F.col("label").alias("ground_truth"),
        F.col("metadata.ckd_stage").alias("ckd_stage"),
        F.col("metadata.should_abstain").alias("should_abstain"),
    )
    return answers.drop("task", "row_idx").join(truth, ["run_id", "case_id"])


def classify_errors(
    errors: DataFrame, max_retries: int = 2, base_delay: float = 1.0, max_delay: float = 30.0
) -> DataFrame:
    """Failed calls (status, error_name, attempt): worth a retry, and after how long."""
    by_name = F.col("error_name").rlike("|".join(k.RETRYABLE_NAMES))
    retryable = F.when(F.col("status").isNotNull(), F.col("status").isin(k.RETRYABLE_STATUS)).otherwise(
        F.coalesce(by_name, F.lit(False))
    )
    delay = F.least(F.lit(float(max_delay)), F.lit(float(base_delay)) * F.pow(F.lit(2.0), F.col("attempt")))
    again = F.col("retryable") & (F.col("attempt") < max_retries)
    return errors.withColumn("retryable", retryable).withColumns(
        {"will_retry": again, "next_delay": F.when(again, delay)}
    )


def empty_answers(responses: DataFrame, backend: str, token_setting: str = "max_tokens") -> DataFrame:
    """Answers without text, with a reason code and a hint."""
    batch = F.col("mode") == "batch"
    hint = F.concat(
        F.format_string(
            f"{backend} sent no text in its %s. Raise {token_setting}",
            F.when(batch, "batch answer").otherwise("answer"),
        ),
        F.when(batch, F.lit(" or use smaller batches")).otherwise(F.lit("")),
        F.when(
            F.coalesce(F.col("finish_reason"), F.lit("")) != "",
            F.concat(F.lit(" (finish_reason="), F.col("finish_reason"), F.lit(")")),
        ).otherwise(F.lit("")),
        F.lit("."),
    )
    empty = responses.filter(F.coalesce(strip("raw_response"), F.lit("")) == "")
    return empty.withColumns({"reason": F.lit("empty_response"), "message": hint})
