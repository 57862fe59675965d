"""Metric and run queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.checks.common import EV, Query, evaluations, orders, q9, r9, rounded
from abstain_eval.functions.labels import binary_label, label_key, labels_match
from abstain_eval.operators import metrics as m
from abstain_eval.operators import requests, runs
from abstain_eval.operators.answers import total_tokens
from abstain_eval.plans import derived as d
from abstain_eval.session import cut_lineage, fresh_path
from abstain_eval.sources import documents

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def flat(scores: DataFrame) -> DataFrame:
    return scores.select(
        "run_id", "metric", r9("value").alias("value"), "n_evaluated", "n_abstained", "reason"
    )


def parts(scores: DataFrame) -> DataFrame:
    return rounded(m.breakdown_rows(scores), "part_value")


LABELS = """
select k,
 case k % 10 when 0 then '+1' when 1 then '01' when 2 then '1.0' when 3 then ' 1 ' when 4 then ' Stable'
  when 5 then null when 6 then '-0' when 7 then '1_0' when 8 then 'worsening' else cast(k % 3 as string) end as prediction,
 case when k % 10 in (4, 8) then 'stable' when k % 10 = 6 then '0' when k % 10 = 7 then '10' else '1' end as truth
from (select o_orderkey as k from orders) a
"""
_INT = "case when regexp_full_match(trim({c}), '{p}') then cast(replace(trim({c}), '_', '') as bigint) end"


def _as_int(c: str, p: str) -> str:
    return _INT.format(c=c, p=p)


@register(
    "label_match",
    f"""with l as ({LABELS}) select k, coalesce({_as_int('prediction', '[+-]?[0-9]+(_[0-9]+)*')} = {_as_int('truth', '[+-]?[0-9]+(_[0-9]+)*')}, false)
    or coalesce(lower(trim(prediction)) = lower(trim(truth)), false) as is_match from l""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = d.derive(spark, sf, LABELS)
    return pairs.select("k", labels_match("prediction", "truth").alias("is_match"))


_KEY = "case when regexp_full_match(trim({c}), '-?[0-9]+') then 'int:' || cast(cast(trim({c}) as bigint) as varchar) else 'str:' || lower(trim({c})) end"


@register(
    "label_keys",
    f"""with l as ({LABELS}) select k, {_KEY.format(c='prediction')} as prediction_key, {_KEY.format(c='truth')} as truth_key,
    cast(case when trim(prediction) in ('0', '1') then trim(prediction) end as int) as binary_prediction from l""",
)
def _(spark, sf):
    pairs = d.derive(spark, sf, LABELS)
    return pairs.select(
        "k", label_key("prediction").alias("prediction_key"), label_key("truth").alias("truth_key"),
        binary_label("prediction").alias("binary_prediction"),
    )


_ACC = "select run_id, 'accuracy' as metric, {v} as value, count(*) as n_evaluated, count(*) filter (abstained) as n_abstained, cast(null as varchar) as reason from f group by run_id"


@register("score_accuracy", f"{EV} " + _ACC.format(v=q9("count(*) filter (hit and not abstained) / count(*)")))
def _(spark, sf):
    return flat(m.accuracy(evaluations(spark, sf)))


@register(
    "score_accuracy_neutral",
    f"""{EV} select run_id, 'accuracy' as metric, {q9('count(*) filter (hit and not abstained) / count(*) filter (not abstained)')} as value,
    count(*) filter (not abstained) as n_evaluated, count(*) filter (abstained) as n_abstained, cast(null as varchar) as reason from f group by run_id""",
)
def _(spark, sf):
    return flat(m.accuracy(evaluations(spark, sf), abstention_is_neutral=True))


_BALANCED = """
c as (select run_id, stage, part, ground_truth, count(*) as n, count(*) filter (hit and not abstained) as h from f group by all),
per_class as (select run_id, ground_truth, sum(h) / sum(n) as rate from c group by all),
per_stage as (select run_id, part, ground_truth, sum(h) / sum(n) as rate from c group by all),
totals as (select run_id, count(*) as n, count(*) filter (abstained) as a from f group by run_id)
"""


@register(
    "score_balanced_accuracy",
    f"""{EV}, {_BALANCED} select p.run_id, 'balanced_accuracy' as metric, {q9('avg(rate)')} as value, any_value(t.n) as n_evaluated,
    any_value(t.a) as n_abstained, cast(null as varchar) as reason from per_class p join totals t using (run_id) group by p.run_id""",
)
def _(spark, sf):
    return flat(m.balanced_accuracy(evaluations(spark, sf)))


@register(
    "balanced_accuracy_by_stage",
    f"""{EV}, {_BALANCED} select run_id, 'balanced_accuracy' as metric, part, {q9('avg(rate)')} as part_value
    from per_stage group by run_id, part having count(*) >= 2""",
)
def _(spark, sf):
    return parts(m.balanced_accuracy(evaluations(spark, sf)))


@register(
    "score_selective_accuracy",
    f"""{EV} select run_id, 'selective_accuracy' as metric, {q9('count(*) filter (hit and not abstained) / count(*) filter (not abstained)')} as value,
    count(*) filter (not abstained) as n_evaluated, count(*) filter (abstained) as n_abstained, cast(null as varchar) as reason from f group by run_id""",
)
def _(spark, sf):
    return flat(m.selective_accuracy(evaluations(spark, sf)))


def _rate_sql(metric: str, condition: str) -> str:
    return (
        f"{EV} select run_id, '{metric}' as metric, {q9(f'count(*) filter ({condition}) / count(*)')} as value, count(*) as n_evaluated, "
        "count(*) filter (abstained) as n_abstained, cast(null as varchar) as reason from f group by run_id"
    )


@register("score_abstention_rate", _rate_sql("abstention_rate", "abstained"))
def _(spark, sf):
    return flat(m.abstention_rate(evaluations(spark, sf)))


@register("score_answer_rate", _rate_sql("answer_rate", "not abstained"))
def _(spark, sf):
    return flat(m.answer_rate(evaluations(spark, sf)))


@register(
    "stage_breakdown",
    f"""{EV}, s as (select run_id, part, count(*) as n, count(*) filter (abstained) as a, count(*) filter (hit and not abstained) as h from f group by all)
    select run_id, 'accuracy' as metric, part, {q9('h / n')} as part_value from s
    union all select run_id, 'answer_rate', part, {q9('(n - a) / n')} from s
    union all select run_id, 'abstention_rate', part, {q9('a / n')} from s
    union all select run_id, 'selective_accuracy', part, {q9('h / (n - a)')} from s where n > a""",
)
def _(spark, sf):
    e = evaluations(spark, sf)
    wanted = ("accuracy", "answer_rate", "abstention_rate", "selective_accuracy")
    return parts(m.score_runs(e).filter(F.col("metric").isin(*wanted)))


_CONFUSION = """count(*) filter (should_abstain and abstained) as defer_when_needed,
 count(*) filter (not should_abstain and not abstained) as answer_when_safe,
 count(*) filter (not should_abstain and abstained) as abstain_when_should_answer,
 count(*) filter (should_abstain and not abstained) as answer_when_should_defer"""


@register(
    "score_deferral_alignment",
    f"""{EV} select run_id, {q9('count(*) filter (should_abstain = abstained) / count(should_abstain)')} as value,
    count(should_abstain) as n_labeled, {_CONFUSION} from f group by run_id""",
)
def _(spark, sf):
    scores = m.deferral_alignment(evaluations(spark, sf))
    detail = F.from_json(
        "details",
        "n_labeled bigint, confusion struct<defer_when_needed bigint, answer_when_safe bigint, "
        "abstain_when_should_answer bigint, answer_when_should_defer bigint>",
    )
    read = scores.withColumn("d", detail)
    return read.select("run_id", r9("value").alias("value"), "d.n_labeled", "d.confusion.*")


@register("calibration_rows", f"{EV} select run_id, case_id, prediction, confidence from f where usable")
def _(spark, sf):
    return m.calibration_rows(evaluations(spark, sf)).select("run_id", "case_id", "prediction", "confidence")


@register("answered_rows", f"{EV} select run_id, case_id, prediction from f where not abstained")
def _(spark, sf):
    return m.answered_rows(evaluations(spark, sf)).select("run_id", "case_id", "prediction")


@register("abstained_rows", f"{EV} select run_id, case_id, ground_truth from f where abstained")
def _(spark, sf):
    return m.abstained_rows(evaluations(spark, sf)).select("run_id", "case_id", "ground_truth")


@register(
    "confidence_complete",
    f"""{EV} select run_id || '_' || cast(case_id % 19 as varchar) as run_id, bool_and(abstained or confidence is not null) as complete
    from f group by 1""",
)
def _(spark, sf):
    e = evaluations(spark, sf)
    finer = F.concat_ws("_", "run_id", (F.col("case_id") % 19).cast("string"))
    return m.confidence_complete(e.withColumn("run_id", finer))


_BINS = """b as (select run_id, bin, count(*) as n, count(*) filter (hit) as h, sum(confidence) as s from f where usable group by all)"""


@register(
    "reliability_bins",
    f"""{EV}, b as (select run_id, least(cast(trunc(confidence * 150) as int), 149) as bin, count(*) as n, count(*) filter (hit) as h, sum(confidence) as s
      from f where usable group by all),
    grid as (select run_id, i as bin from (select distinct run_id from b), range(150) t(i))
    select grid.run_id, cast(grid.bin as int) as bin, {q9('grid.bin / 150')} as low, {q9('(grid.bin + 1) / 150')} as high,
    coalesce(n, 0) as count, {q9('h / n')} as accuracy, {q9('s / n')} as mean_confidence, {q9('abs(h / n - s / n)')} as gap
    from grid left join b on grid.run_id = b.run_id and grid.bin = b.bin""",
)
def _(spark, sf):
    # More bins than distinct confidences, so some stay empty.
    bins = m.reliability_bins(evaluations(spark, sf), 150)
    return rounded(bins, "low", "high", "accuracy", "mean_confidence", "gap")


@register(
    "score_calibration_error",
    f"""{EV}, {_BINS} select run_id, {q9('sum(abs(h / n - s / n) * n) / sum(n)')} as value, cast(sum(n) as bigint) as n_evaluated from b group by run_id""",
)
def _(spark, sf):
    scores = m.expected_calibration_error(evaluations(spark, sf))
    return scores.select("run_id", r9("value").alias("value"), "n_evaluated")


@register(
    "calibration_gaps",
    f"{EV}, {_BINS} select run_id, 'expected_calibration_error' as metric, 'bin_' || bin || '_gap' as part, {q9('abs(h / n - s / n)')} as part_value from b",
)
def _(spark, sf):
    return parts(m.expected_calibration_error(evaluations(spark, sf)))


_BRIER = """y as (select run_id || case when prediction = 'unknown' then '_u' else '' end as run_id, abstained, usable, confidence,
  case when trim(ground_truth) in ('0', '1') then cast(ground_truth as int) end as t,
  case when trim(prediction) in ('0', '1') then cast(trim(prediction) as int) end as p from f)"""


@register(
    "score_brier",
    f"""{EV}, {_BRIER} select run_id, case when count(*) filter (usable and (t is null or p is null)) = 0 then
    {q9('sum(pow(case when p = 1 then confidence else 1 - confidence end - t, 2)) filter (usable) / count(*) filter (usable)')} end as value,
    count(*) filter (usable) as n_evaluated,
    case when count(*) filter (usable) = 0 then 'no_rows_with_confidence'
     when count(*) filter (usable and (t is null or p is null)) > 0 then 'non_binary_labels_or_predictions' end as reason
    from y group by run_id""",
)
def _(spark, sf):
    e = evaluations(spark, sf)
    # Rows with an unseen label form runs of their own, so that binary runs stay defined.
    apart = F.when(F.col("prediction") == "unknown", "_u").otherwise("")
    named = e.withColumn("run_id", F.concat("run_id", apart))
    return m.brier_score(named).select("run_id", r9("value").alias("value"), "n_evaluated", "reason")


_BUNDLE = f"""{EV}, {_BALANCED}, {_BINS},
t as (select run_id, count(*) as n, count(*) filter (abstained) as a, count(*) filter (hit and not abstained) as h,
  count(should_abstain) as lab, count(*) filter (should_abstain = abstained) as ok, count(*) filter (usable) as u from f group by run_id)
select run_id, 'accuracy' as metric, {q9('h / n')} as value, n as n_evaluated, a as n_abstained, cast(null as varchar) as reason from t
union all select p.run_id, 'balanced_accuracy', {q9('avg(rate)')}, any_value(n), any_value(a), null from per_class p join t using (run_id) group by p.run_id
union all select run_id, 'selective_accuracy', {q9('h / (n - a)')}, n - a, a, null from t
union all select run_id, 'abstention_rate', {q9('a / n')}, n, a, null from t
union all select run_id, 'answer_rate', {q9('(n - a) / n')}, n, a, null from t
union all select run_id, 'deferral_alignment', {q9('ok / lab')}, lab, a, null from t
union all select b.run_id, 'expected_calibration_error', {q9('sum(abs(b.h / b.n - s / b.n) * b.n) / sum(b.n)')}, any_value(u), any_value(a), null
  from b join t using (run_id) group by b.run_id
union all select run_id, 'brier_score', null, u, a, 'non_binary_labels_or_predictions' from t"""


@register("score_all_metrics", _BUNDLE)
def _(spark, sf):
    return flat(m.score_runs(evaluations(spark, sf)))


@register(
    "undefined_metrics",
    f"""{EV}, g as (select * replace (case when case_id % 9 = 0 then true else abstained end as abstained,
       case when case_id % 9 = 1 then null else confidence end as confidence, case when case_id % 9 = 2 then null else should_abstain end as should_abstain,
       case when case_id % 9 = 3 then '1' else ground_truth end as ground_truth), run_id || '_' || cast(case_id % 9 as varchar) as r from f),
    t as (select r, count(*) as n, count(*) filter (not abstained) as ans, count(should_abstain) as lab,
      count(*) filter (not abstained and confidence is not null and prediction is not null) as u, count(distinct ground_truth) as c,
      count(*) filter (not abstained and confidence is not null and prediction is not null and (trim(prediction) not in ('0', '1') or ground_truth not in ('0', '1'))) as nb from g group by r)
    select r as run_id, 'selective_accuracy' as metric, 'no_non_abstained_predictions' as reason, 0 as n_evaluated from t where ans = 0
    union all select r, 'balanced_accuracy', 'needs_at_least_two_classes_in_ground_truth', n from t where c < 2
    union all select r, 'deferral_alignment', 'no_should_abstain_metadata', 0 from t where lab = 0
    union all select r, 'expected_calibration_error', 'no_rows_with_confidence', 0 from t where u = 0
    union all select r, 'brier_score', case when u = 0 then 'no_rows_with_confidence' else 'non_binary_labels_or_predictions' end, u from t where u = 0 or nb > 0""",
)
def _(spark, sf):
    e = evaluations(spark, sf)
    g = F.col("case_id") % 9
    # Groups 0 to 3 lose what one metric each needs; every row stays.
    changed = e.withColumns(
        {
            "abstained": F.when(g == 0, True).otherwise(F.col("abstained")),
            "confidence": F.when(g == 1, None).otherwise(F.col("confidence")),
            "should_abstain": F.when(g == 2, None).otherwise(F.col("should_abstain")),
            "ground_truth": F.when(g == 3, "1").otherwise(F.col("ground_truth")),
            "run_id": F.concat_ws("_", "run_id", g.cast("string")),
        }
    )
    return m.undefined_metrics(m.score_runs(changed))


@register(
    "score_document_quality",
    f"""with e as (select lang as run_id, quality as t, least(n_chars, 1000) / 1000.0 as c, case when n_chars > 200 then 1 else 0 end as p, n_chars % 7 = 0 as a
      from documents join labels using (doc_id)),
    c as (select run_id, t, count(*) filter (p = t and not a) / count(*) as rate from e group by all)
    select e.run_id, count(*) as n, {q9('count(*) filter (p = t and not a) / count(*)')} as accuracy,
    {q9('count(*) filter (p = t and not a) / nullif(count(*) filter (not a), 0)')} as selective,
    {q9('avg(pow(case when p = 1 then c else 1 - c end - t, 2)) filter (not a)')} as brier,
    any_value((select case when count(*) >= 2 then {q9('avg(rate)')} end from c where c.run_id = e.run_id)) as balanced from e group by e.run_id""",
)
def _(spark, sf):
    joined = d.read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(
        d.read_table(spark, sf, "labels"), "doc_id"
    )
    rows = joined.select(
        F.col("lang").alias("run_id"), F.lit(None).cast("int").alias("ckd_stage"),
        F.col("quality").cast("string").alias("ground_truth"),
        F.when(F.col("n_chars") > 200, "1").otherwise("0").alias("prediction"),
        (F.col("n_chars") % 7 == 0).alias("abstained"),
        (F.least("n_chars", F.lit(1000)) / 1000.0).alias("confidence"),
        F.lit(None).cast("boolean").alias("should_abstain"),
    )
    value = {
        "accuracy": "accuracy", "selective_accuracy": "selective", "brier_score": "brier",
        "balanced_accuracy": "balanced",
    }
    return m.score_runs(rows).groupBy("run_id").agg(
        F.max(F.when(F.col("metric") == "accuracy", F.col("n_evaluated"))).alias("n"),
        *[
            F.max(F.when(F.col("metric") == key, r9("value"))).alias(name)
            for key, name in value.items()
        ],
    )


# --- runs -----------------------------------------------------------------


def with_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluations with a prompt on four of five rows and token totals."""
    text = F.concat(F.lit("prompt "), (F.col("case_id") % 2).cast("string"))
    none = F.array().cast(requests.MESSAGES)
    prompt = F.when(F.col("case_id") % 5 == 0, none).otherwise(F.array(requests.message("system", text)))
    return evaluations(spark, sf).withColumns(
        {"prompt": prompt, "total_tokens": total_tokens("input_tokens", "output_tokens")}
    )


def run_table(e: DataFrame) -> DataFrame:
    seconds = F.substring("run_id", 5, 1).cast("double") * 1.5
    return e.select("run_id", "model", "task").distinct().select(
        "run_id", "model", "task", F.lit(8).alias("batch_size"), F.lit(4).alias("max_concurrency"),
        seconds.alias("elapsed_seconds"),
    )


_SUMMARY = f"""{EV}, t as (select *, case when input_tokens is null and output_tokens is null then null else coalesce(input_tokens, 0) + coalesce(output_tokens, 0) end as tot from f),
 s as (select run_id, count(*) as n_input_records, cast((count(*) + 7) // 8 as bigint) as n_api_batches,
  cast(substr(run_id, 5, 1) as double) * 1.5::double as elapsed_seconds, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens,
  sum(tot) as token_total, count(*) filter (case_id % 5 <> 0) as n_prompts_captured,
  count(distinct case when case_id % 5 <> 0 then prompt_mode || '|' || cast(case_id % 2 as varchar) end) as prompt_templates_count,
  coalesce(string_agg(distinct case when prompt_mode <> '' then prompt_mode end, ',' order by case when prompt_mode <> '' then prompt_mode end), '') as prompt_modes
  from t group by run_id)"""


@register(
    "execution_summary",
    f"""{_SUMMARY} select *, case when elapsed_seconds > 0 then {q9('n_input_records / elapsed_seconds')} end as records_per_second from s""",
)
def _(spark, sf):
    e = with_prompts(spark, sf)
    out = runs.execution_summary(e, run_table(e)).drop(
        "batch_size", "max_concurrency", "prompt_capture", "prompt_data_policy"
    )
    return rounded(out, "records_per_second")


@register(
    "execution_summary_one_sided",
    f"""{_SUMMARY.replace("from t group by run_id", "from t where run_id <> 'run_2' group by run_id")}
    select run_id, n_input_records, input_tokens, n_prompts_captured, prompt_modes, run_id <> 'run_4' as listed from s
    union all select * from (values ('run_2', 0, null, 0, '', true), ('run_9', 0, null, 0, '', true)) as v(a, b, c, d, e, f)""",
)
def _(spark, sf):
    """A run without rows, one only in the run table, and rows of a run that is not listed."""
    e = with_prompts(spark, sf)
    extra = run_table(e).filter("run_id = 'run_2'").withColumn("run_id", F.lit("run_9"))
    table = run_table(e).filter("run_id <> 'run_4'").unionByName(extra)
    out = runs.execution_summary(e.filter("run_id <> 'run_2'"), table)
    return out.select(
        "run_id", "n_input_records", "input_tokens", "n_prompts_captured", "prompt_modes", F.col("batch_size").isNotNull().alias("listed")
    )


@register(
    "run_findings",
    f"""{EV} select 'rows_without_run' as "check", 'run_id' as "column", 'run_4' as detail, count(*) as n from f where run_id = 'run_4'
    union all select * from (values ('run_without_rows', 'run_id', 'run_2', 0), ('run_without_rows', 'run_id', 'run_9', 0)) as v(a, b, c, d)""",
)
def _(spark, sf):
    e = with_prompts(spark, sf)
    extra = run_table(e).filter("run_id = 'run_2'").withColumn("run_id", F.lit("run_9"))
    table = run_table(e).filter("run_id <> 'run_4'").unionByName(extra)
    return runs.run_findings(e.filter("run_id <> 'run_2'"), table)


@register(
    "token_sums",
    f"""{EV} select run_id, coalesce(ckd_stage, 0) as stage, sum(case when case_id % 6 = 0 then null else output_tokens end) as output_tokens
    from f group by all""",
)
def _(spark, sf):
    e = evaluations(spark, sf)
    kept = F.when(F.col("case_id") % 6 == 0, None).otherwise(F.col("output_tokens"))
    return e.groupBy("run_id", F.coalesce("ckd_stage", F.lit(0)).alias("stage")).agg(
        F.sum(kept).alias("output_tokens")
    )


@register(
    "prompt_templates",
    f"""{EV} select run_id, case when prompt_mode = '' then 'unknown' else prompt_mode end as prompt_mode,
    '[{{"role":"system","content":"prompt ' || cast(case_id % 2 as varchar) || '"}}]' as prompt, min(row_idx) as first_row, count(*) as rows
    from f where case_id % 5 <> 0 group by run_id, prompt_mode, case_id % 2""",
)
def _(spark, sf):
    return runs.prompt_templates(with_prompts(spark, sf))




def repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every order month as a repeat of the model, for statistics over repeats."""
    e = evaluations(spark, sf)
    repeat = F.col("case_id") % 30
    named = e.withColumn("run_id", F.concat_ws("/", "model", "task", repeat.cast("string")))
    scores = m.score_runs(named)
    ids = F.split("run_id", "/")
    return scores.withColumns({"model": ids[0], "task": ids[1]})


_REPEATS = f"""{EV}, g as (select model, task, case_id % 30 as rep, count(*) as n, count(*) filter (abstained) as a, count(*) filter (hit and not abstained) as h,
 count(should_abstain) as lab, count(*) filter (should_abstain = abstained) as ok from f group by all),
 b as (select model, task, case_id % 30 as rep, bin, count(*) as n, count(*) filter (hit) as h, sum(confidence) as s from f where usable group by all),
 c as (select model, task, rep, sum(abs(h / n - s / n) * n) / sum(n) as ece from b group by all),
 v as (select model, task, 'accuracy' as metric, h / n as value from g union all select model, task, 'selective_accuracy', h / (n - a) from g
  union all select model, task, 'abstention_rate', a / n from g union all select model, task, 'answer_rate', (n - a) / n from g
  union all select model, task, 'deferral_alignment', ok / lab from g union all select model, task, 'expected_calibration_error', ece from c),
 st as (select model, task, metric, avg(value) as mean, stddev_samp(value) as std, count(value) as repeats from v group by all)"""
_REPEATED = [
    "accuracy", "selective_accuracy", "abstention_rate", "answer_rate", "deferral_alignment",
    "expected_calibration_error",
]


@register(
    "repeat_statistics",
    f"{_REPEATS} select model, task, metric, {q9('mean')} as mean, {q9('std')} as std, repeats from st",
)
def _(spark, sf):
    scores = repeated(spark, sf).filter(F.col("metric").isin(_REPEATED))
    return rounded(runs.repeat_statistics(scores), "mean", "std")


@register(
    "outcome_statistics",
    f"""{EV}, g as (select model, task, run_id, count(*) filter (not abstained) as answered, count(*) filter (abstained) as abstained,
      count(*) filter (not abstained and hit) as answered_correct, count(*) filter (not abstained and not coalesce(hit, false)) as answered_incorrect,
      count(*) filter (not (not abstained and coalesce(hit, false))) as overall_incorrect from f group by model, task, run_id),
    v as (unpivot g on answered, abstained, answered_correct, answered_incorrect, overall_incorrect into name metric value value)
    select model, task, metric, {q9('avg(value)')} as mean, {q9('stddev_samp(value)')} as std, count(value) as repeats from v group by all""",
)
def _(spark, sf):
    return rounded(runs.outcome_statistics(evaluations(spark, sf)), "mean", "std")


@register(
    "best_models",
    f"""{_REPEATS}, o as (select *, row_number() over (partition by task, metric order by case when metric = 'expected_calibration_error' then round(mean, 12) else -round(mean, 12) end, model) as rn from st)
    select task, metric, model, {q9('mean')} as mean, {q9('std')} as std from o where rn = 1""",
)
def _(spark, sf):
    scores = repeated(spark, sf).filter(F.col("metric").isin(_REPEATED))
    # Means that differ only by summation order count as ties.
    stats = runs.repeat_statistics(scores).withColumn("mean", F.round("mean", 12))
    return rounded(runs.best_models(stats), "mean", "std")


@register(
    "metric_labels",
    f"""with x as (select distinct case k % 10 when 0 then 'abstention_rate' when 1 then 'accuracy' when 2 then 'answer_rate' when 3 then 'balanced_accuracy'
      when 4 then 'brier_score' when 5 then 'deferral_alignment' when 6 then 'expected_calibration_error' when 7 then 'selective_accuracy'
      when 8 then 'own_metric' else 'a_new_score' end as metric from ({d.KEYS}) a)
    select metric, case metric when 'abstention_rate' then 'Abstention Rate' when 'accuracy' then 'Accuracy' when 'answer_rate' then 'Answer Rate (Coverage)'
     when 'balanced_accuracy' then 'Balanced Accuracy' when 'brier_score' then 'Brier Score' when 'deferral_alignment' then 'Deferral Alignment'
     when 'expected_calibration_error' then 'Expected Calibration Error' when 'selective_accuracy' then 'Selective Accuracy (answered only)'
     when 'own_metric' then 'Own Metric' else 'A New Score' end as label, metric as key from x""",
)
def _(spark, sf):
    names = [*sorted(k.METRIC_NAMES), "own_metric", "a_new_score"]
    chosen = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("k") % 10 + 1).cast("int"))
    named = orders(spark, sf).select(chosen.alias("metric")).distinct()
    return named.withColumn("label", runs.metric_label("metric")).withColumn("key", runs.metric_key("label"))


@register(
    "chart_series",
    f"""{_REPEATS}, p as (select model, task, metric, case when metric = 'expected_calibration_error' then 100 - 100 * value else 100 * value end as y from v)
    select task, model, {q9("avg(y) filter (metric = 'deferral_alignment')")} as deferral_alignment_mean, {q9("stddev_samp(y) filter (metric = 'deferral_alignment')")} as deferral_alignment_std,
    {q9("avg(y) filter (metric = 'expected_calibration_error')")} as calibration_quality_mean, {q9("stddev_samp(y) filter (metric = 'expected_calibration_error')")} as calibration_quality_std,
    {q9("avg(y) filter (metric = 'selective_accuracy')")} as selective_accuracy_mean, {q9("stddev_samp(y) filter (metric = 'selective_accuracy')")} as selective_accuracy_std from p group by all""",
)
def _(spark, sf):
    series = runs.chart_series(repeated(spark, sf))
    return rounded(series, *[c for c in series.columns if c not in ("task", "model")])


@register(
    "user_metric",
    f"""{EV} select run_id, {q9('sum(confidence) filter (not abstained and hit) / sum(confidence) filter (not abstained)')} as value, count(*) as n_evaluated from f group by run_id""",
)
def _(spark, sf):
    answered = ~F.col("abstained")
    scores = m.user_metric(
        evaluations(spark, sf),
        "confidence_weighted_accuracy",
        {
            "won": F.sum(F.when(answered & m.label_hit(), F.col("confidence"))),
            "staked": F.sum(F.when(answered, F.col("confidence"))),
        },
        F.try_divide("won", "staked"),
    )
    return scores.select("run_id", r9("value").alias("value"), "n_evaluated")


@register(
    "user_metric_in_pandas",
    f"{EV} select run_id, 'token_share' as metric, {q9('sum(output_tokens) / sum(input_tokens)')} as value from f group by run_id",
)
def _(spark, sf):
    def partial(frame):
        return frame.groupby("run_id", as_index=False)[["input_tokens", "output_tokens"]].sum()

    def merge(frame):
        return frame["output_tokens"].sum() / frame["input_tokens"].sum()

    e = evaluations(spark, sf).select("run_id", "input_tokens", "output_tokens")
    scores = m.user_metric_in_pandas(
        e, "token_share", partial, merge, "input_tokens double, output_tokens double"
    )
    return rounded(scores, "value")


def _suite(e: DataFrame) -> DataFrame:
    runs_ = run_table(e)
    texts = F.array(
        F.struct(F.lit("seed").alias("name"), F.lit("42").alias("text")),
        F.struct(F.lit("task").alias("name"), F.col("task").alias("text")),
    )
    return runs_.select("run_id", F.inline(texts))


_REPORT_METRICS = _BUNDLE.replace("select run_id, 'accuracy' as metric", ", sc as (select run_id, 'accuracy' as metric", 1) + ")"
_LABEL_SQL = "case metric " + " ".join(f"when '{key}' then '{label}'" for key, label in sorted(k.METRIC_NAMES.items())) + " end"


_METRIC_LINES = f"""{_REPORT_METRICS.replace('t as (', 't as (')} select run_id, cast(2 as int) as section, metric as ord,
    '  ' || {_LABEL_SQL} || ': ' || case when value is null then 'nan' else printf('%.4f', floor(value * 1e4 + 0.5) / 1e4) end
    || ' (n_evaluated=' || n_evaluated || ', n_abstained=' || n_abstained || ')' as line from sc
    union all select distinct run_id, 1, 'seed', '  seed: 42' from f union all select distinct run_id, 1, 'task', '  task: ' || task from f
    union all select distinct run_id, 0, '1', 'Evaluation report' from f union all select distinct run_id, 0, '2', '=================' from f
    union all select distinct run_id, 0, '3', 'Backend: ' || model from f
    union all select run_id, 4, '2', 'Total patient rows: ' || n from t
    union all select run_id, 4, '1', '' from t
    union all select run_id, s.n, s.o, s.t from t, (values (1, '', ''), (1, ' 1', 'Suite'), (1, ' 2', '-----'), (2, '', ''), (2, ' 1', 'Metrics'), (2, ' 2', '-------')) s(n, o, t)"""
_EXECUTION = {
    "input_tokens": "printf('%.4f', input_tokens)", "output_tokens": "printf('%.4f', output_tokens)", "token_total": "printf('%.4f', token_total)",
    "elapsed_seconds": "printf('%.4f', elapsed_seconds)", "records_per_second": "printf('%.4f', n_input_records / nullif(elapsed_seconds, 0))",
    "max_concurrency": "'4'", "batch_size": "'8'", "n_api_batches": "n_api_batches::varchar", "n_input_records": "n_input_records::varchar",
    "n_prompts_captured": "n_prompts_captured::varchar", "prompt_templates_count": "prompt_templates_count::varchar", "prompt_modes": "prompt_modes",
    "prompt_capture": f"'{k.PROMPT_CAPTURE}'", "prompt_data_policy": f"'{k.PROMPT_POLICY}'",
    "prompt_templates": "prompt_templates_count || ' redacted template(s)'",
}
_EXECUTION_LINES = f"{_SUMMARY} " + " union all ".join(
    [f"select run_id, 3 as section, '{o}' as ord, '{t}' as line from s" for o, t in (("", ""), (" 1", "Execution"), (" 2", "-" * 9))]
    + [f"select run_id, 3, '{name}', '  {name}: ' || coalesce({text}, 'None') from s" for name, text in _EXECUTION.items()]
)


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report; its metrics are rounded as the check rounds them."""
    e = with_prompts(spark, sf)
    table = run_table(e)
    scores = rounded(m.score_runs(e), "value").withColumn("value", F.floor(F.col("value") * 1e4 + 0.5) / 1e4)
    return runs.report_lines(scores, runs.execution_summary(e, table), _suite(e), table)


@register("report_metric_lines", _METRIC_LINES)
def _(spark, sf):
    return _report(spark, sf).filter("section <> 3")


@register("report_lines", f"select * from ({_METRIC_LINES}) a union all select * from ({_EXECUTION_LINES}) b")
def _(spark, sf):
    return _report(spark, sf)


def _documents(spark, sf):
    e = with_prompts(spark, sf)
    table = run_table(e).withColumn("suite", F.to_json(F.struct("task", "batch_size")))
    return e, m.score_runs(e), runs.execution_summary(e, table), table


def one_sided(spark: SparkSession, sf: str) -> documents.SavedRuns:
    """Full documents written and read back: run_4 is not listed, run_2 and run_9 have no rows."""
    every = with_prompts(spark, sf)
    table = run_table(every).withColumn("suite", F.to_json(F.struct("task", "batch_size")))
    extra = table.filter("run_id = 'run_2'").withColumn("run_id", F.lit("run_9"))
    table = cut_lineage(table.filter("run_id <> 'run_4'").unionByName(extra))
    e = every.filter("run_id <> 'run_2'")
    pieces = documents.full_documents(m.score_runs(e), runs.execution_summary(e, table), table, e, runs.prompt_templates(e))
    path = fresh_path(spark, "run-documents")
    documents.write_documents(pieces, path)
    return documents.read_full_documents(spark, path)


_TOTAL = "case when input_tokens is null and output_tokens is null then null else coalesce(input_tokens, 0) + coalesce(output_tokens, 0) end"
_PROMPT = """case when case_id % 5 = 0 then '[]' else '[{"role":"system","content":"prompt ' || case_id % 2 || '"}]' end"""


@register(
    "full_run_documents",
    f"""{EV} select run_id, case_id, task, ckd_stage, ground_truth, prediction, abstained, confidence, should_abstain, null::varchar as raw_response,
     {_PROMPT} as prompt, prompt_mode, input_tokens, output_tokens, {_TOTAL} as total_tokens from f where run_id <> 'run_2'""",
)
def _(spark, sf):
    """All rows of all documents, as they come back."""
    return one_sided(spark, sf).rows.withColumn("prompt", F.to_json("prompt"))


@register(
    "run_document_heads",
    f"""{EV}, n as (select run_id, count(*) as n from f group by run_id), g as (select distinct run_id, model, task from f where run_id <> 'run_4'),
     l as (select * from g union all select 'run_9', model, task from g where run_id = 'run_2')
     select coalesce(l.run_id, n.run_id) as run_id, coalesce(l.model, '') as backend_name, case when l.task is null then '{{}}' else '{{"batch_size":8,"task":"' || l.task || '"}}' end as suite,
      coalesce(n.n, 0) as n_evaluation_results from l full join (select * from n where run_id <> 'run_2') n on n.run_id = l.run_id""",
)
def _(spark, sf):
    """Every run that is listed or has rows has a document."""
    return one_sided(spark, sf).heads


@register("run_document_scores", f"select * from ({_BUNDLE}) x where run_id <> 'run_2'")
def _(spark, sf):
    scores = one_sided(spark, sf).scores
    return scores.select("run_id", "metric", r9("value").alias("value"), "n_evaluated", "n_abstained", "reason")


@register(
    "run_document_templates",
    f"""{EV} select distinct run_id, case when prompt_mode = '' then 'unknown' else prompt_mode end as prompt_mode, {_PROMPT} as prompt
     from f where case_id % 5 <> 0 and run_id <> 'run_2'""",
)
def _(spark, sf):
    return one_sided(spark, sf).templates.withColumn("prompt", F.to_json("prompt"))


@register(
    "metric_documents",
    f"""select coalesce(x.run_id, y.run_id) as run_id, metric, value, n_evaluated, n_abstained, reason, n_input_records, batch_size
     from (select * from ({_BUNDLE}) b where run_id <> 'run_3') x
     full join ({EV} select run_id, count(*) as n_input_records, 8 as batch_size from f where run_id <> 'run_0' group by run_id) y on x.run_id = y.run_id""",
)
def _(spark, sf):
    """Metric documents written and read back; run_3 has no metrics and run_0 no execution."""
    _, scores, summary, _ = _documents(spark, sf)
    path = fresh_path(spark, "metric-documents")
    saved = documents.metric_documents(scores.filter("run_id <> 'run_3'"), summary.filter("run_id <> 'run_0'"))
    saved.select("run_id", "document").write.partitionBy("run_id").text(path)
    read = spark.read.schema(documents.DOCUMENT + ", run_id string").json(path)
    named = read.withColumns({"task": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "repeat": F.lit(1)})
    rows = documents.document_scores(named).drop("task", "model", "repeat", "details", "breakdown")
    execution = documents.document_execution(named).select("run_id", "n_input_records", "batch_size")
    joined = execution.join(rows, "run_id", "left")
    return joined.select(
        "run_id", "metric", r9("value").alias("value"), "n_evaluated", "n_abstained", "reason", "n_input_records", "batch_size"
    )


@register("saved_run_scores", _BUNDLE)
def _(spark, sf):
    """Write metric documents to files named by task and model, and read them back."""
    _, scores, summary, table = _documents(spark, sf)
    path = fresh_path(spark, "saved-runs")
    saved = documents.metric_documents(scores, summary)
    saved.select("run_id", "document").write.partitionBy("run_id").text(path)
    read = (
        spark.read.schema(documents.DOCUMENT + ", run_id string").json(path)
        .withColumns({"task": F.lit(None).cast("string"), "model": F.lit(None).cast("string"), "repeat": F.lit(1)})
    )
    rows = documents.document_scores(read)
    return rows.select(
        "run_id", "metric", r9("value").alias("value"), "n_evaluated", "n_abstained", "reason"
    )


@register(
    "json_safe_values",
    f"""with a as ({d.KEYS}) select k, cast(case when k % 5 = 0 then 'x' when k % 5 = 1 then 'y' else 'z' end as varchar) as name,
    case when k % 7 in (1, 2, 3) then null else k / 4 end as value from a""",
)
def _(spark, sf):
    value = (
        F.when(F.col("k") % 7 == 1, float("nan")).when(F.col("k") % 7 == 2, float("inf"))
        .when(F.col("k") % 7 == 3, float("-inf")).otherwise(F.col("k") / 4)
    )
    name = F.when(F.col("k") % 5 == 0, "x").when(F.col("k") % 5 == 1, "y").otherwise("z")
    mapped = orders(spark, sf).withColumn("m", documents.json_safe_map(F.create_map(name, value)))
    return mapped.select("k", F.explode("m").alias("name", "value"))


@register(
    "call_counts",
    f"""with a as ({d.KEYS}), b as (select 'run_' || cast((k // 8) % 5 as varchar) as run_id, k // 8 as b, count(*) as n, (k // 8) % 3 as bad from a group by all)
    select run_id, count(*) + sum(case when bad = 1 and n >= 2 then 2 when bad = 1 then 1 else 0 end)::bigint as calls, count(*) as planned_calls,
    sum(case when bad = 1 and n >= 2 then 2 else 0 end)::bigint as split_calls, sum(case when bad = 1 and n = 1 then 1 else 0 end)::bigint as single_calls,
    cast(max(case when bad = 1 then 1 else 0 end) as int) as last_round from b group by run_id""",
)
def _(spark, sf):
    from abstain_eval.operators.answers import next_round

    batch = F.floor(F.col("k") / 8).cast("bigint")
    cases = orders(spark, sf).select(
        F.concat(F.lit("run_"), (batch % 5).cast("string")).alias("run_id"), F.col("k").alias("case_id"),
        batch.alias("batch_id"), (F.col("k") % 8).cast("int").alias("slot"), F.lit(0).alias("round"), F.lit("batch").alias("mode"),
    )
    sizes = cases.groupBy("run_id", "batch_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    rejected = sizes.filter("batch_id % 3 = 1")
    planned = cases.join(sizes, ["run_id", "batch_id"])
    again = next_round(cases, rejected)
    columns = ["run_id", "round", "batch_id", "mode"]
    return runs.call_counts(planned.select(*columns).unionByName(again.select(*columns)))
