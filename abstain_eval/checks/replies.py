"""Request and answer queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abstain_eval import contracts as k
from abstain_eval.checks.common import Query, clinical, orders
from abstain_eval.functions.numbers import number_text
from abstain_eval.operators import answers as a
from abstain_eval.operators import requests as r
from abstain_eval.plans import derived as d
from abstain_eval.plans import evaluate
from abstain_eval.plans.run import evaluate_runs
from abstain_eval.session import fresh_path
from abstain_eval.sources import documents
from abstain_eval.sources.ledger import CallLedger

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def text(value: str) -> str:
    """A Python text as a SQL literal."""
    return "'" + value.replace("'", "''") + "'"


# --- prompts ----------------------------------------------------------------

CLINICAL = f"cl as ({d.CLINICAL_CASES})"
_LINES = {f: f"'- {f}: ' || cast({f} as varchar)" for f in k.REDUCED_FEATURES}
BULLETS = " || chr(10) || ".join(_LINES[f] for f in sorted(_LINES))


def records(spark: SparkSession, sf: str, task: str) -> DataFrame:
    cases = clinical(spark, sf)
    features = F.create_map(*[p for f in k.REDUCED_FEATURES for p in (F.lit(f), F.col(f))])
    earlier = F.create_map(F.lit("sc"), F.round(F.col("bu") / 2, 1), F.lit("al"), F.col("al"))
    current = F.create_map(F.lit("sc"), F.col("bu"), F.lit("al"), F.col("al") + 1)
    return cases.select(
        "case_id", "row_idx", F.lit(task).alias("task"), features.alias("features"),
        earlier.alias("baseline"), current.alias("current"), F.lit(6).alias("trajectory_months"),
        F.concat(F.lit("run_"), (F.floor(F.col("row_idx") / 40) % 6).cast("string")).alias("run_id"),
    )


@register("feature_lines", f"with {CLINICAL} select case_id, {BULLETS} as lines, {BULLETS} as lines_of_columns from cl")
def _(spark, sf):
    both = clinical(spark, sf).withColumn(
        "features", F.create_map(*[p for f in k.REDUCED_FEATURES for p in (F.lit(f), F.col(f))])
    )
    return both.select(
        "case_id", r.bullet_list("features").alias("lines"),
        r.bullet_list_of(k.REDUCED_FEATURES).alias("lines_of_columns"),
    )


@register(
    "number_texts",
    f"""with a as ({d.KEYS}), x as (select k, case k % 6 when 0 then k::double when 1 then (k + 1) / 8.0::double when 2 then (k % 97 + 1) / 100000.0::double
      when 3 then (k + 1) * 12345.5::double when 4 then (k + 1) * 1e17::double else (k % 89 + 1) / 1e9::double end as v from a)
    select k, cast(v as varchar) as shown from x""",
)
def _(spark, sf):
    j = F.col("k")
    v = (
        F.when(j % 6 == 0, j.cast("double")).when(j % 6 == 1, (j + 1) / F.lit(8.0))
        .when(j % 6 == 2, (j % 97 + 1) / F.lit(100000.0)).when(j % 6 == 3, (j + 1) * F.lit(12345.5))
        .when(j % 6 == 4, (j + 1) * F.lit(1e17)).otherwise((j % 89 + 1) / F.lit(1e9))
    )
    return orders(spark, sf).select("k", number_text(v).alias("shown"))


def _markers(task: str) -> str:
    return (
        f"with {CLINICAL} select case_id, {text(k.SYSTEM_TEXT[task])} as system_text, "
        f"{text(k.MARKERS_HEADING)} || chr(10) || {BULLETS} || chr(10) || chr(10) || {text(k.CLOSING_LINE)} as user_text from cl"
    )


def _message_texts(rows: DataFrame) -> DataFrame:
    return rows.select(
        "case_id", F.col("messages")[0]["content"].alias("system_text"),
        F.col("messages")[1]["content"].alias("user_text"),
    )


@register("detection_messages", _markers("detection"))
def _(spark, sf):
    return _message_texts(r.with_messages(records(spark, sf, "detection")))


@register("staging_messages", _markers("staging"))
def _(spark, sf):
    return _message_texts(r.with_messages(records(spark, sf, "staging")))


_VISITS = (
    f"{text(k.VISIT_INTERVAL)} || '6' || chr(10) || chr(10) || 'Baseline visit:' || chr(10) || '- al: ' || cast(al as varchar) || chr(10) || '- sc: ' || cast(bu / 2 as varchar)"
    " || chr(10) || chr(10) || 'Current visit:' || chr(10) || '- al: ' || cast(al + 1 as varchar) || chr(10) || '- sc: ' || cast(bu as varchar)"
    f" || chr(10) || chr(10) || {text(k.CLOSING_LINE)}"
)


@register(
    "progression_messages",
    f"with {CLINICAL} select case_id, {text(k.SYSTEM_TEXT['progression'])} as system_text, {_VISITS} as user_text from cl",
)
def _(spark, sf):
    return _message_texts(r.with_messages(records(spark, sf, "progression")))


@register(
    "messages_by_task",
    f"""with {CLINICAL} select case_id, case case_id % 3 when 0 then {text(k.SYSTEM_TEXT['detection'])} when 1 then {text(k.SYSTEM_TEXT['staging'])}
     else {text(k.SYSTEM_TEXT['progression'])} end as system_text,
     case when case_id % 3 = 2 then {_VISITS} else {text(k.MARKERS_HEADING)} || chr(10) || {BULLETS} || chr(10) || chr(10) || {text(k.CLOSING_LINE)} end as user_text from cl""",
)
def _(spark, sf):
    task = F.element_at(F.array(*[F.lit(t) for t in k.TASKS]), (F.col("case_id") % 3 + 1).cast("int"))
    return _message_texts(r.with_messages(records(spark, sf, "detection").withColumn("task", task)))


@register(
    "batch_assignment",
    f"with a as ({d.KEYS}) select k as case_id, k // 8 as batch_id, cast(k % 8 as int) as slot, 'case_' || cast(k % 8 as varchar) as case_ref from a",
)
def _(spark, sf):
    return r.assign_batches(records(spark, sf, "detection"), 8).select("case_id", "batch_id", "slot", "case_ref")


@register(
    "batch_messages",
    f"""with {CLINICAL}, b as (select case_id // 8 as batch_id, 'Case id: case_' || cast(case_id % 8 as varchar) || chr(10) || {text(k.MARKERS_HEADING)} || chr(10) || {BULLETS}
      || chr(10) || chr(10) || {text(k.CLOSING_LINE)} as block, case_id from cl)
    select 'run_' || cast((batch_id // 5) % 6 as varchar) as run_id, batch_id, cast(count(*) as int) as size, {text(k.SYSTEM_TEXT['detection'] + chr(10) + chr(10) + k.BATCH_RULES)} as system_text,
    {text(k.BATCH_OPENING)} || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by case_id) || chr(10) || chr(10) || {text(k.BATCH_CLOSING_LINE)} as user_text,
    string_agg(cast(case_id as varchar), ',' order by case_id) as case_ids from b group by batch_id""",
)
def _(spark, sf):
    built = r.build_batches(r.assign_batches(records(spark, sf, "detection"), 8))
    return built.select(
        "run_id", "batch_id", "size", F.col("messages")[0]["content"].alias("system_text"),
        F.col("messages")[1]["content"].alias("user_text"), F.array_join("case_ids", ",").alias("case_ids"),
    )


@register("request_payloads")
def _(spark, sf):
    built = r.build_batches(r.assign_batches(records(spark, sf, "staging"), 8))
    bodies = r.payloads(built, "some-model", temperature=0.0, max_tokens=128, reasoning_effort="low")
    return bodies.select("run_id", "batch_id", "body")


@register(
    "payload_fields",
    f"""with a as ({d.KEYS}) select k // 8 as batch_id, 'some-model' as model, cast(0.5 as double) as temperature, count(*) * 128 as max_tokens,
    'low' as effort, true as exclude, 'case_staging_batch_answer' as schema_name, cast(2 as int) as n_messages from a group by 1""",
)
def _(spark, sf):
    built = r.build_batches(r.assign_batches(records(spark, sf, "staging"), 8))
    bodies = r.payloads(built, "some-model", temperature=0.5, max_tokens=128, reasoning_effort="low")
    read = F.from_json(
        "body",
        "model string, temperature double, max_tokens bigint, extra_body struct<reasoning:struct<effort:string,exclude:boolean>>, "
        "response_format struct<json_schema:struct<name:string>>, messages array<struct<role:string>>",
    )
    b = bodies.select("batch_id", read.alias("b"))
    return b.select(
        "batch_id", "b.model", "b.temperature", "b.max_tokens", "b.extra_body.reasoning.effort",
        "b.extra_body.reasoning.exclude", F.col("b.response_format.json_schema.name").alias("schema_name"),
        F.size("b.messages").alias("n_messages"),
    )


@register("request_file", f"with a as ({d.KEYS}) select 'run_' || cast((k // 40) % 6 as varchar) || '-' || cast(k // 8 as varchar) as custom_id from a group by all")
def _(spark, sf):
    """Write the request file and read its ids back."""
    built = r.build_batches(r.assign_batches(records(spark, sf, "detection"), 8))
    path = fresh_path(spark, "request-file")
    documents.write_request_file(r.payloads(built, "some-model"), path)
    return spark.read.schema("custom_id string").json(path)


@register(
    "answer_schema_of_rows",
    f"with a as ({d.KEYS}) select k, {text(json.dumps(r.answer_schema('progression', 'batch')))} as answer_schema from a",
)
def _(spark, sf):
    return orders(spark, sf).select("k", r.schema_text(F.lit("progression"), F.lit("batch")).alias("answer_schema"))


_SHAPES = """
select k, case k % 5 when 0 then '@OPENING@' || cast(k as string)
 when 1 then concat('Patient markers:', chr(10), '- x: ', cast(k as string)) when 2 then 'a Baseline visit: x Current visit: y'
 when 3 then 'Patient markers: same line' else 'free text' end as content,
 case when k % 11 = 0 then 'system' else 'user' end as role from (select o_orderkey as k from orders) a
""".replace("@OPENING@", k.BATCH_OPENING)


@register(
    "redacted_messages",
    f"""with s as ({_SHAPES}) select k, role, case when role <> 'user' then content when k % 5 = 0 then {text(k.REDACTED_BATCH)} when k % 5 = 1 then {text(k.REDACTED_MARKERS)}
     when k % 5 = 2 then {text(k.REDACTED_VISITS)} else {text(k.REDACTED_OTHER)} end as content from s""",
)
def _(spark, sf):
    shapes = d.derive(spark, sf, _SHAPES).withColumn("m", r.redact(F.array(F.struct("role", "content"))))
    return shapes.select("k", F.col("m")[0]["role"].alias("role"), F.col("m")[0]["content"].alias("content"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Message array per conversation; a conversation is a handful of turns."""
    turns = d.read_table(spark, sf, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    grouped = turns.groupBy("conv_id").agg(ordered.alias("t"))
    return grouped.select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    )


_CONV = """with t as (select *, row_number() over (partition by conv_id order by turn, role, text) as place from conversations)"""


@register(
    "redacted_conversations",
    f"""{_CONV} select conv_id, cast(place as int) as place, role, case when role = 'user' then {text(k.REDACTED_OTHER)} else text end as content from t""",
)
def _(spark, sf):
    redacted = conversations(spark, sf).select("conv_id", F.posexplode(r.redact("messages")).alias("p", "m"))
    return redacted.select("conv_id", (F.col("p") + 1).alias("place"), "m.role", "m.content")


@register(
    "plain_prompts",
    f"{_CONV} select conv_id, string_agg(upper(role) || ':' || chr(10) || text, chr(10) || chr(10) order by place) || chr(10) || chr(10) || 'ASSISTANT:' || chr(10) as prompt from t group by conv_id",
)
def _(spark, sf):
    return conversations(spark, sf).select("conv_id", r.plain_prompt("messages").alias("prompt"))


@register(
    "folded_system_turns",
    f"""{_CONV}, s as (select conv_id, string_agg(text, chr(10) || chr(10) order by place) as sys from t where role = 'system' group by conv_id),
    n as (select *, row_number() over (partition by conv_id order by place) as p from t where role <> 'system'),
    h as (select s.conv_id, s.sys, coalesce(n.role, '') = 'user' as joins from s left join n on n.conv_id = s.conv_id and n.p = 1)
    select n.conv_id, cast(n.p - 1 + case when h.sys is not null and not h.joins then 1 else 0 end as int) as place, n.role,
      case when n.p = 1 and h.joins then h.sys || chr(10) || chr(10) || n.text else n.text end as content from n left join h using (conv_id)
    union all select conv_id, 0, 'user', sys from h where not joins""",
)
def _(spark, sf):
    folded = conversations(spark, sf).select("conv_id", F.posexplode(r.fold_system("messages")).alias("place", "m"))
    return folded.select("conv_id", "place", "m.role", "m.content")


# --- single answers -----------------------------------------------------------

_PRED = "case when k % 8 in (0, 1, 2, 5) then cast(k % 2 as varchar) end"
_ABST = "k % 8 in (3, 4, 5, 6)"
_CONF = "case k % 8 when 0 then (10 + k % 90)::double / 100::double when 1 then least(k % 3, 1)::double when 3 then 0.2::double end"
_PATH = "case when k % 8 in (0, 1, 2, 3, 5) then 'json' when k % 8 in (4, 6) then 'phrase' else 'none' end"


@register(
    "parsed_answers",
    f"""with a as ({d.KEYS}) select 'run_' || cast(k % 6 as varchar) as run_id, k as case_id, {_PRED} as prediction, {_ABST} as abstained, {_CONF} as confidence, {_PATH} as parse_path from a""",
)
def _(spark, sf):
    parsed = a.parse_answers(d.derive(spark, sf, d.RESPONSES))
    return parsed.select("run_id", "case_id", "prediction", "abstained", "confidence", "parse_path")


@register(
    "answer_json_text",
    f"""with x as ({d.RESPONSES}) select case_id, case case_id % 8 when 1 then trim(replace(replace(raw_response, '```json', ''), '```', ''), chr(10))
     when 2 then '{{"prediction": ' || cast(case_id % 2 as varchar) || ', "abstained": false}}' when 4 then null when 7 then null else raw_response end as blob from x""",
)
def _(spark, sf):
    found = a.with_json_text(d.derive(spark, sf, d.RESPONSES), "raw_response")
    return found.select("case_id", F.col("_blob").alias("blob"))


_CONFS = """
select k, case k % 12 when 0 then '0.25' when 1 then '-3' when 2 then '7' when 3 then '"0.5"' when 4 then '" 1e-1 "' when 5 then '"high"'
 when 6 then 'null' when 7 then 'true' when 8 then '[1]' when 9 then '"NaN"' when 10 then '"1.0f"' else cast(k % 100 as string) || 'e-2' end as c
from (select o_orderkey as k from orders) a
"""


@register(
    "answer_confidence",
    f"""with c as ({_CONFS}) select k, case k % 12 when 0 then 0.25 when 1 then 0 when 2 then 1 when 3 then 0.5 when 4 then 0.1 when 7 then 1 when 9 then 'NaN'::double
     when 11 then (k % 100)::double / 100::double end::double as confidence from c""",
)
def _(spark, sf):
    raw = d.derive(spark, sf, _CONFS).select(
        "k", F.lit("detection").alias("task"),
        F.concat(F.lit('{"confidence":'), F.col("c"), F.lit(',"prediction":1}')).alias("raw_response"),
    )
    return a.parse_answers(raw).select("k", "confidence")


_PREDS = """
select k, case k % 12 when 0 then '1' when 1 then '0.7' when 2 then 'true' when 3 then '"2"' when 4 then '" 03 "' when 5 then '"Stable"'
 when 6 then 'null' when 7 then '"null"' when 8 then '"1.0"' when 9 then '-1.5' when 10 then '"+4"' else cast(k as string) end as p
from (select o_orderkey as k from orders) a
"""


@register(
    "answer_prediction",
    f"""with p as ({_PREDS})
    select k, 'detection' as task, case k % 12 when 0 then '1' when 1 then '0' when 2 then '1' when 3 then '2' when 4 then '3' when 9 then '-1' when 10 then '4' when 11 then cast(k as varchar) end as prediction,
      k % 12 in (5, 8) as failed from p
    union all select k, 'progression', case k % 12 when 0 then '1' when 1 then '0' when 2 then 'true' when 3 then '2' when 4 then '3' when 5 then 'stable' when 8 then '1.0' when 9 then '-1' when 10 then '+4'
      when 11 then cast(k as varchar) end, false from p""",
)
def _(spark, sf):
    tasks = F.explode(F.array(F.lit("detection"), F.lit("progression")))
    raw = d.derive(spark, sf, _PREDS).select(
        "k", tasks.alias("task"), F.concat(F.lit('{"prediction":'), F.col("p"), F.lit("}")).alias("raw_response")
    )
    parsed = a.parse_answers(raw)
    return parsed.select("k", "task", "prediction", F.col("parse_error").isNotNull().alias("failed"))


@register("quarantined_answers", f"with a as ({d.KEYS}) select k as case_id, 'no_readable_answer' as reason from a where k % 8 = 7")
def _(spark, sf):
    _, bad = a.apply_malformed_policy(a.parse_answers(d.derive(spark, sf, d.RESPONSES)), "error")
    return bad.select("case_id", F.col("malformed").alias("reason"))


@register(
    "malformed_as_abstained",
    f"with a as ({d.KEYS}) select k as case_id, {_PRED} as prediction, {_ABST} or k % 8 = 7 as abstained, {_CONF} as confidence from a",
)
def _(spark, sf):
    kept, _ = a.apply_malformed_policy(a.parse_answers(d.derive(spark, sf, d.RESPONSES)), "abstain")
    return kept.select("case_id", "prediction", "abstained", "confidence")


# --- batches ----------------------------------------------------------------

_B = "with o as (select distinct o_orderkey // 4 as b from orders), i as (select b, s, b * 4 + s as key from o, range(4) t(s) where b % 6 <> 4)"


@register(
    "batch_answers",
    f"""{_B} select 'run_' || cast(b % 6 as varchar) as run_id, b as batch_id, cast(s as int) as slot, case when key % 7 <> 0 then cast(key % 2 as varchar) end as prediction,
    key % 7 = 0 as abstained, (10 + key % 90)::double / 100::double as confidence from i""",
)
def _(spark, sf):
    good, _ = a.parse_batches(d.derive_batches(spark, sf))
    return good.select("run_id", "batch_id", "slot", "prediction", "abstained", "confidence")


@register(
    "batch_verdicts",
    """with o as (select distinct o_orderkey // 4 as b from orders) select 'run_' || cast(b % 6 as varchar) as run_id, b as batch_id, case when b % 6 = 4 then 'missing_ids' end as reason,
    case when b % 6 = 4 then 'case_2' end as missing from o""",
)
def _(spark, sf):
    read = a.read_batches(d.derive_batches(spark, sf))
    missing = F.array_join("missing_ids", ",")
    return read.select("run_id", "batch_id", "reason", F.when(missing != "", missing).alias("missing"))


_BROKEN = """
select k, case k % 9 when 0 then 'no json here' when 1 then '{"results": 5}' when 2 then '{"results":[{"id":"case_0","prediction":1}' when 3 then ''
 when 4 then '{"results":[{"id":"case_0","prediction":"x"}]}' when 5 then '[{"id":"case_0"}]' when 6 then '{"results":["a",{"id":"case_0","prediction":"1"},7]}'
 when 7 then '{"results":[{"id":"case_0","prediction":1,}{"id":"case_1"},]}' else '{"results":[]}' end as raw_response, cast(1 as int) as size, 'detection' as task
from (select o_orderkey as k from orders) a
"""


@register(
    "batch_failure_reasons",
    f"""with x as ({_BROKEN}) select k, case k % 9 when 0 then 'no_json' when 1 then 'no_results' when 2 then 'malformed_json' when 3 then 'empty_response' when 4 then 'prediction_not_an_integer'
     when 5 then 'no_results' when 8 then 'missing_ids' end as reason from x""",
)
def _(spark, sf):
    return a.read_batches(d.derive(spark, sf, _BROKEN)).select("k", "reason")


@register(
    "repaired_json",
    f"""with a as ({d.KEYS}) select k, case when k % 5 <> 4 then k end as first, case when k % 5 <> 4 then k + 1 end as second from a""",
)
def _(spark, sf):
    n, m_ = F.col("k").cast("string"), (F.col("k") + 1).cast("string")
    one, two = F.concat(F.lit('{"v":'), n, F.lit("}")), F.concat(F.lit('{"v":'), m_, F.lit("}"))
    blob = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit('{"r":['), one, F.lit(","), two, F.lit("]}")))
        .when(F.col("k") % 5 == 1, F.concat(F.lit('{"r":['), one, F.lit(" \n"), two, F.lit("]}")))
        .when(F.col("k") % 5 == 2, F.concat(F.lit('{"r":['), one, F.lit(","), two, F.lit(", ],}")))
        .when(F.col("k") % 5 == 3, F.concat(F.lit('{"r":['), one, two, F.lit(",]}")))
        .otherwise(F.concat(F.lit('{"r":['), one, two))
    )
    read = orders(spark, sf).withColumn("blob", blob).withColumn("doc", a.repaired_json("blob"))
    return read.select(
        "k", F.try_variant_get("doc", "$.r[0].v", "bigint").alias("first"),
        F.try_variant_get("doc", "$.r[1].v", "bigint").alias("second"),
    )


@register(
    "split_plan",
    f"""with a as ({d.KEYS}), b as (select k, k // 5 as b, k % 5 as slot, count(*) over (partition by k // 5) as n from a), f as (select * from b where b % 4 = 1 or n = 1)
    select k as case_id, 'run_' || cast(b % 6 as varchar) as run_id, b * 2 + case when n > 1 and slot >= n // 2 then 1 else 0 end as batch_id,
    cast(case when n = 1 then 0 when slot >= n // 2 then slot - n // 2 else slot end as int) as slot,
    cast(case when n = 1 then 1 when slot >= n // 2 then n - n // 2 else n // 2 end as int) as size, cast(1 as int) as round,
    case when n = 1 then 'single' else 'batch' end as mode from f""",
)
def _(spark, sf):
    batch = F.floor(F.col("k") / 5).cast("bigint")
    cases = orders(spark, sf).select(
        F.col("k").alias("case_id"), F.concat(F.lit("run_"), (batch % 6).cast("string")).alias("run_id"),
        batch.alias("batch_id"), (F.col("k") % 5).cast("int").alias("slot"), F.lit(0).alias("round"), F.lit("batch").alias("mode"),
    )
    sizes = cases.groupBy("run_id", "batch_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    return a.next_round(cases, sizes.filter("batch_id % 4 = 1 or size = 1"))


_USAGE = """with o as (select distinct o_orderkey // 4 as b from orders), u as (select b, case when b % 5 <> 4 then (400 + b % 50)::double end as i, case when b % 5 < 3 then (40 + b % 9)::double end as o from o)"""


@register(
    "answer_tokens",
    f"{_USAGE} select b as batch_id, i as input_tokens, o as output_tokens, case when i is not null or o is not null then coalesce(i, 0) + coalesce(o, 0) end as total_tokens from u",
)
def _(spark, sf):
    used = a.with_usage(d.derive_batches(spark, sf))
    return used.select("batch_id", "input_tokens", "output_tokens", "total_tokens")


@register(
    "tokens_per_case",
    f"{_USAGE} select b as batch_id, cast(s as int) as slot, i / 4 as input_tokens, o / 4 as output_tokens, case when i is not null or o is not null then (coalesce(i, 0) + coalesce(o, 0)) / 4 end as total_tokens from u, range(4) t(s) where b % 6 <> 4",
)
def _(spark, sf):
    used = a.with_usage(d.derive_batches(spark, sf))
    good, _ = a.parse_batches(used)
    return a.spread_usage(good).select("batch_id", "slot", "input_tokens", "output_tokens", "total_tokens")


def _asked(spark, sf):
    """Requests for the derived batch answers: four cases each."""
    cases = records(spark, sf, "detection").withColumn("_b", F.floor(F.col("row_idx") / 4))
    named = cases.withColumn("run_id", F.concat(F.lit("run_"), (F.col("_b") % 6).cast("string"))).drop("_b")
    return r.assign_batches(named, 4)


@register(
    "answers_with_prompts",
    f"""{_B} select b as batch_id, cast(s as int) as slot, 'batch' as prompt_mode, {text(k.REDACTED_BATCH)} as user_text from i""",
)
def _(spark, sf):
    good, _ = a.parse_batches(d.derive_batches(spark, sf))
    rows = a.attach_prompts(good.select("run_id", "batch_id", "slot"), r.build_batches(_asked(spark, sf)))
    return rows.select("batch_id", "slot", "prompt_mode", F.col("prompt")[1]["content"].alias("user_text"))


@register(
    "evaluation_rows",
    f"""{_B} select 'run_' || cast(b % 6 as varchar) as run_id, key as case_id, case when key % 7 <> 0 then cast(key % 2 as varchar) end as prediction, key % 7 = 0 as abstained,
    cast(key % 3 as varchar) as ground_truth, cast(key % 5 as int) as ckd_stage, key % 4 = 0 as should_abstain from i""",
)
def _(spark, sf):
    asked = _asked(spark, sf)
    key = F.col("case_id")
    facts = asked.withColumn("label", (key % 3).cast("string")).withColumn(
        "metadata", F.struct((key % 5).cast("int").alias("ckd_stage"), (key % 4 == 0).alias("should_abstain"))
    )
    good, _ = a.parse_batches(d.derive_batches(spark, sf))
    placed = good.join(asked.select("run_id", "batch_id", "slot", "case_id"), ["run_id", "batch_id", "slot"])
    rows = a.evaluation_rows(placed, facts)
    return rows.select("run_id", "case_id", "prediction", "abstained", "ground_truth", "ckd_stage", "should_abstain")


_ERRORS = """
select k, case k % 6 when 0 then 429 when 1 then 401 when 2 then 503 when 3 then 400 else null end as status,
 case k % 6 when 4 then 'APITimeoutError' when 5 then 'ValueError' else 'APIStatusError' end as error_name, cast(k % 4 as int) as attempt
from (select o_orderkey as k from orders) a
"""


@register(
    "call_errors",
    """with a as (select o_orderkey as k from orders), x as (select k, k % 6 in (0, 2, 4) as retryable, cast(k % 4 as int) as attempt from a)
    select k, retryable, retryable and attempt < 3 as will_retry, case when retryable and attempt < 3 then least(5.0::double, 1.5::double * pow(2, attempt)) end as next_delay from x""",
)
def _(spark, sf):
    errors = d.derive(spark, sf, _ERRORS)
    return a.classify_errors(errors, 3, 1.5, 5.0).select("k", "retryable", "will_retry", "next_delay")


@register(
    "call_times",
    """with b as (select distinct 'run_' || cast((o_orderkey // 8) % 5 as varchar) as run_id, o_orderkey // 8 as batch_id from orders),
     p as (select *, case when batch_id % 3 = 0 then 'one' else 'other' end as provider from b)
     select run_id, batch_id, provider, greatest(100.0::double + (row_number() over (partition by provider order by batch_id, run_id) - 1) / 4.0::double,
      case when batch_id % 7 = 0 then 130.0::double + batch_id % 5 else 0 end) as due_at from p""",
)
def _(spark, sf):
    """Four calls a second and provider from second 100 on; repeats wait for their time."""
    batch = F.floor(F.col("k") / 8).cast("bigint")
    asked = orders(spark, sf).select(F.concat(F.lit("run_"), (batch % 5).cast("string")).alias("run_id"), batch.alias("batch_id")).distinct()
    named = asked.withColumns(
        {
            "provider": F.when(F.col("batch_id") % 3 == 0, "one").otherwise("other"),
            "not_before": F.when(F.col("batch_id") % 7 == 0, 130.0 + F.col("batch_id") % 5),
        }
    )
    return r.call_times(named, 100.0, 4.0, "provider").select("run_id", "batch_id", "provider", "due_at")


@register(
    "empty_answers",
    f"""with a as ({d.KEYS}) select k, 'empty_response' as reason, 'svc sent no text in its ' || case when k % 2 = 0 then 'batch answer. Raise max_tokens or use smaller batches' else 'answer. Raise max_tokens' end
     || case when k % 3 = 0 then ' (finish_reason=length)' else '' end || '.' as message from a where k % 4 < 3""",
)
def _(spark, sf):
    j = F.col("k")
    replies = orders(spark, sf).select(
        "k", F.when(j % 2 == 0, "batch").otherwise("single").alias("mode"), F.when(j % 3 == 0, "length").alias("finish_reason"),
        F.when(j % 4 == 0, "").when(j % 4 == 1, " \n").when(j % 4 == 2, None).otherwise("{}").alias("raw_response"),
    )
    return a.empty_answers(replies, "svc").select("k", "reason", "message")


def parity_reply():
    """Stand-in for a model: answers the parity of the case id, and fails on some batches.

    A nested function travels to the workers by value.
    """

    def reply(request):
        import json

        ids = [int(i) for i in request.case_ids]
        if request.mode == "batch" and request.size > 1 and ids[0] % 24 == 0:
            text = "cannot produce json"
        elif request.mode == "batch":
            items = []
            for i, case in enumerate(ids):
                unsure = case % 5 == 0
                label = None if unsure else case % 2
                items.append({"id": f"case_{i}", "abstained": unsure, "confidence": 0.75, "prediction": label})
            text = json.dumps({"results": items})
        else:
            text = json.dumps({"abstained": False, "confidence": 0.5, "prediction": ids[0] % 2})
        usage = json.dumps({"usage": {"prompt_tokens": 10 * int(request.size)}})
        return {"raw_response": text, "finish_reason": "stop", "usage": usage, "provider": "openai"}

    return reply


def parity_model():
    return r.each_request(parity_reply())


@register(
    "evaluation_rounds",
    f"""with a as ({d.KEYS}) select 'run_' || cast((k // 40) % 6 as varchar) as run_id, k as case_id, case when k % 5 <> 0 then cast(k % 2 as varchar) end as prediction, k % 5 = 0 as abstained,
     0.75::double as confidence, 10.0::double as input_tokens, cast(k % 2 as varchar) as ground_truth from a""",
)
def _(spark, sf):
    """Whole loop with a stand-in model: failed batches are halved until they answer."""
    key = F.col("case_id")
    cases = records(spark, sf, "detection").withColumn("label", (key % 2).cast("string")).withColumn(
        "metadata", F.struct(F.lit(1).alias("ckd_stage"), F.lit(False).alias("should_abstain"))
    )
    done = evaluate.run_rounds(cases, parity_model(), 8)
    return done.evaluations.select(
        "run_id", "case_id", "prediction", "abstained", "confidence", "input_tokens", "ground_truth"
    )


def gapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with holes in row_idx; one run holds most of them."""
    key = F.col("case_id")
    run = F.when(key % 10 < 7, "run_big").otherwise(F.concat(F.lit("run_"), (key % 3).cast("string")))
    facts = F.struct(F.lit(1).alias("ckd_stage"), F.lit(False).alias("should_abstain"))
    kept = records(spark, sf_dir, "detection").filter((key % 3 != 1) & (key % 11 != 5))
    return kept.withColumns({"run_id": run, "label": (key % 2).cast("string"), "metadata": facts})


GAPPED = f"""a as (select k, case when k % 10 < 7 then 'run_big' else 'run_' || cast(k % 3 as varchar) end as run_id
 from ({d.KEYS}) where k % 3 <> 1 and k % 11 <> 5),
 b as (select *, (row_number() over (partition by run_id order by k) - 1) // 8 as batch from a)"""


def outcomes(done: evaluate.Evaluated) -> DataFrame:
    """Every record's end: an evaluation or a row of quarantine."""
    kept = done.evaluations.select("run_id", "case_id", "prediction", "abstained", F.lit(None).cast("string").alias("reason"))
    lost = done.quarantine.select("run_id", "case_id", F.lit(None).cast("string").alias("prediction"), F.lit(None).cast("boolean").alias("abstained"), "reason")
    return kept.unionByName(lost)


def unreliable_model():
    """Leaves requests unanswered that hold a case divisible by 17."""
    known = parity_reply()

    def reply(request):
        return None if any(int(c) % 17 == 0 for c in request.case_ids) else known(request)

    return r.each_request(reply)


def failing_model():
    """Raises at the first attempt of some requests, and always where a case is divisible by 19."""
    known = parity_reply()

    def reply(request):
        ids = [int(c) for c in request.case_ids]
        if any(i % 19 == 0 for i in ids):
            raise ValueError("refused")
        if request.attempt == 0 and ids[0] % 4 == 0:
            raise ConnectionError("lost")
        return known(request)

    return r.each_request(reply)


_PARITY = "case when k % 5 <> 0 then cast(k % 2 as varchar) end as prediction, k % 5 = 0 as abstained"


@register("evaluation_rounds_with_gaps", f"with {GAPPED} select run_id, k as case_id, {_PARITY}, null::varchar as reason from b")
def _(spark, sf):
    return outcomes(evaluate.run_rounds(gapped_records(spark, sf), parity_model(), 8))


@register(
    "evaluation_rounds_lost_replies",
    f"""with {GAPPED}, x as (select *, k % 17 = 0 as lost from b) select run_id, k as case_id, case when not lost and k % 5 <> 0 then cast(k % 2 as varchar) end as prediction,
     case when not lost then k % 5 = 0 end as abstained, case when lost then 'no_reply' end as reason from x""",
)
def _(spark, sf):
    return outcomes(evaluate.run_rounds(gapped_records(spark, sf), unreliable_model(), 8))


@register(
    "evaluation_rounds_failed_calls",
    f"""with {GAPPED}, n as (select *, row_number() over (partition by run_id, batch order by k) - 1 as place, count(*) over (partition by run_id, batch) as size from b),
     x as (select *, bool_or(k % 19 = 0) over (partition by run_id, batch) as lost from n)
     select run_id, k as case_id, case when not lost and k % 5 <> 0 then cast(k % 2 as varchar) end as prediction,
     case when not lost then k % 5 = 0 end as abstained, case when lost then 'call_failed:ValueError' end as reason from x""",
)
def _(spark, sf):
    return outcomes(evaluate.run_rounds(gapped_records(spark, sf), failing_model(), 8))


LOST = f"""{GAPPED}, x as (select *, k % 17 = 0 as lost from b)"""
_LOST_ROWS = """select run_id, k as case_id, case when not lost and k % 5 <> 0 then cast(k % 2 as varchar) end as prediction,
     case when not lost then k % 5 = 0 end as abstained, case when lost then 'no_reply' end as reason from x"""


def resumed(spark: SparkSession, sf_dir: str) -> tuple[evaluate.Evaluated, CallLedger]:
    """A job that ends after its first round, and one that is started again with its ledger."""
    ledger = CallLedger(fresh_path(spark, "ledger"))
    held = gapped_records(spark, sf_dir)
    evaluate.run_rounds(held, unreliable_model(), 8, ledger=ledger, pause_after=1)
    return evaluate.run_rounds(held, unreliable_model(), 8, ledger=ledger), ledger


@register("evaluation_rounds_resumed", f"with {LOST} {_LOST_ROWS}")
def _(spark, sf):
    return outcomes(resumed(spark, sf)[0])


@register(
    "resumed_calls",
    f"""with recursive {LOST}, n as (select *, row_number() over (partition by run_id order by k) - 1 as place from x),
     t(run_id, lo, size, round, mode) as (
      select run_id, min(place), count(*), 0, 'batch' from n group by run_id, batch
      union all
      select t.run_id, t.lo + case when side = 1 then t.size // 2 else 0 end,
       case when t.size = 1 then 1 when side = 1 then t.size - t.size // 2 else t.size // 2 end, t.round + 1,
       case when t.size = 1 then 'single' else 'batch' end
      from t join (values (0), (1)) s(side) on t.mode = 'batch' and (t.size > 1 or side = 0)
      where exists (select 1 from n where n.run_id = t.run_id and n.place >= t.lo and n.place < t.lo + t.size
       and (n.lost or t.size > 1 and n.place = t.lo and n.k % 24 = 0)))
     select cast(case when round = 0 then 1 else 2 end as int) as job, run_id, cast(round as int) as round, mode, count(*) as calls,
      cast(sum(size) as bigint) as cases from t group by all""",
)
def _(spark, sf):
    """What each job asked: the second one nothing of the round that the first one paid for."""
    _, ledger = resumed(spark, sf)
    entries = ledger.entries(spark)
    first = entries.groupBy("job").agg(F.min("asked_at").alias("began"))
    # One row for each job.
    numbered = first.select("job", F.row_number().over(Window.orderBy("began")).alias("number"))
    asked = entries.join(F.broadcast(numbered), "job").groupBy(F.col("number").alias("job"), "run_id", "round", "mode")
    return asked.agg(F.count(F.lit(1)).alias("calls"), F.sum("size").alias("cases"))


@register(
    "evaluation_rounds_bad_keys",
    f"""with {GAPPED}, z as (select case when k % 10 = 9 then null else run_id end as run_id,
      case when k % 13 = 0 then null when k % 16 in (1, 2) then k - k % 16 + 15 else k end as case_id from b),
     y as (select *, case when run_id is null then 'no_run_id' when case_id is null then 'no_case_id'
      when count(*) over (partition by run_id, case_id) > 1 then 'repeated_case_id' end as reason from z)
     select run_id, case_id, case when reason is null and case_id % 5 <> 0 then cast(case_id % 2 as varchar) end as prediction,
      case when reason is null then case_id % 5 = 0 end as abstained, reason from y""",
)
def _(spark, sf):
    """Records that answers could not be matched to are quarantined, and all others evaluated once."""
    key = F.col("case_id")
    run = F.when(key % 10 != 9, F.col("run_id"))
    case = F.when(key % 13 == 0, None).when((key % 16).isin(1, 2), key - key % 16 + 15).otherwise(key)
    held = gapped_records(spark, sf).withColumn("run_id", run).withColumn("case_id", case)
    return outcomes(evaluate.run_rounds(held, parity_model(), 8))


@register(
    "whole_run",
    f"""with {GAPPED}, x as (select *, k % 17 = 0 as lost from b) select run_id, count(*) as n_input_records, count(*) filter (not lost) as n_evaluated,
     count(*) filter (not lost and k % 5 = 0) as n_abstained, floor(1e6 * count(*) filter (not lost and k % 5 <> 0) / count(*) filter (not lost) + 0.5) / 1e6 as accuracy,
     'Total patient rows: ' || count(*) as line, count(*) filter (not lost) as rows_in_document from x group by run_id""",
)
def _(spark, sf):
    """Records to report and documents: lost replies count as input, not as evaluations."""
    held = gapped_records(spark, sf)
    table = held.select("run_id").distinct().withColumns({"model": F.lit("stand-in"), "suite": F.lit("{}")})
    suite = table.select("run_id", F.lit("task").alias("name"), F.lit("detection").alias("text"))
    done = evaluate_runs(held, unreliable_model(), table, suite)
    accuracy = done.scores.filter("metric = 'accuracy'").select(
        "run_id", "n_evaluated", "n_abstained", (F.floor(F.col("value") * 1e6 + 0.5) / 1e6).alias("accuracy")
    )
    line = done.report.filter("line like '%Total patient rows%'").select("run_id", F.trim("line").alias("line"))
    listed = done.pieces.filter("section = 1").groupBy("run_id").agg(F.count("*").alias("rows_in_document"))
    summary = done.summary.select("run_id", "n_input_records")
    return summary.join(accuracy, "run_id").join(line, "run_id").join(listed, "run_id")
