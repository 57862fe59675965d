"""Case, evaluation and answer tables derived from the orders table by integer arithmetic.

The SQL text runs unchanged in Spark and in DuckDB, so a query and its check start
from equal rows. ``k`` is the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL = "\n"

KEYS = "select o_orderkey as k from orders"

EVALUATIONS = """
select k as case_id, q as row_idx, 'run_' || cast(k % 6 as string) as run_id,
 'model_' || cast(k % 3 as string) as model,
 case cast((k % 6 - k % 2) / 2 as int) when 0 then 'detection' when 1 then 'staging' else 'progression' end as task,
 case when k % 23 = 0 then null else cast(1 + (k * 7 + q) % 5 as int) end as ckd_stage,
 gt as ground_truth, abst as abstained,
 case when abst or k % 41 = 0 then null when k % 53 = 0 then 'unknown'
      when hit and k % 5 = 0 then ' ' || upper(gt) || ' ' when hit then gt else wrong end as prediction,
 case when k % 19 = 0 then null else cast((k * 31 + 7) % 101 as double) / cast(100 as double) end as confidence,
 case when k % 13 = 0 then null else (k * 11 + 2) % 8 = 0 end as should_abstain,
 case when k % 37 = 1 then '' when k % 10 = 0 then 'single' else 'batch' end as prompt_mode,
 cast(300 + k % 50 as double) as input_tokens,
 case when k % 17 = 0 then null else cast(20 + k % 9 as double) end as output_tokens
from (select k, q, (k * 17 + q) % 9 = 0 as abst, (k * 29 + 3) % 11 < 8 as hit,
  case when k % 6 < 2 then cast(q % 2 as string) when k % 6 < 4 then cast(1 + q % 5 as string)
       else case q % 3 when 0 then 'stable' when 1 then 'worsening' else 'improving' end end as gt,
  case when k % 6 < 2 then cast((q + 1) % 2 as string) when k % 6 < 4 then cast(1 + (q + 1) % 5 as string)
       else case (q + 1) % 3 when 0 then 'stable' when 1 then 'worsening' else 'improving' end end as wrong
  from (select o_orderkey as k, cast((o_orderkey - o_orderkey % 6) / 6 as bigint) as q from orders) a) b
"""


def _whole(expr: str) -> str:
    return f"cast({expr} as double)"


def _tenth(expr: str) -> str:
    return f"cast({expr} as double)/cast(10 as double)"


# One positive formula per feature.
FEATURE_SQL = {
    "age": _whole("2 + (k * 7 + 3) % 89"),
    "bp": _whole("50 + ((k * 3) % 13) * 10"),
    "sg": "cast(1005 + ((k * 11) % 6) * 5 as double)/cast(1000 as double)",
    "al": _whole("(k * 5) % 6"),
    "bgr": _whole("70 + (k * 29 + 3) % 400"),
    "bu": _whole("15 + (k * 19 + 1) % 150"),
    "sc": "cast(0.4 as double) + cast(((k*37+11)%97)*((k*13+5)%89)*((k*5+2)%83) as double)/cast(60000 as double)",
    "sod": _whole("110 + (k * 17 + 5) % 45"),
    "pot": _tenth("28 + (k * 23 + 1) % 40"),
    "hemo": _tenth("60 + (k * 41 + 9) % 110"),
    "pcv": _whole("20 + (k * 23) % 34"),
    "wbcc": _whole("2200 + ((k * 43 + 7) % 200) * 100"),
    "rbcc": _tenth("20 + (k * 31 + 2) % 45"),
    "rbc": _whole("case when k % 5 = 1 then 1 else 0 end"),
    "pc": _whole("case when k % 7 = 2 then 1 else 0 end"),
    "pcc": _whole("case when k % 9 = 4 then 1 else 0 end"),
    "ba": _whole("case when k % 13 = 6 then 1 else 0 end"),
    "htn": _whole("case when k % 3 = 0 then 1 else 0 end"),
    "dm": _whole("case when k % 4 = 1 then 1 else 0 end"),
    "cad": _whole("case when k % 10 = 3 then 1 else 0 end"),
    "appet": _whole("case when k % 6 = 5 then 0 else 1 end"),
    "pe": _whole("case when k % 8 = 3 then 1 else 0 end"),
    "ane": _whole("case when k % 12 = 7 then 1 else 0 end"),
}

CLINICAL_CASES = (
    "select k as case_id, k as row_idx, "
    + ", ".join(f"{sql} as {name}" for name, sql in FEATURE_SQL.items())
    + f", cast(k % 2 as int) as class from ({KEYS}) a"
)

RESPONSES = f"""
select k as case_id, concat('run_', cast(k % 6 as string)) as run_id, 'detection' as task, case k % 8
 when 0 then concat('{{"abstained": false, "confidence": 0.', cast(10 + k % 90 as string), ', "prediction": ', cast(k % 2 as string), '}}')
 when 1 then concat('```json{NL}{{"abstained": false, "confidence": ', cast(k % 3 as string), ', "prediction": "', cast(k % 2 as string), '"}}{NL}```')
 when 2 then concat('Sure, here it is: {{"prediction": ', cast(k % 2 as string), ', "abstained": false}} Hope it helps')
 when 3 then '{{"abstained": true, "confidence": 0.2, "prediction": null}}'
 when 4 then 'I am unable to determine this safely.'
 when 5 then concat('{{"abstained": "false", "prediction": ', cast(k % 2 as string), '}}')
 when 6 then concat('{{"abstained": false, "confidence": "0.5", "prediction": ', cast(k % 2 as string), ',}}')
 else 'the answer is one' end as raw_response
from ({KEYS}) a
"""

# Four cases per batch. Damage by batch_id % 6: none, reversed order, missing comma,
# trailing comma, one id left out, one id given twice.
BATCH_SIZE = 4


def _item(slot: str, pred: str) -> str:
    key = f"(b * 4 + {slot})"
    return (
        f"""concat('{{"id":"case_{slot}","abstained":', case when {key} % 7 = 0 then 'true' else 'false' end,"""
        f""" ',"confidence":0.', cast(10 + {key} % 90 as string), ',"prediction":',"""
        f""" case when {key} % 7 = 0 then 'null' else cast({pred} as string) end, '}}')"""
    )


_I0, _I1, _I2, _I3 = (_item(str(s), f"(b * 4 + {s}) % 2") for s in range(4))
_WRONG1 = _item("1", "(b * 4 + 2) % 2")

BATCH_RESPONSES = f"""
select b as batch_id, 'run_' || cast(b % 6 as string) as run_id, 'detection' as task, cast(4 as int) as size,
 cast(0 as int) as round, 'batch' as mode,
 case b % 6
  when 0 then concat('{{"results":[', {_I0}, ',', {_I1}, ',', {_I2}, ',', {_I3}, ']}}')
  when 1 then concat('{{"results":[', {_I3}, ',', {_I2}, ',', {_I1}, ',', {_I0}, ']}}')
  when 2 then concat('{{"results":[', {_I0}, {_I1}, ' ', {_I2}, ',', {_I3}, ']}}')
  when 3 then concat('```{NL}{{"results":[', {_I0}, ',', {_I1}, ',', {_I2}, ',', {_I3}, ',]}}{NL}```')
  when 4 then concat('{{"results":[', {_I0}, ',', {_I1}, ',', {_I3}, ']}}')
  else concat('{{"results":[', {_I0}, ',', {_WRONG1}, ',', {_I1}, ',', {_I2}, ',', {_I3}, ',{{"id":"case_9"}}]}}')
 end as raw_response,
 case when b % 5 = 0 then '{{"usage":{{"prompt_tokens":' || cast(400 + b % 50 as string) || ',"completion_tokens":' || cast(40 + b % 9 as string) || '}}}}'
      when b % 5 = 1 then '{{"usage":{{"input_tokens":' || cast(400 + b % 50 as string) || ',"output_tokens":' || cast(40 + b % 9 as string) || '}}}}'
      when b % 5 = 2 then '{{"usage_metadata":{{"prompt_token_count":' || cast(400 + b % 50 as string) || ',"candidates_token_count":' || cast(40 + b % 9 as string) || '}}}}'
      when b % 5 = 3 then '{{"usage":{{"prompt_tokens":' || cast(400 + b % 50 as string) || '}}}}'
      else '{{}}' end as usage,
 case b % 5 when 1 then 'anthropic' when 2 then 'gemini' else 'openai' end as provider
from batches
"""


def _cell(name: str, text: str) -> str:
    """Raw text of a cell: padded upper case, blank, or plain."""
    off = list(FEATURE_SQL).index(name) if name in FEATURE_SQL else 30
    return (
        f"case when (k + {off}) % 11 = 3 then '  ' "
        f"when k % 7 = 0 then concat(' ', upper({text}), ' ') else {text} end"
    )


_WORDS = {
    "rbc": ("normal", "abnormal"), "pc": ("normal", "abnormal"),
    "pcc": ("notpresent", "present"), "ba": ("notpresent", "present"),
    "htn": ("no", "yes"), "dm": ("no", "yes"), "cad": ("no", "yes"),
    "appet": ("poor", "good"), "pe": ("no", "yes"), "ane": ("no", "yes"),
}
_NUMBER_TEXT = {
    "sc": "concat(cast(1 + (k * 13) % 9 as string), '.', cast((k * 7) % 10 as string))",
    "sg": "concat('1.0', case when ((k * 11) % 6) = 0 then '05' else cast(5 + ((k * 11) % 6) * 5 as string) end)",
    "pot": "concat(cast(2 + (k * 23) % 5 as string), '.', cast((k * 3) % 10 as string))",
    "hemo": "concat(cast(6 + (k * 41) % 11 as string), '.', cast(k % 10 as string))",
    "rbcc": "concat(cast(2 + (k * 31) % 4 as string), '.', cast((k * 9) % 10 as string))",
    "su": "cast(k % 4 as string)",
}
_WHOLE_TEXT = {
    "age": "2 + (k * 7 + 3) % 89", "bp": "50 + ((k * 3) % 13) * 10", "al": "(k * 5) % 6",
    "bgr": "70 + (k * 29 + 3) % 400", "bu": "15 + (k * 19 + 1) % 150",
    "sod": "110 + (k * 17 + 5) % 45", "pcv": "20 + (k * 23) % 34",
    "wbcc": "2200 + ((k * 43 + 7) % 200) * 100",
}
_ORDER = [
    "age", "bp", "sg", "al", "su", "rbc", "pc", "pcc", "ba", "bgr", "bu", "sc", "sod",
    "pot", "hemo", "pcv", "wbcc", "rbcc", "htn", "dm", "cad", "appet", "pe", "ane",
]


def _value_text(name: str) -> str:
    if name in _WORDS:
        zero, one = _WORDS[name]
        flag = FEATURE_SQL[name].removeprefix("cast(").removesuffix(" as double)")
        return f"case when ({flag}) = 1 then '{one}' else '{zero}' end"
    return _NUMBER_TEXT.get(name) or f"cast({_WHOLE_TEXT[name]} as string)"


def _raw(name: str, shifted: str = "") -> str:
    cell = _cell(name, _value_text(name))
    return f"case {shifted} else {cell} end" if shifted else cell


_SHIFTED = {"appet": "when k % 97 = 5 then 'yes'", "pe": "when k % 89 = 7 then 'good'"}
_DIRTY = {
    **_SHIFTED,
    "sc": "when k % 101 = 9 then 'high'",
    "htn": "when k % 103 = 4 then 'sometimes'",
}
_CLASS = "case when k % 5 < 3 then 'ckd' else 'notckd' end"

# Cells in another order than the contract's, as a reader may deliver them.
RAW_CASES = (
    f"select {_cell('class', _CLASS).replace('% 11 = 3', '% 11 = 99')} as class, cast(k as string) as id, "
    + ", ".join(f"{_raw(c, _SHIFTED.get(c, ''))} as {c}" for c in reversed(_ORDER))
    + f" from ({KEYS}) a"
)
DIRTY_CASES = (
    f"select case when k % 307 = 6 then null else {_CLASS} end as class, "
    "case when k % 499 = 2 then null when k % 211 = 1 then cast(k - 1 as string) else cast(k as string) end as id, "
    + ", ".join(f"{_raw(c, _DIRTY.get(c, ''))} as {c}" for c in reversed(_ORDER))
    + f" from ({KEYS}) a"
)


def clean_value_sql(name: str) -> str:
    """What the clean table holds for one column, straight from the arithmetic."""
    off = list(FEATURE_SQL).index(name) if name in FEATURE_SQL else 30
    shifted = _SHIFTED.get(name, "")
    null_when = f"(k + {off}) % 11 = 3"
    if shifted:
        null_when += " or " + shifted.split("when ")[1].split(" then")[0]
    text = _value_text(name)
    value = text if name in _WORDS else f"cast({text} as double)"
    return f"case when {null_when} then null else {value} end"


def code_value_sql(name: str) -> str:
    """The ordinal code of a nominal column, straight from the arithmetic."""
    off = list(FEATURE_SQL).index(name)
    shifted = _SHIFTED.get(name, "")
    null_when = f"(k + {off}) % 11 = 3"
    if shifted:
        null_when += " or " + shifted.split("when ")[1].split(" then")[0]
    return f"case when {null_when} then null else {FEATURE_SQL[name]} end"


CLEAN_CASES = (
    "select cast(k as double) as id, "
    + ", ".join(f"{clean_value_sql(c)} as {c}" for c in _ORDER)
    + f", {_CLASS} as class from ({KEYS}) a"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived batch answers, one row per four order keys."""
    keys = read_table(spark, sf_dir, "orders").select((F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("k"))
    batches = keys.select((F.col("k") / 4).cast("bigint").alias("b"))
    spread_keys = batches.repartition(spark.sparkContext.defaultParallelism, "b").distinct()
    text = BATCH_RESPONSES.replace("{", "{{").replace("}", "}}").replace("from batches", "from {batches}")
    return spark.sql(text, batches=spread_keys)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of one small file has one partition; spread it as many files would be."""
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    few = df.rdd.getNumPartitions() < parallelism
    return df.repartition(parallelism, key) if few else df


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the texts above over the orders table of a data folder."""
    text = sql.replace("{", "{{").replace("}", "}}").replace("from orders", "from {orders}")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return spark.sql(text, orders=spread(orders, "o_orderkey"))
