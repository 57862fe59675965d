"""Case table, encoding, clinical and sampling queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.checks.common import (
    Query, clinical, digest, dirty_cases, md5_uniform, orders, q9, r9, raw_cases, rounded,
)
from abstain_eval.operators import clinical as c
from abstain_eval.operators import encode, impute, order, synthesize, validate
from abstain_eval.plans import derived as d
from abstain_eval.plans.domain import Domain
from abstain_eval.plans.fitted import FittedPreparation
from abstain_eval.plans.prepare import impute_frame, prepare
from abstain_eval.session import cut_lineage, fresh_path
from abstain_eval.sources.cases import header_names, read_cases

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


RAW = f"r as ({d.RAW_CASES})"
DIRTY = f"r as ({d.DIRTY_CASES})"
CLEAN = f"c as ({d.CLEAN_CASES})"
CLINICAL = f"cl as ({d.CLINICAL_CASES})"
_COLS = ", ".join(k.RAW_COLUMNS)

# --- sources and checks --------------------------------------------------------


@register(
    "read_case_csv",
    f"with {RAW} select " + ", ".join(f"{x}" if x in ("id",) else f"case when trim({x}) = '' then null else trim({x}) end as {x}" for x in k.RAW_COLUMNS) + " from r",
)
def _(spark, sf):
    """Write the raw cases as CSV and read them back; the reader keeps padding out of it."""
    path = fresh_path(spark, "cases-csv")
    raw_cases(spark, sf).write.option("header", True).csv(path)
    read = read_cases(spark, path)
    return read.select(*[F.when(F.trim(x) != "", F.trim(x)).alias(x) for x in k.RAW_COLUMNS])


@register(
    "read_case_parquet",
    f"with {CLINICAL} select cast(case_id as varchar) as case_id, cast(age as varchar) as age, cast(class as varchar) as class from cl",
)
def _(spark, sf):
    path = fresh_path(spark, "cases-parquet")
    clinical(spark, sf).write.parquet(path)
    return read_cases(spark, path, "parquet").select("case_id", "age", "class")


@register("canonical_order", f"with {RAW} select {_COLS} from r")
def _(spark, sf):
    return validate.canonical_order(raw_cases(spark, sf))


@register(
    "blanks_to_null",
    f"with {RAW} select " + ", ".join(f"case when trim({x}) <> '' then {x} end as {x}" for x in k.RAW_COLUMNS) + " from r",
)
def _(spark, sf):
    return validate.blanks_to_null(validate.canonical_order(raw_cases(spark, sf)))


@register("normalised_text", f"with {RAW} select " + ", ".join(f"lower(trim({x})) as {x}" for x in k.RAW_COLUMNS) + " from r")
def _(spark, sf):
    return validate.normalise_text(validate.canonical_order(raw_cases(spark, sf)))


_NUMBERS = """
select k, case k % 10 when 0 then '1.5' when 1 then '-3' when 2 then '1e3' when 3 then '1.0d' when 4 then '1.0f' when 5 then 'nan' when 6 then '.5'
 when 7 then '5.' when 8 then 'high' else cast(k as string) end as t from (select o_orderkey as k from orders) a
"""


@register(
    "numbers_from_text",
    f"""with x as ({_NUMBERS}) select k, case when k % 10 in (3, 4, 5, 8) then null else cast(t as double) end as v from x""",
)
def _(spark, sf):
    return d.derive(spark, sf, _NUMBERS).select("k", validate.number_of("t").alias("v"))


_SOMETIMES, _HIGH = "htn = 'sometimes'", "sc = 'high'"


def shown(findings: DataFrame) -> DataFrame:
    return findings.withColumn("examples", F.array_join("examples", ","))


def findings_sql(check: str, column: str, detail: str, where: str, source: str = "r") -> str:
    """Distinct bad values of a column, their number and the first three ids."""
    first = "array_to_string(list_slice(list(id order by try_cast(id as bigint) nulls last), 1, 3), ',')"
    return f"""select '{check}' as "check", '{column}' as "column", {detail} as detail, count(*) as n, {first} as examples
     from {source} where {where} group by {detail}"""


_VARIED = f"v as (select cast(k as varchar) as id, 'bad' || cast(k % 7 as varchar) as sc, k % 101 = 9 as in_sc, 'x' || cast(k % 2 as varchar) as hemo, k % 37 = 5 as in_hemo from ({d.KEYS}))"


@register("number_violations", f"with {_VARIED} {findings_sql('non_numeric', 'sc', 'sc', 'in_sc', 'v')} union all {findings_sql('non_numeric', 'hemo', 'hemo', 'in_hemo', 'v')}")
def _(spark, sf):
    """Bad values that differ from row to row."""
    key = F.trim("id").cast("bigint")
    dirty = raw_cases(spark, sf).withColumns(
        {
            "sc": F.when(key % 101 == 9, F.concat(F.lit("bad"), key % 7)).otherwise(F.col("sc")),
            "hemo": F.when(key % 37 == 5, F.concat(F.lit("x"), key % 2)).otherwise(F.col("hemo")),
        }
    )
    return shown(validate.number_violations(dirty))


@register(
    "shifted_values_dropped",
    f"with a as ({d.KEYS}) select cast(k as double) as id, {d.clean_value_sql('appet')} as appet, {d.clean_value_sql('pe')} as pe from a",
)
def _(spark, sf):
    cells = validate.normalised_cells(raw_cases(spark, sf)).transform(validate.coerce_numbers)
    return validate.drop_shifted_values(cells).select("id", "appet", "pe")


@register("value_violations", f"with {DIRTY} {findings_sql('unsupported_value', 'htn', 'htn', _SOMETIMES)}")
def _(spark, sf):
    return shown(validate.value_violations(dirty_cases(spark, sf)))


_IDS = """select 'duplicate_id' as "check", 'id' as "column", id as detail, count(*) as n, '' as examples from r where id is not null group by id having count(*) > 1
    union all select 'missing_id', 'id', cast(count(*) as varchar), count(*), '' from r where id is null having count(*) > 0"""


@register(
    "identifier_violations",
    f"""with {DIRTY}, big as (select case when k % 7 = 3 then 9007199254740992 + k - k % 2 else 9007199254740992 + 10000000 + k end as id from ({d.KEYS}))
    {_IDS} union all select 'duplicate_id', 'id', cast(id as varchar), count(*), '' from big group by id having count(*) > 1""",
)
def _(spark, sf):
    """Ids of the dirty table, and ids that doubles could not tell apart."""
    key = F.trim("id").cast("bigint")
    big = F.lit(9007199254740992) + F.when(key % 7 == 3, key - key % 2).otherwise(key + 10_000_000)
    large = raw_cases(spark, sf).withColumn("id", big.cast("string"))
    both = validate.identifier_violations(dirty_cases(spark, sf)).unionByName(validate.identifier_violations(large))
    return shown(both)


@register(
    "target_violations",
    f"""with {DIRTY} select 'missing_target' as "check", 'class' as "column", cast(count(*) as varchar) as detail, count(*) as n, '' as examples from r where class is null having count(*) > 0
    union all select 'label_not_seen', 'class', 'notckd', 0, '' where not exists (select 1 from r where lower(trim(class)) = 'none')""",
)
def _(spark, sf):
    # One label is renamed so that it is never seen.
    dirty = dirty_cases(spark, sf).withColumn("class", F.when(F.col("class").isNotNull(), "ckd"))
    return shown(validate.target_violations(dirty))


@register(
    "all_violations",
    f"""with {DIRTY} {findings_sql('non_numeric', 'sc', 'sc', _HIGH)}
    union all {findings_sql('unsupported_value', 'htn', 'htn', _SOMETIMES)}
    union all {_IDS}
    union all select 'missing_target', 'class', cast(count(*) as varchar), count(*), '' from r where class is null having count(*) > 0""",
)
def _(spark, sf):
    return shown(validate.violations(dirty_cases(spark, sf)))


@register(
    "header_violations",
    """select 'duplicate_column' as "check", 'age' as "column", null::varchar as detail, 2 as n, '' as examples
    union all select 'missing_column', 'sc', null, 1, '' union all select 'unexpected_column', 'extra', null, 1, ''""",
)
def _(spark, sf):
    """A header with a repeated, a missing and an unexpected name, read from a file that has it."""
    path = fresh_path(spark, "header-csv")
    raw = raw_cases(spark, sf).drop("sc").withColumn("extra", F.lit("1"))
    # Each file of a table opens with its header; rows stand in files of their own here.
    header = spark.createDataFrame([(",".join([*raw.columns, "age"]),)], "value string")
    header.write.text(path)
    raw.select(F.concat_ws(",", *raw.columns, "age").alias("value")).write.text(f"{path}-rows")
    return shown(validate.header_violations(spark, header_names(spark, path)))


_MISSING = " union all ".join(f"select '{x}' as \"column\", count(*) - count({x}) as n_missing, count(*) as n_rows from c" for x in k.RAW_COLUMNS)


@register(
    "missing_profile",
    f"with {CLEAN}, p as ({_MISSING}) select * from p union all select null, cast(sum(n_missing) as bigint), any_value(n_rows) from p",
)
def _(spark, sf):
    return validate.missing_profile(validate.clean_cases(raw_cases(spark, sf)))


@register("clean_cases", f"with {CLEAN} select {_COLS} from c")
def _(spark, sf):
    return validate.clean_cases(raw_cases(spark, sf))


@register(
    "empty_runs",
    f"with a as ({d.KEYS}) select 'empty_run' as \"check\", 'run_id' as \"column\", 'run_' || cast(k as varchar) as detail from a where k >= 6",
)
def _(spark, sf):
    expected = orders(spark, sf).select(F.concat(F.lit("run_"), F.col("k").cast("string")).alias("run_id"))
    rows = orders(spark, sf).select(F.concat(F.lit("run_"), (F.col("k") % 6).cast("string")).alias("run_id"))
    return validate.empty_runs(expected, rows)


# --- encoding -----------------------------------------------------------------

_CODES = ", ".join(f"{d.code_value_sql(x)} as {x}" for x in k.NOMINAL_COLUMNS)
_NUMS = ", ".join(f"{d.clean_value_sql(x)} as {x}" for x in k.NUMERIC_FEATURES)
FRAME = f"fr as (select cast(k as double) as id, {_CODES}, {_NUMS}, cast(case when k % 5 < 3 then 0 else 1 end as int) as class from ({d.KEYS}) a)"


def frame(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encoded_frame(validate.clean_cases(raw_cases(spark, sf)))


@register("encoded_frame", f"with {FRAME} select * from fr")
def _(spark, sf):
    return frame(spark, sf)


@register(
    "nominal_codes",
    f"with a as ({d.KEYS}) select cast(k as double) as id, {_CODES} from a",
)
def _(spark, sf):
    coded = encode.encode_nominal(validate.clean_cases(raw_cases(spark, sf)))
    return coded.select("id", *k.NOMINAL_COLUMNS)


@register("label_classes", "select label, cast(row_number() over (order by label) - 1 as int) as code from (select distinct o_orderpriority as label from orders) x")
def _(spark, sf):
    return encode.label_classes(d.read_table(spark, sf, "orders"), "o_orderpriority")


@register("target_codes", f"with {FRAME} select id, class from fr")
def _(spark, sf):
    return encode.encode_target(validate.clean_cases(raw_cases(spark, sf))).select("id", "class")


_FILLED = k.NUMERIC_FEATURES + k.NOMINAL_COLUMNS


@register(
    "mean_fill",
    f"with {FRAME} select id, " + ", ".join(f"{q9(f'coalesce({x}, (select avg({x}) from fr))')} as {x}" for x in _FILLED) + " from fr",
)
def _(spark, sf):
    return rounded(encode.fill_means(frame(spark, sf), _FILLED).select("id", *_FILLED), *_FILLED)


IMPUTED = [*k.NOMINAL_COLUMNS, *k.NUMERIC_FEATURES, k.TARGET_COLUMN]

_PAIR = """
select k, case when k % 10 = 3 then null else cast(k % 97 as double) end as x,
 case when k % 10 = 7 then null else cast((k % 97) * 2 + (k * k) % 11 as double) end as y from (select o_orderkey as k from orders) a
"""


def _q4(expr: str) -> str:
    return f"(floor(({expr}) * 1e4 + 0.5) / 1e4)"


@register(
    "chained_imputation_of_two",
    f"""with p as ({_PAIR}), m as (select *, coalesce(x, (select avg(x) from p)) as x0, coalesce(y, (select avg(y) from p)) as y0 from p),
    s1 as (select *, case when x is null then (select regr_slope(x0, y0) from m where x is not null) * y0 + (select regr_intercept(x0, y0) from m where x is not null) else x end as x1 from m),
    s2 as (select *, case when y is null then (select regr_slope(y0, x1) from s1 where y is not null) * x1 + (select regr_intercept(y0, x1) from s1 where y is not null) else y end as y1 from s1)
    select k, {_q4('x1')} as x, {_q4('y1')} as y from s2""",
)
def _(spark, sf):
    """One linear round over two columns, which plain regression functions can follow."""
    _, done = impute.fit_imputation(
        d.derive(spark, sf, _PAIR), ["x", "y"], lambda: impute.linear(0.0), rounds=1
    )
    return done.select("k", *[(F.floor(F.col(x) * 1e4 + 0.5) / 1e4).alias(x) for x in ("x", "y")])


_TRIO = f"""select k, case when k % 7 = 2 then null else cast((k * 37) % 101 as double) end as x,
 case when k % 5 = 1 then null else cast((k * 37) % 101 * 2 + (k * 11) % 13 as double) end as y, cast((k * 53) % 97 as double) as z from ({d.KEYS}) a"""


def _plane(target: str, one: str, two: str, where: str) -> str:
    """Least squares of a column on two others, from sums of deviations."""
    u, v, w = f"covar_pop({one}, {one})", f"covar_pop({one}, {two})", f"covar_pop({two}, {two})"
    p, q = f"covar_pop({target}, {one})", f"covar_pop({target}, {two})"
    a, b = f"({p} * {w} - {q} * {v}) / ({u} * {w} - {v} * {v})", f"({q} * {u} - {p} * {v}) / ({u} * {w} - {v} * {v})"
    return f"(select avg({target}) - {a} * avg({one}) - {b} * avg({two}) as c, {a} as a, {b} as b from m where {where} is not null)"


@register(
    "linear_rounds_of_three",
    f"""with p as ({_TRIO}), m as (select k, x, y, coalesce(x, (select avg(x) from p)) as x0, coalesce(y, (select avg(y) from p)) as y0, z as z0 from p),
    fx as {_plane('x0', 'y0', 'z0', 'x')}, fy as {_plane('y0', 'x0', 'z0', 'y')}
    select k, round(coalesce(x, fx.c + fx.a * y0 + fx.b * z0), 4) as x, round(coalesce(y, fy.c + fy.a * x0 + fy.b * z0), 4) as y from m, fx, fy""",
)
def _(spark, sf):
    """One round: both columns are fitted from the values before it."""
    _, done = impute.linear_rounds(d.derive(spark, sf, _TRIO), ["x", "y", "z"], 1, regularisation=0.0)
    return done.select("k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register("chained_imputation")
def _(spark, sf):
    """Linear rounds over the whole frame until they settle."""
    columns = [*k.NOMINAL_COLUMNS, *k.NUMERIC_FEATURES, "class"]
    _, done = impute.fit_imputation(frame(spark, sf), columns, "linear")
    return encode.round_target(done)


@register("chained_imputation_trees")
def _(spark, sf):
    """The default: boosted trees for all 25 columns, 100 trees and up to 10 rounds."""
    _, done = impute.fit_imputation(frame(spark, sf), IMPUTED)
    return encode.round_target(done)


def _stacked(prefix: str) -> str:
    """One row for each imputed column of every row, with its place in the list."""
    return " union all ".join(f"select id, {i} as place, cast({prefix}{c} as double) as v from m" for i, c in enumerate(IMPUTED))


@register(
    "imputed_frame",
    f"with {FRAME} select id, {', '.join(IMPUTED)}, 0 as n_missing from fr",
)
def _(spark, sf):
    """The frame before scaling, in the units of the raw table: known cells stay, and no cell is missing."""
    held = frame(spark, sf)
    _, done = impute_frame(held, k.PrepConfig(estimator="linear", rounds=2))
    known = held.select("id", *[F.col(c).isNotNull().alias(f"has_{c}") for c in IMPUTED])
    missing = reduce(lambda x, y: x + y, [F.col(c).isNull().cast("int") for c in IMPUTED])
    both = done.join(known, "id").withColumn("n_missing", missing)
    return both.select("id", *[F.when(F.col(f"has_{c}"), F.col(c)).alias(c) for c in IMPUTED], "n_missing")


@register(
    "boosted_first_splits",
    f"""with {FRAME}, m as materialized (select id, {', '.join(IMPUTED)}, {', '.join(f'coalesce({c}, avg({c}) over ()) as f_{c}' for c in IMPUTED)} from fr),
    f as materialized ({_stacked('f_')}), y as ({_stacked('')}),
    t as materialized (select id, place, v - avg(v) over (partition by place) as residual from y where v is not null),
    s as (select t.place as target, f.place as feature, f.v, sum(residual) as total, count(*) as n from t join f on f.id = t.id and f.place <> t.place group by all),
    c as (select target, feature, v, lead(v) over w as after, sum(total) over w as l, sum(n) over w as nl,
      sum(total) over (partition by target, feature) as a, sum(n) over (partition by target, feature) as na from s window w as (partition by target, feature order by v)),
    g as (select target, feature, (v + after) / 2 as threshold, l * l / nl + (a - l) * (a - l) / (na - nl) as gain from c where after is not null)
    select list_extract({IMPUTED}, target + 1) as "column", list_extract({IMPUTED}, feature + 1) as feature, round(threshold, 6) as threshold
    from g qualify row_number() over (partition by target order by round(gain, 6) desc, feature, threshold) = 1""",
)
def _(spark, sf):
    """The first split of every column's first tree, on all rows: the one that explains most."""
    stumps = impute.Boosting(trees=1, depth=1)
    fitted, _ = impute.fit_imputation(frame(spark, sf), IMPUTED, stumps, rounds=1)
    names = F.array(*[F.lit(c) for c in IMPUTED])
    first = fitted.node_table(spark).filter("round = 0 and tree = 0 and place = 0")
    return first.select("column", F.element_at(names, F.col("feature") + 1).alias("feature"), F.round("threshold", 6).alias("threshold"))


@register("boosted_chain_on_new_rows", f"with {FRAME} select count(*) as n_rows, 0 as n_missing, 0 as n_other from fr")
def _(spark, sf):
    """A chain that is saved and loaded fills new rows as the fitted one does."""
    held = frame(spark, sf).select("id", *IMPUTED)
    fitted, _ = impute.fit_imputation(held, IMPUTED, impute.Boosting(trees=20), rounds=2)
    path = fresh_path(spark, "chain")
    fitted.save(spark, path)
    new = held.withColumns({c: F.when(F.col("id") % 3 != i % 3, F.col(c)) for i, c in enumerate(("hemo", "htn", "class"))})
    loaded = impute.FittedImputation.load(spark, path).transform(new)
    both = loaded.join(fitted.transform(new).withColumnsRenamed({c: f"f_{c}" for c in IMPUTED}), "id")
    missing = reduce(lambda x, y: x + y, [F.col(c).isNull().cast("int") for c in IMPUTED])
    other = reduce(lambda x, y: x + y, [(~F.col(c).eqNullSafe(F.col(f"f_{c}"))).cast("int") for c in IMPUTED])
    counted = both.agg(F.count("*").alias("n_rows"), F.sum(missing).alias("n_missing"), F.sum(other).alias("n_other"))
    return counted.select("n_rows", *[F.col(c).cast("int").alias(c) for c in ("n_missing", "n_other")])


@register("rounded_target", f"with a as ({d.KEYS}) select k, cast(round_even(k / 4, 0) as int) as class from a")
def _(spark, sf):
    return encode.round_target(orders(spark, sf).select("k", (F.col("k") / 4).alias("class")))


@register(
    "seeded_shuffle",
    f"with a as ({d.KEYS}) select k, row_number() over (order by {digest('shuffle', 'k')}, k) - 1 as row_idx from a",
)
def _(spark, sf):
    return order.seeded_shuffle(orders(spark, sf), ["k"], 42)


@register("reduced_features", f"with {CLINICAL} select case_id, {', '.join(k.REDUCED_FEATURES)}, class from cl")
def _(spark, sf):
    return encode.project_features(clinical(spark, sf), "reduced", ["case_id"])


@register("full_features", f"with {CLINICAL} select case_id, {', '.join(k.FULL_FEATURES)}, class from cl")
def _(spark, sf):
    return encode.project_features(clinical(spark, sf), "full", ["case_id"])


def _scaled_sql(column: str, low: str, high: str) -> str:
    part = f"(coalesce(({column} - {low}) / nullif({high} - {low}, 0), 0))"
    return q9(f"ceil({part})" if column in k.CEILED_COLUMNS else part)


_BOUNDS = ", ".join(f"min({x}) as lo_{x}, max({x}) as hi_{x}" for x in k.REDUCED_FEATURES)


@register(
    "scaled_frame",
    f"with {CLINICAL}, b as (select {_BOUNDS} from cl) select case_id, class, " + ", ".join(f"{_scaled_sql(x, 'lo_' + x, 'hi_' + x)} as {x}" for x in k.REDUCED_FEATURES) + " from cl, b",
)
def _(spark, sf):
    scaled, _ = encode.fit_scale(clinical(spark, sf), "reduced", ["case_id"])
    return rounded(scaled, *k.REDUCED_FEATURES)


@register(
    "scaled_full_frame",
    f"with {CLINICAL}, b as (select {', '.join(f'min({x}) as lo_{x}, max({x}) as hi_{x}' for x in k.FULL_FEATURES)} from cl) select case_id, class, "
    + ", ".join(q9(f"({x} - lo_{x}) / (hi_{x} - lo_{x})") + f" as {x}" for x in k.FULL_FEATURES) + " from cl, b",
)
def _(spark, sf):
    scaled, _ = encode.fit_scale(clinical(spark, sf), "full", ["case_id"])
    return rounded(scaled, *k.FULL_FEATURES)


@register(
    "fitted_ranges",
    f"with {CLINICAL} " + " union all ".join(f"select '{x}' as \"column\", min({x}) as low, max({x}) as high from cl" for x in k.REDUCED_FEATURES),
)
def _(spark, sf):
    """Ranges saved to the shared folder and read back."""
    path = fresh_path(spark, "ranges")
    encode.save_ranges(encode.fit_ranges(clinical(spark, sf), k.REDUCED_FEATURES), path)
    return encode.load_ranges(spark, path)


@register(
    "ranges_applied_to_new_rows",
    f"with {CLINICAL}, b as (select {_BOUNDS} from cl), n as (select * replace (sc * 2 as sc, bu - 20 as bu) from cl) select case_id, class, "
    + ", ".join(f"{_scaled_sql(x, 'lo_' + x, 'hi_' + x)} as {x}" for x in k.REDUCED_FEATURES) + " from n, b",
)
def _(spark, sf):
    cases = clinical(spark, sf)
    ranges = encode.fit_ranges(cases, k.REDUCED_FEATURES)
    new = cases.withColumns({"sc": F.col("sc") * 2, "bu": F.col("bu") - 20})
    return rounded(encode.apply_scale(new, ranges, "reduced", ["case_id"]), *k.REDUCED_FEATURES)


_LINE = "w as (select * replace (hemo * 3 + 5 as pcv) from cl)"
_LINE_BOUNDS = ", ".join(f"min({x}) as lo_{x}, max({x}) as hi_{x}" for x in k.REDUCED_FEATURES)


@register(
    "fitted_preparation",
    f"with {CLINICAL}, {_LINE}, b as (select {_LINE_BOUNDS} from w) select cast(case_id as double) as id, class, "
    + ", ".join(f"round({_scaled_sql(x, 'lo_' + x, 'hi_' + x)}, 4) as {x}" for x in k.REDUCED_FEATURES) + " from w, b where case_id % 3 = 0",
)
def _(spark, sf):
    """Fitted on complete rows, saved, loaded, and used on new rows with gaps in a column that depends on another."""
    whole = clinical(spark, sf).withColumn("pcv", F.col("hemo") * 3 + 5)
    frame = whole.select(F.col("case_id").cast("double").alias("id"), *k.NOMINAL_COLUMNS, *k.NUMERIC_FEATURES, "class")
    path = fresh_path(spark, "preparation")
    FittedPreparation().fit(frame, "linear").save(spark, path)
    new = frame.filter("id % 3 = 0").withColumn("pcv", F.when(F.col("id") % 2 == 1, F.col("pcv")))
    done = FittedPreparation.load(spark, path).transform(new)
    return done.withColumns({x: F.round(x, 4) for x in k.REDUCED_FEATURES})


_CORR = k.NOMINAL_COLUMNS + k.NUMERIC_FEATURES
_WITH_SIGNAL = f"w as (select * replace (hemo - class * 8 as hemo, pcv + class * 40 as pcv, rbcc + class * 5 as rbcc) from cl)"


def _signal(cases: DataFrame) -> DataFrame:
    y = F.col("class")
    return cases.withColumns({"hemo": F.col("hemo") - y * 8, "pcv": F.col("pcv") + y * 40, "rbcc": F.col("rbcc") + y * 5})


@register(
    "class_correlations",
    f"with {CLINICAL}, {_WITH_SIGNAL} " + " union all ".join(f"select {i}::int as position, '{x}' as feature, {q9(f'corr({x}, class)')} as r from w" for i, x in enumerate(_CORR)),
)
def _(spark, sf):
    return rounded(encode.class_correlations(_signal(clinical(spark, sf)), _CORR), "r")


@register(
    "features_by_correlation",
    f"with {CLINICAL}, {_WITH_SIGNAL}, r as (" + " union all ".join(f"select {i} as p, '{x}' as feature, corr({x}, class) as r from w" for i, x in enumerate(_CORR))
    + f"), g as (select *, case when r >= 0.5 then 0 when r <= -0.4 then 1 when feature in ('sc', 'bu') then 2 end as grp from r) select cast(row_number() over (order by grp, case when grp = 2 then case feature when 'sc' then 0 else 1 end else p end) as int) as rank, feature, {q9('r')} as r from g where grp is not null",
)
def _(spark, sf):
    return rounded(encode.select_by_correlation(_signal(clinical(spark, sf)), _CORR), "r")


# --- clinical -----------------------------------------------------------------

SEX = f"case when {md5_uniform(digest('sex', 'case_id'))} < case when sc <= 0.7 then 0.75 when sc <= 0.9 then 0.5 else 0.25 end then 'female' else 'male' end"


def egfr_sql(sc: str, age: str, sex: str) -> str:
    kappa = f"(case when {sex} = 'female' then 0.7::double else 0.9::double end)"
    scaled = f"(greatest({sc}, 0.4::double) / {kappa})"
    power = f"(case when {scaled} < 1 then case when {sex} = 'female' then -0.241::double else -0.302::double end else -1.2::double end)"
    rate = f"(142::double * pow({scaled}, {power}) * pow(0.9938::double, greatest({age}, 0::double)) * case when {sex} = 'female' then 1.012::double else 1::double end)"
    return f"(floor({rate} * 100 + 0.5) / 100)"


STAGE = "cast(case when egfr >= 90 then 1 when egfr >= 60 then 2 when egfr >= 30 then 3 when egfr >= 15 then 4 else 5 end as int)"
DERIVED = f"{CLINICAL}, sx as (select *, {SEX} as sex from cl), eg as (select *, {egfr_sql('sc', 'age', 'sex')} as egfr from sx), dv as (select *, {STAGE} as ckd_stage from eg)"


def derived_cases(spark: SparkSession, sf: str) -> DataFrame:
    return c.derive_features(clinical(spark, sf))


@register("sex_from_creatinine", f"with {CLINICAL} select case_id, {SEX} as sex from cl")
def _(spark, sf):
    return clinical(spark, sf).select("case_id", c.sex_from_creatinine(42, "case_id").alias("sex"))


@register(
    "sex_from_prevalence",
    f"with {CLINICAL} select case_id, case when {md5_uniform(digest('sex_prevalence', 'case_id'))} < 0.55 then 'male' else 'female' end as sex from cl",
)
def _(spark, sf):
    return clinical(spark, sf).select("case_id", c.sex_from_prevalence(42, "case_id").alias("sex"))


_GIVEN = "case when case_id % 3 = 0 then 'female' else 'male' end"


@register(
    "sex_from_column",
    f"with {CLINICAL}, g as (select *, {_GIVEN} as sex from cl), eg as (select *, {egfr_sql('sc', 'age', 'sex')} as egfr from g) select case_id, sex, egfr from eg",
)
def _(spark, sf):
    given = clinical(spark, sf).withColumn("given_sex", F.when(F.col("case_id") % 3 == 0, "female").otherwise("male"))
    return c.derive_features(given, sex_column="given_sex").select("case_id", "sex", "egfr")


_WILD = """
select k, case k % 6 when 0 then '1.5' when 1 then 'NaN' when 2 then 'Infinity' when 3 then null when 4 then 'text' else cast(-k as string) end as t
from (select o_orderkey as k from orders) a
"""


@register("bounded_numbers", f"with x as ({_WILD}) select k, case when k % 6 = 0 then 1.5 else 0.4 end::double as v from x")
def _(spark, sf):
    from abstain_eval.functions.numbers import bounded_number

    return d.derive(spark, sf, _WILD).select("k", bounded_number("t", 0.4, 0.4).alias("v"))


@register("egfr", f"with {DERIVED} select case_id, egfr from dv")
def _(spark, sf):
    return derived_cases(spark, sf).select("case_id", "egfr")


@register(
    "stages",
    f"""with {DERIVED} select case_id, ckd_stage, cast(case when egfr >= 90 then 1 when egfr >= 60 then 2 when egfr >= 45 then 3 when egfr >= 30 then 4 when egfr >= 15 then 5 else 6 end as int) as split_stage from dv""",
)
def _(spark, sf):
    return derived_cases(spark, sf).select("case_id", "ckd_stage", c.stage_from_egfr("egfr", True).alias("split_stage"))


@register("derived_features", f"with {DERIVED} select case_id, sex, egfr, ckd_stage from dv")
def _(spark, sf):
    return derived_cases(spark, sf).select("case_id", "sex", "egfr", "ckd_stage")


NEAR = f"""{DERIVED}, th as (select *, least(abs(egfr - 15), abs(egfr - 30), abs(egfr - 60), abs(egfr - 90)) as dist from dv),
nr as (select *, case dist when abs(egfr - 15) then 15 when abs(egfr - 30) then 30 when abs(egfr - 60) then 60 else 90 end::double as nearest, floor(dist * 100 + 0.5) / 100 as margin from th)"""


@register("nearest_thresholds", f"with {NEAR} select case_id, nearest as nearest_egfr_stage_threshold, margin as egfr_threshold_margin from nr")
def _(spark, sf):
    return c.with_threshold(derived_cases(spark, sf)).select("case_id", "nearest_egfr_stage_threshold", "egfr_threshold_margin")


_CONFLICT = "((class = 1 and ckd_stage >= 3) or (class = 0 and ckd_stage <= 2))"
_REASON = f"case when {{conflict}} and margin <= 3 then 'label_stage_conflict;egfr_near_threshold:' || cast(nearest as int) when {{conflict}} then 'label_stage_conflict' when margin <= 3 then 'egfr_near_threshold:' || cast(nearest as int) else 'none' end"


@register("deferral_flags", f"with {NEAR} select case_id, {_CONFLICT} or margin <= 3 as should_abstain, {_REASON.format(conflict=_CONFLICT)} as deferral_reason from nr")
def _(spark, sf):
    flagged = c.with_deferral(c.with_threshold(derived_cases(spark, sf)), "detection")
    return flagged.select("case_id", "should_abstain", "deferral_reason")


@register("deferral_flags_staging", f"with {NEAR} select case_id, margin <= 3 as should_abstain, {_REASON.format(conflict='false')} as deferral_reason from nr")
def _(spark, sf):
    flagged = c.with_deferral(c.with_threshold(derived_cases(spark, sf)), "staging")
    return flagged.select("case_id", "should_abstain", "deferral_reason")


DIRECTION = """case when ckd_stage + htn + dm + least(al, 5) / 2 >= 5.5 or (ckd_stage >= 3 and (42 + row_idx * 17 + ckd_stage * 13) % 10 < 6) then 'worsening'
 when ckd_stage <= 2 and htn < 0.5 and dm < 0.5 and al <= 1 and (42 + row_idx * 17 + ckd_stage * 13) % 10 < 3 then 'stable'
 when hemo >= 11.5 and (42 + row_idx * 17 + ckd_stage * 13) % 10 >= 7 then 'improving' else 'stable' end"""
AMBIGUOUS = "((42 + row_idx * 19 + ckd_stage * 7) % 10 < 3 or abs(egfr - 15) <= 5 or abs(egfr - 30) <= 5 or abs(egfr - 60) <= 5 or abs(egfr - 90) <= 5)"
PROGRESS = f"{NEAR}, pg as (select *, {DIRECTION} as direction, {AMBIGUOUS} as ambiguous, case when row_idx % 2 = 1 then -1.0::double else 1.0::double end as sgn from nr)"


@register("progression_directions", f"with {PROGRESS} select case_id, direction as progression_direction from pg")
def _(spark, sf):
    return derived_cases(spark, sf).select("case_id", c.progression_direction(42).alias("progression_direction"))


@register("ambiguous_progressions", f"with {PROGRESS} select case_id, ambiguous as progression_ambiguous from pg")
def _(spark, sf):
    return derived_cases(spark, sf).select("case_id", c.progression_ambiguous(42).alias("progression_ambiguous"))


def _r4(expr: str) -> str:
    return f"(case when ({expr}) < 0 then -floor(-({expr}) * 1e4 + 0.5) / 1e4 else floor(({expr}) * 1e4 + 0.5) / 1e4 end)"


_CLEAR = {
    "sc": "case direction when 'worsening' then greatest(0.4::double, sc * 0.86::double) when 'improving' then least(15::double, sc * 1.16::double) else sc * 0.99::double end",
    "bu": "case direction when 'worsening' then greatest(1.5::double, bu * 0.88::double) when 'improving' then least(200::double, bu * 1.12::double) else bu * 0.98::double end",
    "al": "case direction when 'worsening' then greatest(0, al - 1) when 'improving' then least(5, al + 1) else al end",
    "hemo": "case direction when 'worsening' then least(17.8::double, hemo + 0.7::double) when 'improving' then greatest(3.1::double, hemo - 0.6::double) else hemo end",
    "pcv": "case direction when 'worsening' then least(54, pcv + 2) when 'improving' then greatest(9, pcv - 2) else pcv end",
}
_MIXED = {
    "sc": "greatest(0.4::double, least(15::double, sc * (1::double + sgn * 0.035::double)))",
    "bu": "greatest(1.5::double, least(200::double, bu * (1::double - sgn * 0.055::double)))",
    "al": "greatest(0, least(5, al + sgn * 0.5::double))",
    "hemo": "greatest(3.1::double, least(17.8::double, hemo - sgn * 0.35::double))",
    "pcv": "greatest(9, least(54, pcv + sgn))",
}
_MOVING = list(_CLEAR)


@register("clear_baselines", f"with {PROGRESS} select case_id, " + ", ".join(f"{_r4(_CLEAR[x])} as {x}" for x in _MOVING) + " from pg")
def _(spark, sf):
    from abstain_eval.functions.numbers import round_half_up

    cases = derived_cases(spark, sf).withColumn("direction", c.progression_direction(42))
    earlier = c.clear_baseline(F.col("direction"))
    return cases.select("case_id", *[round_half_up(earlier[x], 4).alias(x) for x in _MOVING])


@register("mixed_baselines", f"with {PROGRESS} select case_id, " + ", ".join(f"{_r4(_MIXED[x])} as {x}" for x in _MOVING) + " from pg")
def _(spark, sf):
    from abstain_eval.functions.numbers import round_half_up

    earlier = c.mixed_baseline()
    return derived_cases(spark, sf).select("case_id", *[round_half_up(earlier[x], 4).alias(x) for x in _MOVING])


@register(
    "progression_records",
    f"with {PROGRESS} select case_id, direction as label, 6::int as trajectory_months, ambiguous as progression_ambiguous, ambiguous or {_CONFLICT} or margin <= 3 as should_abstain, "
    f"case when ambiguous then 'ambiguous_progression_trajectory' else {_REASON.format(conflict=_CONFLICT)} end as deferral_reason, "
    + ", ".join(f"{_r4(f'case when ambiguous then {_MIXED[x]} else {_CLEAR[x]} end')} as baseline_{x}, {x} as current_{x}" for x in _MOVING)
    + f", {_r4('bgr')} as baseline_bgr from pg",
)
def _(spark, sf):
    records = c.build_records(derived_cases(spark, sf), "progression")
    return records.select(
        "case_id", "label", "trajectory_months", "metadata.progression_ambiguous", "metadata.should_abstain",
        "metadata.deferral_reason",
        *[F.col("baseline")[x].alias(f"baseline_{x}") for x in [*_MOVING, "bgr"]],
        *[F.col("current")[x].alias(f"current_{x}") for x in _MOVING],
    )


@register(
    "detection_records",
    f"with {NEAR} select case_id, cast(class as varchar) as label, egfr, ckd_stage, sex, class, {', '.join(k.REDUCED_FEATURES)}, 12::int as n_features from nr",
)
def _(spark, sf):
    records = c.build_records(derived_cases(spark, sf), "detection")
    return records.select(
        "case_id", "label", "metadata.egfr", "metadata.ckd_stage", "metadata.sex", "metadata.class",
        *[F.col("features")[x].alias(x) for x in k.REDUCED_FEATURES], F.size("features").alias("n_features"),
    )


@register(
    "staging_records",
    f"with {NEAR} select case_id, cast(ckd_stage as varchar) as label, egfr, nearest as nearest_threshold, margin, 26::int as n_features from nr",
)
def _(spark, sf):
    records = c.build_records(derived_cases(spark, sf), "staging", "full")
    f = F.col("features")
    return records.select(
        "case_id", "label", f["egfr"].alias("egfr"), f["nearest_egfr_stage_threshold"].alias("nearest_threshold"),
        f["egfr_threshold_margin"].alias("margin"), F.size("features").alias("n_features"),
    )


@register(
    "task_labels",
    f"with {PROGRESS} select case_id, cast(class as varchar) as detection, cast(ckd_stage as varchar) as staging, direction as progression from pg",
)
def _(spark, sf):
    cases = derived_cases(spark, sf).withColumn("progression_direction", c.progression_direction(42))
    return cases.select("case_id", *[c.task_label(t).alias(t) for t in k.TASKS])


# --- splitting and sampling -----------------------------------------------------


def _split_sql(stratum: str, size: float) -> str:
    return f"""with {DERIVED}, n as (select {stratum} as s, count(*)::hugeint as n from dv group by 1), t as (select sum(n) as al, sum(n) - cast(ceil(sum(n) * {size}) as hugeint) as tr from n),
    q as (select s, n, n * tr // al as part, n * tr % al as rest, tr from n, t), w as (select *, row_number() over (order by rest desc, s) as rk, tr - sum(part) over () as spare from q),
    z as (select s, n, n - (part + case when rk <= spare then 1 else 0 end) as quota from w),
    o as (select case_id, {stratum} as s, row_number() over (partition by {stratum} order by {digest('split', 'case_id')}, case_id) as place from dv)"""


@register("split_by_class", f"{_split_sql('class', 0.2)} select case_id, place <= quota as is_test from o join z using (s)")
def _(spark, sf):
    return order.stratified_split(derived_cases(spark, sf), "class", ["case_id"], 0.2, 42).select("case_id", "is_test")


@register("split_by_stage", f"{_split_sql('ckd_stage', 0.33)} select case_id, place <= quota as is_test from o join z using (s)")
def _(spark, sf):
    return order.stratified_split(derived_cases(spark, sf), "ckd_stage", ["case_id"], 0.33, 42).select("case_id", "is_test")


@register("split_quotas", f"{_split_sql('ckd_stage', 0.2)} select s as ckd_stage, n::bigint as n, quota::bigint as quota from z")
def _(spark, sf):
    counts = derived_cases(spark, sf).groupBy("ckd_stage").agg(F.count(F.lit(1)).alias("n"))
    return order.split_quotas(counts, "ckd_stage", 0.2)


@register("small_strata", "select 'stratum_too_small' as \"check\", 'o_totalprice' as \"column\", cast(cast(o_totalprice * 100 as bigint) as varchar) as detail from orders group by cast(o_totalprice * 100 as bigint) having count(*) < 2")
def _(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    counts = d.read_table(spark, sf, "orders").groupBy(cents.alias("o_totalprice")).agg(F.count(F.lit(1)).alias("n"))
    return order.small_strata(counts, "o_totalprice")


_STATS = " union all ".join(
    f"select ckd_stage, count(*) as n, '{x}' as feature, 'continuous' as kind, {q9(f'avg({x})')} as mean, {q9(f'stddev_samp({x})')} as std from dv group by ckd_stage" for x in k.CONTINUOUS_BOUNDS
) + " union all " + " union all ".join(
    f"select ckd_stage, count(*), '{x}', 'binary', {q9(f'avg({x})')}, null from dv group by ckd_stage" for x in k.BINARY_FEATURES
)


@register("stage_statistics", f"with {DERIVED} {_STATS}")
def _(spark, sf):
    stats = synthesize.fit_stage_stats(derived_cases(spark, sf))
    return rounded(synthesize.stage_stats_long(stats), "mean", "std")


@register("stage_shares", f"with {DERIVED} select ckd_stage, count(*) as n, {q9('count(*) / sum(count(*)) over ()')} as share from dv group by ckd_stage")
def _(spark, sf):
    stats = synthesize.fit_stage_stats(derived_cases(spark, sf))
    return rounded(synthesize.stage_shares(stats), "share")


N_SQL = "(select count(*) * 2 + 7 from orders)"


def sample_size(spark: SparkSession, sf: str) -> int:
    """Synthetic cases per query: two per order and some more."""
    return orders(spark, sf).count() * 2 + 7


ALLOCATED = f"""{DERIVED}, sh as (select ckd_stage, count(*) as n, count(*) / (sum(count(*)) over ())::double as share from dv group by ckd_stage),
fl as (select ckd_stage, share, cast(floor(share * {N_SQL}) as bigint) as part from sh),
al as (select ckd_stage, part + case when row_number() over (order by share desc, ckd_stage) = 1 then {N_SQL} - sum(part) over () else 0 end as rows from fl)"""


@register("stage_allocation", f"with {ALLOCATED} select ckd_stage, cast(rows as bigint) as rows from al")
def _(spark, sf):
    stats = synthesize.fit_stage_stats(derived_cases(spark, sf))
    return synthesize.allocate_rows(stats, sample_size(spark, sf))


def _normal(column: str) -> str:
    text = digest(column, "g.ckd_stage", "i")
    return f"(sqrt(-2 * ln(1 - {md5_uniform(text)})) * cos(2 * pi() * {md5_uniform(text, 1)}))"


def _draw(column: str) -> str:
    low, high = k.CONTINUOUS_BOUNDS[column]
    value = f"greatest({low}::double, least({high}::double, case when coalesce(s_{column}, 0) < 1e-6 then m_{column} else m_{column} + s_{column} * {_normal(column)} end))"
    return f"(floor({value} * 1e4 + 0.5) / 1e4)"


_MS = ", ".join(f"avg({x}) as m_{x}, stddev_samp({x}) as s_{x}" for x in k.CONTINUOUS_BOUNDS) + ", " + ", ".join(f"avg({x}) as m_{x}" for x in k.BINARY_FEATURES)
GENERATED = (
    f"{ALLOCATED}, st as (select ckd_stage, {_MS} from dv group by ckd_stage), g as (select ckd_stage, unnest(range(cast(rows as bigint))) as i from al), "
    "dr as (select g.ckd_stage, g.i as draw_idx, "
    + ", ".join(f"{_draw(x)} as {x}" for x in k.CONTINUOUS_BOUNDS) + ", "
    + ", ".join(f"({md5_uniform(digest(x, 'g.ckd_stage', 'i'))} < m_{x})::int::double as {x}" for x in k.BINARY_FEATURES)
    + f", cast(case when g.ckd_stage <= 2 then 1 else 0 end as int) as class, case when {md5_uniform(digest('sex_prevalence', 'g.ckd_stage', 'i'))} < 0.55 then 'male' else 'female' end as sex from g join st on st.ckd_stage = g.ckd_stage), "
    + f"sy as (select *, {egfr_sql('sc', 'case ckd_stage when 1 then 45::double when 2 then 52::double when 3 then 60::double when 4 then 67::double when 5 then 72::double else 75::double end', 'sex')} as egfr from dr)"
)


@register("synthetic_cases", f"with {GENERATED} select * from sy")
def _(spark, sf):
    stats = synthesize.fit_stage_stats(derived_cases(spark, sf))
    return synthesize.generate(stats, sample_size(spark, sf))


MERGED = f"""{GENERATED}, un as (select false as is_synthetic, 'r' || cast(case_id as varchar) as origin, class, ckd_stage, egfr, sc from dv
 union all select true, 's_' || cast(ckd_stage as varchar) || '_' || cast(draw_idx as varchar), class, ckd_stage, egfr, sc from sy),
mg as (select *, row_number() over (order by {digest('merge', 'origin')}, origin) - 1 as row_idx from un)"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    cases = derived_cases(spark, sf)
    made = synthesize.generate(synthesize.fit_stage_stats(cases), sample_size(spark, sf))
    return synthesize.merge_cases(cases, made)


@register("merged_cases", f"with {MERGED} select is_synthetic, origin, class, ckd_stage, egfr, sc, row_idx from mg")
def _(spark, sf):
    return merged(spark, sf).select("is_synthetic", "origin", "class", "ckd_stage", "egfr", "sc", "row_idx")


@register(
    "case_counts",
    f"""with {MERGED}, x as (select *, {STAGE} <> ckd_stage as odd from mg)
    select 'origin' as section, case when is_synthetic then 'synthetic' else 'real' end as name, count(*) as n from x group by 2
    union all select 'label', 'class_' || cast(class as varchar), count(*) from x group by 2
    union all select 'stage', 'stage_' || cast(ckd_stage as varchar), count(*) from x group by 2
    union all select 'egfr_stage', case when odd then 'disagrees' else 'agrees' end, count(*) from x group by 2
    union all select 'total', 'cases', count(*) from x""",
)
def _(spark, sf):
    return synthesize.describe_cases(merged(spark, sf))


@register(
    "record_counts",
    f"""with {PROGRESS}, x as (select *, {STAGE} <> ckd_stage as odd from pg)
    select 'origin' as section, 'real' as name, count(*) as n from x union all select 'label', 'class_' || cast(class as varchar), count(*) from x group by 2
    union all select 'stage', 'stage_' || cast(ckd_stage as varchar), count(*) from x group by 2
    union all select 'egfr_stage', 'agrees', count(*) from x union all select 'total', 'cases', count(*) from x
    union all select 'progression', direction, count(*) from x group by 2
    union all select 'deferral', 'should_abstain', count(*) filter (ambiguous or {_CONFLICT} or margin <= 3) from x""",
)
def _(spark, sf):
    cases = derived_cases(spark, sf)
    return synthesize.describe_cases(cases.withColumn("is_synthetic", F.lit(False)), c.build_records(cases, "progression"))


@register(
    "first_cases",
    f"with {CLINICAL}, o as (select case_id, row_number() over (order by {digest('shuffle', 'case_id')}, case_id) - 1 as row_idx from cl) select * from o where row_idx < 100",
)
def _(spark, sf):
    shuffled = order.seeded_shuffle(clinical(spark, sf).select("case_id"), ["case_id"], 42)
    return order.first_cases(shuffled, 100)


@register("prepared_records")
def _(spark, sf):
    """The whole preparation with its defaults."""
    config = k.PrepConfig(task="progression")
    records = prepare(raw_cases(spark, sf), config).records
    return records.select("case_id", "row_idx", "label", "metadata.ckd_stage", "metadata.should_abstain")


@register(
    "own_domain",
    "select c_custkey, c_mktsegment, floor(c_acctbal / 1000) as band from customer where c_acctbal is not null",
)
def _(spark, sf):
    """Another domain as a contract and two steps."""
    domain = Domain(
        "accounts",
        ("c_custkey", "c_acctbal"),
        (
            lambda df: df.filter("c_acctbal is not null"),
            lambda df: df.select(
                "c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("double").alias("band")
            ),
        ),
    )
    return domain.run(d.read_table(spark, sf, "customer"))
