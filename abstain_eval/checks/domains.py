"""Queries of a second domain: graded parts, described by a contract table alone."""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.checks.common import Query, digest, md5_uniform, q9, rounded
from abstain_eval.operators import encode, order, synthesize, validate
from abstain_eval.plans import derived as d
from abstain_eval.plans.domain import prepare_domain
from abstain_eval.schema import ColumnRule, Contract
from abstain_eval.session import fresh_path

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


STYLES = ["economy", "large", "medium", "promo", "small", "standard"]
GRADES = ["low", "mid", "high"]
PARTS = Contract(
    (
        ColumnRule("part", "id"),
        ColumnRule("style", "nominal", tuple((s, float(i)) for i, s in enumerate(STYLES)), ("none",)),
        ColumnRule("bulky", "nominal", (("no", 0.0), ("yes", 1.0))),
        ColumnRule("size", "number", low=1.0, high=50.0),
        ColumnRule("price", "number", low=8000.0, high=10000.0),
        ColumnRule("grade", "target", tuple((g, float(i)) for i, g in enumerate(GRADES))),
    )
)
FEATURES = ["style", "bulky", "size", "price"]

CELLS = {
    "part": "cast(p_partkey as string)",
    "style": "case when p_partkey % 11 = 3 then ' ' when p_partkey % 29 = 2 then 'None' when p_partkey % 7 = 0 then concat(' ', upper(p_type), ' ') else p_type end",
    "bulky": "case when p_partkey % 13 = 5 then null when p_size > 25 then 'yes' else ' No' end",
    "size": "case when p_partkey % 17 = 4 then '' else cast(p_size as string) end",
    "price": "cast(cast(floor(p_retailprice * 10 + 0.5) as bigint) as string)",
    "grade": "case p_partkey % 3 when 0 then 'low' when 1 then 'mid' else 'High' end",
}
DIRTY_CELLS = {
    **CELLS,
    "part": "case when p_partkey % 53 = 2 then cast(p_partkey - 1 as string) else cast(p_partkey as string) end",
    "style": f"case when p_partkey % 37 = 1 then 'odd' else {CELLS['style']} end",
    "size": f"case when p_partkey % 41 = 9 then concat('big', cast(p_partkey % 2 as string)) else {CELLS['size']} end",
}


def _select(cells: dict[str, str]) -> str:
    return "select " + ", ".join(f"{cell} as {name}" for name, cell in cells.items()) + " from part"


def parts(spark: SparkSession, sf_dir: str, cells: dict[str, str] = CELLS) -> DataFrame:
    source = d.spread(d.read_table(spark, sf_dir, "part"), "p_partkey")
    return spark.sql(_select(cells).replace("from part", "from {part}"), part=source)


def contract(spark: SparkSession) -> Contract:
    """The contract as it comes back from a stored table."""
    path = fresh_path(spark, "contract")
    PARTS.to_table(spark).write.parquet(path)
    return Contract.from_table(spark.read.parquet(path))


def frame(spark: SparkSession, sf_dir: str, rules: Contract) -> DataFrame:
    return encode.encoded_frame(validate.clean_cases(parts(spark, sf_dir), contract=rules), contract=rules)


_STYLE = "case lower(p_type) " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(STYLES)) + " end"
FRAME = f"""fr as (select p_partkey::double as part, case when p_partkey % 11 <> 3 and p_partkey % 29 <> 2 then {_STYLE} end::double as style,
 case when p_partkey % 13 <> 5 then (p_size > 25)::int end::double as bulky, case when p_partkey % 17 <> 4 then p_size end::double as size,
 floor(p_retailprice * 10 + 0.5)::double as price, (p_partkey % 3)::int as grade from part)"""

_FIRST = "array_to_string(list_slice(list(id order by id::bigint), 1, 3), ',')"
_DIRTY = f"r as ({_select(DIRTY_CELLS)}), v as (select part as id, size, style from r)"


@register(
    "parts_violations",
    f"""with {_DIRTY} select 'non_numeric' as "check", 'size' as "column", size as detail, count(*) as n, {_FIRST} as examples from v where size like 'big%' group by size
     union all select 'unsupported_value', 'style', 'odd', count(*), {_FIRST} from v where style = 'odd' having count(*) > 0
     union all select 'duplicate_id', 'part', id, count(*), '' from v group by id having count(*) > 1""",
)
def _(spark, sf):
    found = validate.violations(parts(spark, sf, DIRTY_CELLS), contract=contract(spark))
    return found.withColumn("examples", F.array_join("examples", ","))


@register("parts_encoded", f"with {FRAME} select * from fr")
def _(spark, sf):
    return frame(spark, sf, contract(spark))


_WHOLE = "w as (select * from fr where " + " and ".join(f"{c} is not null" for c in FEATURES) + ")"


@register(
    "parts_scaled",
    f"with {FRAME}, {_WHOLE} select part, grade, " + ", ".join(q9(f"({c} - min({c}) over ()) / (max({c}) over () - min({c}) over ())") + f" as {c}" for c in FEATURES) + " from w",
)
def _(spark, sf):
    rules = contract(spark)
    scaled, _ = encode.fit_scale(frame(spark, sf, rules).dropna(), "full", ["part"], rules)
    return rounded(scaled, *FEATURES)


_NUMBER = "select grade, count(*) as n, '{0}' as feature, 'continuous' as kind, {1} as mean, {2} as std from fr group by grade"
_SHARE = "select grade, count(*), 'style={0}', 'share', {1}, null from fr group by grade"


def _share(i: int) -> str:
    return f"avg(case when style is not null then (style = {i})::int end)"


@register(
    "parts_statistics",
    f"with {FRAME} " + " union all ".join(_NUMBER.format(c, q9(f"avg({c})"), q9(f"stddev_samp({c})")) for c in ("size", "price"))
    + f" union all select grade, count(*), 'bulky', 'binary', {q9('avg(bulky)')}, null from fr group by grade union all "
    + " union all ".join(_SHARE.format(s, q9(_share(i))) for i, s in enumerate(STYLES)),
)
def _(spark, sf):
    rules = contract(spark)
    stats = synthesize.fit_stage_stats(frame(spark, sf, rules), rules)
    return rounded(synthesize.stage_stats_long(stats, rules), "mean", "std")


N_SQL = "(select count(*) * 3 + 1 from part)"


@cache
def _synthetic_sql() -> str:
    def number(c: str, low: float, high: float) -> str:
        text = digest(c, "g.grade", "i")
        normal = f"(sqrt(-2 * ln(1 - {md5_uniform(text)})) * cos(2 * pi() * {md5_uniform(text, 1)}))"
        drawn = f"case when coalesce(s_{c}, 0) < 1e-6 then m_{c} else m_{c} + s_{c} * {normal} end"
        return f"(floor(greatest({low}::double, least({high}::double, {drawn})) * 1e4 + 0.5) / 1e4) as {c}"

    u = md5_uniform(digest("style", "g.grade", "i"))
    upto = [" + ".join(["0.0::double", *(f"h_{j}" for j in range(i + 1))]) for i in range(len(STYLES) - 1)]
    style = "case " + " ".join(f"when {u} < {bound} then {i}" for i, bound in enumerate(upto)) + f" else {len(STYLES) - 1} end"
    shares = ", ".join(f"{_share(i)} as h_{i}" for i in range(len(STYLES)))
    return f"""with {FRAME}, st as (select grade, count(*) as n, avg(size) as m_size, stddev_samp(size) as s_size, avg(price) as m_price, stddev_samp(price) as s_price,
      avg(bulky) as m_bulky, {shares} from fr group by grade),
     fl as (select grade, n / (sum(n) over ())::double as share, cast(floor(n / (sum(n) over ())::double * {N_SQL}) as bigint) as part from st),
     al as (select grade, part + case when row_number() over (order by share desc, grade) = 1 then {N_SQL} - sum(part) over () else 0 end as rows from fl),
     g as (select grade, unnest(range(cast(rows as bigint))) as i from al)
     select g.grade, g.i as draw_idx, {number('size', 1, 50)}, {number('price', 8000, 10000)}, ({style})::double as style,
      ({md5_uniform(digest('bulky', 'g.grade', 'i'))} < m_bulky)::int::double as bulky from g join st on st.grade = g.grade"""


@register("parts_synthetic", _synthetic_sql())
def _(spark, sf):
    rules = contract(spark)
    held = frame(spark, sf, rules)
    return synthesize.generate(synthesize.fit_stage_stats(held, rules), held.count() * 3 + 1, 42, rules, None)


@register(
    "parts_prepared",
    f"""with {FRAME} select grade, count(*) as n_rows, 0::bigint as n_missing, 0::bigint as n_changed, 0::bigint as n_outside from fr group by grade""",
)
def _(spark, sf):
    """All five jobs on the raw table: gaps are filled, known cells stay, and scaled cells lie in [0, 1]."""
    rules = contract(spark)
    done = prepare_domain(parts(spark, sf), rules, n_synthetic=50)
    known = frame(spark, sf, rules).select("part", *[F.col(c).alias(f"k_{c}") for c in FEATURES])
    scaled = done.scaled.select("part", *[F.col(c).alias(f"s_{c}") for c in FEATURES])
    rows = done.imputed.join(known, "part").join(scaled, "part")
    ones = lambda test: reduce(lambda x, y: x + y, [F.coalesce(test(c), F.lit(False)).cast("bigint") for c in FEATURES])
    return rows.groupBy("grade").agg(
        F.count("*").alias("n_rows"), F.sum(ones(lambda c: F.col(c).isNull())).alias("n_missing"),
        F.sum(ones(lambda c: F.col(c) != F.col(f"k_{c}"))).alias("n_changed"),
        F.sum(ones(lambda c: ~F.col(f"s_{c}").between(-1e-9, 1 + 1e-9))).alias("n_outside"),
    )


# --- many labels and many strata -------------------------------------------------


@register(
    "part_name_codes",
    "select label, (row_number() over (order by label) - 1)::int as code from (select distinct p_name || ' ' || p_partkey as label from part) x",
)
def _(spark, sf):
    """Codes of as many labels as there are parts."""
    names = d.read_table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("label"))
    return encode.label_classes(names, "label")


@register(
    "quotas_by_customer",
    """with c as (select o_custkey as s, count(*) as n from orders group by o_custkey), t as (select sum(n)::bigint as a, (sum(n) - ceil(sum(n) * 0.2::double))::bigint as train from c),
     p as (select s, n, (n::hugeint * train) // a as part, (n::hugeint * train) % a as rest, train from c, t),
     r as (select *, row_number() over (order by rest desc, s) as place, train - sum(part) over () as spare from p)
     select s as o_custkey, n::bigint as n, (n - part - case when place <= spare then 1 else 0 end)::bigint as quota from r""",
)
def _(spark, sf):
    """Quotas with one stratum for each customer."""
    counts = d.read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return order.split_quotas(counts, "o_custkey", 0.2)
