"""Checks and normalisation of a raw case table, by the contract of its domain.

All failures are collected in one table ``(check, column, detail, n, examples)`` with one row
for each distinct finding, how many rows have it, and the first ids among them;
``assert_valid`` raises when it is not empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.functions.text import blank_to_null, normalised
from abstain_eval.schema import KIDNEY, Contract
from abstain_eval.session import cut_lineage

VIOLATION_SCHEMA = "`check` string, `column` string, detail string, n bigint, examples array<string>"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BAD_EXAMPLES = 3  # ids shown with a finding; every finding is counted
SHOWN_FINDINGS = 20


def contract_columns(sex_column: str | None = None, contract: Contract = KIDNEY) -> list[str]:
    return contract.columns + ([sex_column] if sex_column else [])


def header_violations(
    spark: SparkSession, names: Sequence[str], sex_column: str | None = None, contract: Contract = KIDNEY
) -> DataFrame:
    """Repeated, missing and unexpected column names."""
    names, expected = list(names), contract_columns(sex_column, contract)
    rows = [("duplicate_column", c, None, names.count(c), []) for c in sorted({c for c in names if names.count(c) > 1})]
    rows += [("missing_column", c, None, 1, []) for c in sorted(set(expected) - set(names))]
    rows += [("unexpected_column", c, None, 1, []) for c in sorted(set(names) - set(expected))]
    return spark.createDataFrame(rows, VIOLATION_SCHEMA)


def canonical_order(raw: DataFrame, sex_column: str | None = None, contract: Contract = KIDNEY) -> DataFrame:
    return raw.select(*contract_columns(sex_column, contract))


def blanks_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[blank_to_null(c).alias(c) for c in df.columns])


def normalise_text(df: DataFrame) -> DataFrame:
    """Trim and lower-case every text column."""
    text = {name for name, kind in df.dtypes if kind == "string"}
    return df.select(*[(normalised(c) if c in text else F.col(c)).alias(c) for c in df.columns])


def normalised_cells(raw: DataFrame, sex_column: str | None = None, contract: Contract = KIDNEY) -> DataFrame:
    """Canonical order, trimmed lower-case text, blanks as null; each cell is trimmed once."""
    ordered = raw.transform(canonical_order, sex_column, contract).transform(normalise_text)
    return ordered.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ordered.columns])


def number_of(c: str) -> Column:
    """Number in a text cell; text that merely casts to a number is no number."""
    cell = F.col(c)
    return F.when(cell.rlike(NUMBER_PATTERN), cell.try_cast("double"))


def exact_id(c: str) -> Column:
    """Canonical text of an id: whole numbers exactly, whatever their size; other text as it is, null if no number."""
    cell = F.col(c)
    exact = cell.try_cast("decimal(38,10)")
    whole = exact.cast("decimal(38,0)")
    text = F.when(exact == whole, whole.cast("string")).otherwise(cell)
    return F.when(cell.rlike(NUMBER_PATTERN), text)


def coerce_numbers(df: DataFrame, contract: Contract = KIDNEY) -> DataFrame:
    return df.withColumns({c: number_of(c) for c in contract.numeric})


def drop_shifted_values(df: DataFrame, contract: Contract = KIDNEY) -> DataFrame:
    """Values of the neighbouring column count as missing."""
    shifted = {r.name: list(r.shifted) for r in contract.rules if r.shifted}
    return df.withColumns({c: F.when(~F.col(c).isin(values), F.col(c)) for c, values in shifted.items()})


def clean_cases(raw: DataFrame, sex_column: str | None = None, contract: Contract = KIDNEY) -> DataFrame:
    """Canonical, normalised and typed case table."""
    cells = raw.transform(normalised_cells, sex_column, contract)
    return cells.transform(coerce_numbers, contract).transform(drop_shifted_values, contract)


Check = tuple[str, str, Column]


def _bad_cells(cells: DataFrame, checks: list[Check], id_column: str) -> DataFrame:
    """Rows (check, column, detail, row_id, at) of the cells for which a check holds.

    Each row opens only its bad cells, so the table is never unpivoted as a whole. ``at`` is the
    number of a row's id, if it has one.
    """
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    bad,
                    F.struct(
                        F.lit(check).alias("check"),
                        F.lit(column).alias("column"),
                        F.col(column).alias("detail"),
                    ),
                )
                for check, column, bad in checks
            ]
        )
    )
    opened = cells.select(F.col(id_column).cast("string").alias("row_id"), F.explode(found).alias("f"))
    return opened.select("f.*", "row_id", F.col("row_id").try_cast("decimal(38,10)").alias("at"))


def _number_checks(contract: Contract = KIDNEY) -> list[Check]:
    return [("non_numeric", c, F.col(c).isNotNull() & number_of(c).isNull()) for c in contract.numeric]


def _value_checks(contract: Contract = KIDNEY) -> list[Check]:
    return [
        ("unsupported_value", r.name, ~F.col(r.name).isin([value for value, _ in r.codes] + list(r.shifted)))
        for r in contract.rules if r.codes
    ]


FINDING = ["check", "column", "detail"]
PARTIAL = (
    "`check` string, `column` string, detail string, n bigint, "
    "places array<struct<no: boolean, at: decimal(38,10), id: string, row_id: string>>"
)
HELD_FINDINGS = 100_000  # distinct findings that a task holds before it hands them on
LANES = 64


def _partial_findings(cells: DataFrame) -> DataFrame:
    """Distinct findings of each task with their number and their first places."""
    place = pa.struct([("no", pa.bool_()), ("at", pa.decimal128(38, 10)), ("id", pa.string()), ("row_id", pa.string())])
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(place)]

    def batch_of(held: dict) -> pa.RecordBatch:
        rows = [(*key, n, [dict(zip(("no", "at", "id", "row_id"), p[1:], strict=True)) for p in places]) for key, (n, places) in held.items()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*FINDING, "n", "places"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, list]] = {}
        for batch in batches:
            for *key, row_id, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, places = held.get(tuple(key), (0, []))
                mine = ((at is None, at or 0, row_id or ""), at is None, at, row_id or "", row_id)
                if len(places) < BAD_EXAMPLES or mine[0] < places[-1][0]:
                    places = sorted([*places, mine], key=lambda p: p[0])[:BAD_EXAMPLES]
                held[tuple(key)] = n + 1, places
                if len(held) >= HELD_FINDINGS:
                    yield batch_of(held)
                    held = {}
        if held:
            yield batch_of(held)

    return cells.select(*FINDING, "row_id", "at").mapInArrow(fold, PARTIAL)


def _counted(cells: DataFrame) -> DataFrame:
    """Distinct findings with their number of cells and their first ids, in one pass over the cells.

    Every task folds its cells to counts and the three first ids of each finding; these are
    merged in two steps, so that a finding that every task has meets in no long list.
    """

    def merged(parts: DataFrame, *keys: str) -> DataFrame:
        first = F.slice(F.sort_array(F.flatten(F.collect_list("places"))), 1, BAD_EXAMPLES)
        return parts.groupBy(*FINDING, *keys).agg(F.sum("n").alias("n"), first.alias("places"))

    lane = F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane")
    once = merged(_partial_findings(cells).select("*", lane), "lane")
    return merged(once).select(*FINDING, "n", F.transform("places", lambda p: p["row_id"]).alias("examples"))


def cell_violations(cells: DataFrame, checks: list[Check], id_column: str = KIDNEY.id) -> DataFrame:
    return _counted(_bad_cells(cells, checks, id_column))


def number_violations(raw: DataFrame, sex_column: str | None = None, contract: Contract = KIDNEY) -> DataFrame:
    """Every distinct text that is no number, by column."""
    return cell_violations(raw.transform(normalised_cells, sex_column, contract), _number_checks(contract), contract.id)


def value_violations(raw: DataFrame, sex_column: str | None = None, contract: Contract = KIDNEY) -> DataFrame:
    """Every distinct value outside a column's allowed set."""
    return cell_violations(raw.transform(normalised_cells, sex_column, contract), _value_checks(contract), contract.id)


def _target_counts(contract: Contract) -> list[Column]:
    target = F.col(contract.target)
    seen = [F.count_if(target == label).alias(f"n_{i}") for i, label in enumerate(contract.labels)]
    return [F.count(F.lit(1)).alias("rows"), F.count_if(target.isNull()).alias("missing"), *seen]


def _by_id(cells: DataFrame, contract: Contract) -> DataFrame:
    """Rows, missing targets and labels of every missing or repeated id, and of all other ids together.

    Two findings tables read it, so it is written; it has a row for each finding and one more.
    """
    by_id = cells.groupBy(exact_id(contract.id).alias("id")).agg(*_target_counts(contract))
    counts = [c for c in by_id.columns if c != "id"]
    check = F.when(F.col("id").isNull(), "missing_id").when(F.col("rows") > 1, "duplicate_id")
    named = by_id.withColumn("check", check).withColumn("id", F.when(F.col("check").isNotNull(), F.col("id")))
    return cut_lineage(named.groupBy("check", "id").agg(*[F.sum(c).alias(c) for c in counts]))


def _id_findings(by_id: DataFrame, contract: Contract) -> DataFrame:
    return by_id.filter("check is not null").select(
        "check",
        F.lit(contract.id).alias("column"),
        F.coalesce("id", F.col("rows").cast("string")).alias("detail"),
        F.col("rows").alias("n"),
        F.array().cast("array<string>").alias("examples"),
    )


def identifier_violations(raw: DataFrame, sex_column: str | None = None, contract: Contract = KIDNEY) -> DataFrame:
    """Missing ids (one row with their number) and every id that occurs more than once."""
    return _id_findings(_by_id(raw.transform(normalised_cells, sex_column, contract), contract), contract)


def _target_findings(seen: DataFrame, contract: Contract) -> DataFrame:
    """Findings from one row of counts."""

    def finding(check: str, column: str | None, detail: Column, n: Column, when: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(check).alias("check"),
                F.lit(column).cast("string").alias("column"),
                detail.cast("string").alias("detail"),
                n.cast("bigint").alias("n"),
                F.array().cast("array<string>").alias("examples"),
            ),
        )

    findings = [
        finding("empty_table", None, F.lit(None), F.lit(0), F.col("rows") == 0),
        finding("missing_target", contract.target, F.col("missing"), F.col("missing"), F.col("missing") > 0),
    ]
    findings += [
        finding("label_not_seen", contract.target, F.lit(label), F.lit(0), F.col(f"n_{i}") == 0)
        for i, label in enumerate(contract.labels)
    ]
    return seen.select(F.explode(F.array_compact(F.array(*findings))).alias("f")).select("f.*")


def target_violations(raw: DataFrame, sex_column: str | None = None, contract: Contract = KIDNEY) -> DataFrame:
    """An empty table, missing targets and labels that never occur."""
    return _target_findings(raw.transform(normalised_cells, sex_column, contract).agg(*_target_counts(contract)), contract)


def violations(
    raw: DataFrame, names: Sequence[str] | None = None, sex_column: str | None = None, contract: Contract = KIDNEY
) -> DataFrame:
    """All findings on a raw table, from two scans: cells, and one count by id. Cell checks need the whole header."""
    header = header_violations(raw.sparkSession, names or raw.columns, sex_column, contract)
    if set(contract_columns(sex_column, contract)) - set(raw.columns):
        return header
    cells = raw.transform(normalised_cells, sex_column, contract)
    by_id = _by_id(cells, contract)
    counts = [c for c in by_id.columns if c not in ("check", "id")]
    seen = by_id.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])
    return (
        header.unionByName(cell_violations(cells, _number_checks(contract) + _value_checks(contract), contract.id))
        .unionByName(_id_findings(by_id, contract))
        .unionByName(_target_findings(seen, contract))
    )


def assert_valid(findings: DataFrame, source: str = "case table") -> None:
    """Raise on findings, with their number and the first of them."""
    found = cut_lineage(findings)
    total = found.count()
    if total:
        shown = found.orderBy("check", "column", "detail").take(SHOWN_FINDINGS)
        named = [f"{r['check']} {r['column'] or ''} {r['detail'] or ''}".strip() + f" ({r['n']})" for r in shown]
        rest = f" and {total - len(shown)} more" if total > len(shown) else ""
        raise ValueError(f"{source} does not meet the contract, {total} findings: {'; '.join(named)}{rest}")


def missing_profile(clean: DataFrame) -> DataFrame:
    """Row count and missing values: one row per column and one (column null) for all."""
    columns = clean.columns
    counted = clean.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns],
    )
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns]
    entries.append(F.struct(F.lit(None).cast("string").alias("column"), total.alias("n_missing")))
    return counted.select("n_rows", F.inline(F.array(*entries)))


def empty_runs(expected_runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected runs without a single row."""
    return expected_runs.select("run_id").join(
        rows.select("run_id").distinct(), "run_id", "left_anti"
    ).select(
        F.lit("empty_run").alias("check"), F.lit("run_id").alias("column"), F.col("run_id").alias("detail")
    )
