"""Contracts as tables, numbering, quotas and findings by hand."""

import math

import pytest
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.checks import domains
from abstain_eval.operators import encode, order, synthesize, validate
from abstain_eval.schema import KIDNEY, ColumnRule, Contract


@pytest.mark.parametrize("contract", [KIDNEY, domains.PARTS])
def test_contract_comes_back_from_its_table(spark, contract):
    again = Contract.from_table(contract.to_table(spark).repartition(3))
    assert again.columns == contract.columns and again.strata == contract.strata
    for rule in contract.rules:
        other = again.by_name[rule.name]
        assert dict(other.codes) == dict(rule.codes) and set(other.shifted) == set(rule.shifted)
        assert (other.kind, other.low, other.high, other.feature, other.ceiled, dict(other.sets)) == (
            rule.kind, rule.low, rule.high, rule.feature, rule.ceiled, dict(rule.sets)
        )


def test_default_contract_is_the_fixed_one():
    assert KIDNEY.numbers == k.NUMERIC_FEATURES and KIDNEY.nominal == k.NOMINAL_COLUMNS
    assert KIDNEY.feature_set("reduced") == k.REDUCED_FEATURES and KIDNEY.labels == k.LABEL_CLASSES
    assert synthesize.drawn_numbers(KIDNEY) == list(k.CONTINUOUS_BOUNDS)


def test_contracts_are_checked():
    with pytest.raises(ValueError, match="unknown kind"):
        ColumnRule("a", "text")
    with pytest.raises(ValueError, match="one id column, not 0"):
        Contract((ColumnRule("a", "target"),))
    with pytest.raises(ValueError, match="unknown feature set"):
        domains.PARTS.feature_set("reduced")


def test_rows_are_numbered_in_order(spark):
    rows = [(i * 7919 % 501, i) for i in range(501)] + [(None, 600)]
    df = spark.createDataFrame(rows, "v int, other int").repartition(4)
    found = order.numbered(df, ["v"]).orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(502))
    assert [r["v"] for r in found] == [None, *range(501)]
    down = order.numbered(df, [F.col("v").desc()]).orderBy("position").collect()
    assert [r["v"] for r in down] == [*range(500, -1, -1), None]
    assert order.numbered(df.limit(0), ["v"]).collect() == []


def test_label_codes_use_several_tasks(spark):
    labels = spark.range(5000).select(F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("x"))
    codes = encode.label_classes(labels.unionAll(labels), "x")
    found = codes.withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 5000 and all(int(r["label"][1:]) == r["code"] for r in found)
    assert len({r["task"] for r in found}) > 1


def plain_quotas(counts, size):
    every = sum(counts.values())
    train = every - math.ceil(every * size)
    parts = {s: n * train // every for s, n in counts.items()}
    spare = train - sum(parts.values())
    most = sorted(counts, key=lambda s: (-(counts[s] * train % every), s))[:spare]
    return {s: n - parts[s] - (s in most) for s, n in counts.items()}


@pytest.mark.parametrize("size", [0.2, 0.33, 0.5, 0.01])
def test_quotas_by_largest_remainder(spark, size):
    for counts in ({i: 1 for i in range(300)}, {i: 1 + i * i % 17 for i in range(200)}, {0: 10**12, 1: 3, 2: 3}, {5: 4}):
        df = spark.createDataFrame(list(counts.items()), "s int, n bigint")
        found = {r["s"]: r["quota"] for r in order.split_quotas(df, "s", size).collect()}
        assert found == plain_quotas(counts, size)


def test_findings_fold_in_tasks(spark, monkeypatch):
    """Whatever a task holds before it hands findings on, numbers and first ids are the same."""
    rows = [(str(i) if i % 5 else None, f"bad{i % 3}" if i % 2 else str(i)) for i in range(200)] + [("x", "bad1"), ("-7", "bad1")]
    df = spark.createDataFrame(rows, "id string, v string").repartition(6)
    checks = [("non_numeric", "v", validate.number_of("v").isNull())]
    want = {}
    for i, v in rows:
        if v.startswith("bad"):
            want.setdefault(v, []).append(i)
    place = lambda i: (0, float(i), "") if i and i.lstrip("-").isdigit() else (1, 0.0, i or "")
    want = {v: (len(ids), sorted(ids, key=place)[:3]) for v, ids in want.items()}
    for held in (1, 2, 100_000):
        monkeypatch.setattr(validate, "HELD_FINDINGS", held)
        found = validate.cell_violations(df, checks).collect()
        assert {r["detail"]: (r["n"], r["examples"]) for r in found} == want


def test_findings_take_one_scan_beside_that_of_ids(spark, tmp_path, small):
    domains.parts(spark, small, domains.DIRTY_CELLS).write.parquet(str(tmp_path / "raw"))
    found = validate.violations(spark.read.parquet(str(tmp_path / "raw")), contract=domains.PARTS)
    assert found.count() > 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") <= 1


def test_codes_are_drawn_by_their_shares(spark):
    contract = domains.PARTS
    stats = spark.range(1).select(
        F.lit(0).alias("grade"), F.lit(10).cast("bigint").alias("n"), *[F.lit(5.0).alias(f"{m}_{c}") for c in ("size", "price") for m in ("mean", "std")],
        F.lit(0.25).alias("mean_bulky"), *[F.lit({1: 0.5, 4: 0.5}.get(i, 0.0)).alias(f"share_style_{i}") for i in range(6)],
    )
    made = synthesize.generate(stats, 2000, 1, contract, None)
    counted = {r["style"]: r["count"] for r in made.groupBy("style").count().collect()}
    assert set(counted) == {1.0, 4.0} and abs(counted[1.0] - 1000) < 120
    assert abs(made.agg(F.avg("bulky")).first()[0] - 0.25) < 0.05
    assert made.filter("not (size between 1 and 50 and price between 8000 and 10000)").isEmpty()
