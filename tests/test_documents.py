"""Run documents, saved runs, reports and the shared folder."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from abstain_eval.checks.scores import run_table, with_prompts
from abstain_eval.functions.numbers import number_text, round_half_up
from abstain_eval.operators import metrics as m
from abstain_eval.operators import runs, validate
from abstain_eval.session import fresh_path
from abstain_eval.sources import documents


@pytest.fixture(scope="module")
def tables(spark, small):
    e = with_prompts(spark, small)
    table = run_table(e).withColumn("suite", F.lit('{"task": "x"}'))
    return e, m.score_runs(e), runs.execution_summary(e, table), table


def test_pieces_join_to_one_document(spark, tables):
    e, scores, summary, table = tables
    path = fresh_path(spark, "documents")
    documents.write_documents(
        documents.full_documents(scores, summary, table, e, runs.prompt_templates(e)), path
    )
    folder = path.removeprefix("file:")
    names = sorted(glob.glob(f"{folder}/run_id=run_0/part-*"))
    document = json.loads("".join(open(n, encoding="utf-8").read() for n in names))
    rows = document["evaluation_results"]
    assert len(rows) == document["n_evaluation_results"] == 250
    assert [r["case_id"] for r in rows] == sorted(r["case_id"] for r in rows)
    assert set(document["metrics"]) == set(m.METRICS)
    assert document["metrics"]["brier_score"]["value"] is None
    assert len(document["extras"]["prompt_templates"]) == document["extras"]["prompt_templates_count"]


def test_document_without_rows(tables):
    _, scores, summary, table = tables
    pieces = documents.full_documents(scores, summary, table).filter("run_id = 'run_1'")
    text = "".join(r.text for r in sorted(pieces.collect(), key=lambda r: (r.section, r.ord)))
    assert set(json.loads(text)) == {"backend_name", "extras", "metrics", "n_evaluation_results", "suite"}


def test_both_key_styles_read_alike(spark, tmp_path):
    score = {"name": "x", "value": 0.5, "breakdown": {"stage_1": 1.0}, "n_evaluated": 4, "n_abstained": 1, "details": {}}
    undefined = {**score, "value": None, "details": {"reason": "no_rows_with_confidence"}}
    folder = tmp_path / "staging"
    folder.mkdir()
    execution = {"batch_size": 8, "elapsed_seconds": 2.5}
    old = {"execution": execution, "metrics": {"Answer Rate (Coverage)": score, "Brier Score": undefined}}
    new = {"execution": execution, "metrics": {"answer_rate": score, "brier_score": undefined}}
    (folder / "own_model_staging.json").write_text(json.dumps(old, indent=2))
    (folder / "own_model_staging_2.json").write_text(json.dumps(new, indent=2))
    read = documents.read_documents(spark, str(tmp_path))
    rows = documents.document_scores(read).collect()
    assert {(r.model, r.task, r.repeat) for r in rows} == {("own_model", "staging", 1), ("own_model", "staging", 2)}
    assert {r.metric for r in rows} == {"answer_rate", "brier_score"}
    assert {r.reason for r in rows if r.metric == "brier_score"} == {"no_rows_with_confidence"}
    assert documents.document_execution(read).first().elapsed_seconds == 2.5


def test_report_shows_nan_and_four_decimals(spark, tables):
    _, scores, summary, table = tables
    suite = table.selectExpr("run_id", "'seed' as name", "'42' as text")
    lines = runs.report_lines(scores, summary, suite, table).filter("run_id = 'run_0'").orderBy("section", "ord")
    text = [r.line for r in lines.collect()]
    assert text[0] == "Evaluation report" and text[-1] == "Total patient rows: 250"
    assert any(line.startswith("  Brier Score: nan (n_evaluated=") for line in text)
    assert "  records_per_second: None" in text


def test_empty_table_is_a_finding(spark, small):
    from abstain_eval.checks.common import raw_cases

    found = validate.target_violations(raw_cases(spark, small).limit(0)).collect()
    assert "empty_table" in {r["check"] for r in found}


def test_number_text_and_rounding(spark):
    values = [0.0, 0.0007, 5e-05, 12345678.0, 1e16, 1e22, -0.0005, 1.02, 1.1807e21]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(number_text("v")).collect()] == [str(v) for v in values]
    half = spark.createDataFrame([(2.675,), (-2.675,), (None,)], "v double")
    assert [r[0] for r in half.select(round_half_up("v", 2)).collect()] == [2.68, -2.68, None]


def joined(pieces, run):
    rows = sorted(pieces.filter(F.col("run_id") == run).collect(), key=lambda r: (r.section, r.ord))
    return json.loads("".join(r.text for r in rows))


def test_rows_with_equal_or_null_places_make_one_list(spark, tables):
    e, scores, summary, table = tables
    odd = F.when(F.col("case_id") % 3 == 0, None).when(F.col("case_id") % 3 == 1, 5).otherwise(F.col("row_idx"))
    for position in (odd, F.lit(7), F.lit(None).cast("bigint")):
        pieces = documents.full_documents(scores, summary, table, e.withColumn("row_idx", position.cast("bigint")))
        rows = joined(pieces, "run_0")["evaluation_results"]
        assert len(rows) == 250 and len({r["case_id"] for r in rows}) == 250


def test_every_named_run_has_a_document(spark, tables):
    e, scores, summary, table = tables
    some = e.filter("run_id <> 'run_1'")
    pieces = documents.full_documents(
        m.score_runs(some), runs.execution_summary(some, table).filter("run_id <> 'run_3'"), table.filter("run_id <> 'run_2'"), some,
        runs.prompt_templates(some),
    )
    empty, unlisted, unsummed = (joined(pieces, r) for r in ("run_1", "run_2", "run_3"))
    assert empty["evaluation_results"] == [] and empty["n_evaluation_results"] == 0 and empty["metrics"] == {}
    assert unlisted["backend_name"] == "" and unlisted["suite"] == {} and len(unlisted["evaluation_results"]) == 250
    assert set(unsummed["extras"]) == {"prompt_templates"} and unsummed["n_evaluation_results"] == 250
    compact = documents.metric_documents(scores.filter("run_id <> 'run_1'"), summary.filter("run_id <> 'run_2'"))
    found = {r.run_id: json.loads(r.document) for r in compact.collect()}
    assert found["run_1"]["metrics"] == {} and found["run_2"]["execution"] == {} and len(found) == 6


def test_documents_are_read_back_piece_by_piece(spark, tables):
    e, scores, summary, table = tables
    awkward = e.filter("run_id = 'run_0'").withColumn("raw_response", F.lit('a "quoted"\nline, ,{"prompt_mode": 1}'))
    path = fresh_path(spark, "documents")
    own = lambda df: df.filter("run_id = 'run_0'")
    documents.write_documents(documents.full_documents(own(scores), own(summary), own(table), awkward, runs.prompt_templates(awkward)), path)
    saved = documents.read_full_documents(spark, path)
    assert saved.rows.count() == 250 and {r[0] for r in saved.rows.select("raw_response").collect()} == {'a "quoted"\nline, ,{"prompt_mode": 1}'}
    head = saved.heads.first()
    assert (head.run_id, head.n_evaluation_results, json.loads(head.suite)) == ("run_0", 250, {"task": "x"})
    assert saved.scores.count() == len(m.METRICS) and saved.execution.first().n_input_records == 250
    bare = fresh_path(spark, "documents")
    documents.write_documents(documents.full_documents(own(scores), own(summary), own(table)), bare)
    again = documents.read_full_documents(spark, bare)
    assert again.rows.count() == again.templates.count() == 0 and again.heads.first().backend_name == head.backend_name
    assert again.execution.first().batch_size == 8 and again.scores.count() == len(m.METRICS)
