"""Answer parsing, batches, rounds and prompts on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from abstain_eval import contracts as k
from abstain_eval.operators import answers as a
from abstain_eval.operators import requests as r
from abstain_eval.operators import runs
from abstain_eval.plans import evaluate
from abstain_eval.sources.ledger import CallLedger


def parsed(spark, raw, task="detection"):
    df = spark.createDataFrame([(raw, task)], "raw_response string, task string")
    return a.parse_answers(df).first()


@pytest.mark.parametrize(
    "raw, task, prediction, abstained, confidence, path",
    [
        ('{"abstained": false, "confidence": 0.9, "prediction": 1}', "detection", "1", False, 0.9, "json"),
        ('```json\n{"prediction": 0}\n```', "detection", "0", False, None, "json"),
        ("I abstain from this", "detection", None, True, None, "phrase"),
        ('{"prediction": " Worsening "}', "progression", "worsening", False, None, "json"),
        ('{"abstained": false, "prediction": 1', "detection", None, True, None, "phrase"),
        ('{"prediction": 1}}', "detection", None, False, None, "none"),
        ('{"prediction": 1} then {"x": 2}', "detection", None, False, None, "none"),
        ('{"prediction": 1, "prediction": 0}', "detection", "0", False, None, "json"),
        ("``````", "detection", None, False, None, "none"),
        ('{"abstained": "false", "prediction": 2}', "detection", "2", True, None, "json"),
        ('{"abstained": 0, "prediction": -0.5}', "detection", "0", False, None, "json"),
        ('{"abstained": [], "prediction": true}', "detection", "1", False, None, "json"),
        ('{"prediction": "03"}', "staging", "3", False, None, "json"),
        ('{"confidence": -3}', "staging", None, False, 0.0, "json"),
        ("[1]", "staging", None, False, None, "none"),
    ],
)
def test_single_answers(spark, raw, task, prediction, abstained, confidence, path):
    row = parsed(spark, raw, task)
    assert (row.prediction, row.abstained, row.confidence, row.parse_path) == (
        prediction, abstained, confidence, path,
    )


def test_unreadable_prediction_is_an_error(spark):
    assert parsed(spark, '{"prediction": "1.0"}').parse_error == "prediction_not_an_integer"


def test_every_answer_is_kept_or_quarantined(spark):
    raws = ['{"prediction": 1}', "who knows", '{"prediction": "x"}', "", None, "cannot answer"]
    df = a.parse_answers(spark.createDataFrame([(x, "detection") for x in raws], "raw_response string, task string"))
    kept, bad = a.apply_malformed_policy(df, "error")
    assert kept.count() == 2 and bad.count() == 4
    every, none = a.apply_malformed_policy(df, "abstain")
    assert every.count() == 6 and none.count() == 0
    row = every.filter("raw_response = 'who knows'").first()
    assert row.prediction is None and row.abstained


def batch(spark, raw, size, task="detection"):
    df = spark.createDataFrame([("r", 0, task, size, raw)], "run_id string, batch_id bigint, task string, size int, raw_response string")
    good, bad = a.parse_batches(df)
    return {x.slot: x for x in good.collect()}, bad.collect()


def test_batch_in_reverse_order(spark):
    good, bad = batch(spark, '{"results":[{"id":"case_1","prediction":1},{"id":"case_0","prediction":0}]}', 2)
    assert not bad and good[0].prediction == "0" and good[1].prediction == "1"


def test_missing_comma_is_repaired(spark):
    good, bad = batch(spark, '{"results":[{"id":"case_0","prediction":1}{"id":"case_1","prediction":0}]}', 2)
    assert not bad and len(good) == 2


def test_last_of_two_results_counts_and_extras_are_dropped(spark):
    items = [{"id": "case_0", "prediction": 0}, {"id": "case_0", "prediction": 1}, {"id": "case_7"}]
    good, bad = batch(spark, json.dumps({"results": items}), 1)
    assert not bad and good[0].prediction == "1" and "id" not in json.loads(good[0].raw_response)


def test_missing_id_rejects_the_batch(spark):
    good, bad = batch(spark, '{"results":[{"id":"case_0","prediction":1}]}', 2)
    assert not good and bad[0].reason == "missing_ids" and bad[0].missing_ids == ["case_1"]


def test_one_bad_prediction_rejects_the_batch(spark):
    good, bad = batch(spark, '{"results":[{"id":"case_0","prediction":"x"},{"id":"case_1","prediction":1}]}', 2)
    assert not good and bad[0].reason == "prediction_not_an_integer"


def test_batch_tokens_are_shared(spark):
    df = spark.createDataFrame([(100.0, 20.0, 120.0, 2)], "input_tokens double, output_tokens double, total_tokens double, size int")
    row = a.spread_usage(df).first()
    assert (row.input_tokens, row.output_tokens, row.total_tokens) == (50.0, 10.0, 60.0)


def test_retryable_status(spark):
    df = spark.createDataFrame([(429, None, 0), (401, None, 0), (None, "RateLimitError", 5)], "status int, error_name string, attempt int")
    got = a.classify_errors(df).collect()
    assert [x.retryable for x in got] == [True, False, True]
    assert [x.next_delay for x in got] == [1.0, None, None]


def records(spark, n):
    features = F.create_map(F.lit("sc"), F.col("id") / 2)
    return spark.range(n).select(
        F.lit("r").alias("run_id"), F.col("id").alias("case_id"), F.col("id").alias("row_idx"),
        F.lit("detection").alias("task"), features.alias("features"),
        F.lit(None).cast("map<string,double>").alias("baseline"), F.lit(None).cast("map<string,double>").alias("current"),
        F.lit(None).cast("int").alias("trajectory_months"), (F.col("id") % 2).cast("string").alias("label"),
        F.struct(F.lit(1).alias("ckd_stage"), F.lit(False).alias("should_abstain")).alias("metadata"),
    )


def echo_model(fail_above, single="{\"prediction\": 1}"):
    def answer(frames):
        import json as j

        import pandas as pd

        for frame in frames:
            out = []
            for q in frame.itertuples():
                if q.mode == "single":
                    text = single
                elif q.size > fail_above:
                    text = "broken"
                else:
                    text = j.dumps({"results": [{"id": f"case_{i}", "prediction": int(c) % 2} for i, c in enumerate(q.case_ids)]})
                out.append((q.run_id, q.batch_id, q.task, q.mode, text, "stop", "{}", "openai"))
            yield pd.DataFrame(out, columns=["run_id", "batch_id", "task", "mode", "raw_response", "finish_reason", "usage", "provider"])

    return answer


def test_failed_batches_are_halved(spark):
    done = evaluate.run_rounds(records(spark, 3), echo_model(1), 3)
    rows = done.evaluations.collect()
    assert sorted(x.case_id for x in rows) == [0, 1, 2]
    assert all(x.prediction == x.ground_truth for x in rows)
    per_round = {x["round"]: x["count"] for x in done.requests.groupBy("round").count().collect()}
    assert per_round == {0: 1, 1: 2, 2: 2}
    assert runs.call_counts(done.requests).first().split_calls == 4


def test_rejected_single_cases_go_alone_and_to_quarantine(spark):
    alone = evaluate.run_rounds(records(spark, 2), echo_model(0), 2)
    assert alone.evaluations.count() == 2 and alone.quarantine.count() == 0
    lost = evaluate.run_rounds(records(spark, 2), echo_model(0, "no idea"), 2)
    assert lost.evaluations.count() == 0 and lost.quarantine.count() == 2


def test_system_text_is_folded(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", "u")],), ([("user", "u")],), ([("system", "s"), ("assistant", "a")],)], f"messages {r.MESSAGES}")
    got = [[tuple(m) for m in x[0]] for x in df.select(r.fold_system("messages")).collect()]
    assert got == [[("user", "s\n\nu")], [("user", "u")], [("user", "s"), ("assistant", "a")]]


def test_settings_left_out_are_absent(spark):
    batched = r.build_batches(r.assign_batches(records(spark, 3), 2))
    body = json.loads(r.payloads(batched, "m").first().body)
    assert set(body) == {"model", "messages", "response_format"}
    assert body["response_format"]["json_schema"]["strict"] is True


def test_redaction_hides_every_marker(spark):
    rows = r.with_messages(records(spark, 2)).select(r.redact("messages").alias("m")).collect()
    assert {x.m[1]["content"] for x in rows} == {k.REDACTED_MARKERS}


def test_prompt_reads_back_to_features(spark):
    text = r.with_messages(records(spark, 3)).orderBy("case_id").collect()[2].messages[1]["content"]
    assert "- sc: 1.0" in text.split("\n")


def test_batch_size_is_checked(spark):
    with pytest.raises(ValueError):
        r.assign_batches(records(spark, 1), 0)


def failing(model, error, when):
    def answer(frames):
        for frame in frames:
            if any(when(q) for q in frame.itertuples()):
                raise error("lost")
            yield from model(iter([frame]))

    return answer


def test_gaps_and_lost_replies_end_somewhere(spark):
    held = records(spark, 24).filter("row_idx % 3 = 0")
    done = evaluate.run_rounds(held, echo_model(9), 4)
    assert done.evaluations.count() == 8 and done.requests.count() == 2
    silent = evaluate.run_rounds(held, lambda frames: (f.head(0).assign(raw_response="") for f in frames), 4)
    assert silent.evaluations.count() == 0
    assert [r["reason"] for r in silent.quarantine.collect()] == ["no_reply"] * 8


def test_only_failed_calls_are_repeated(spark):
    held = records(spark, 6)
    once = failing(echo_model(9), ConnectionError, lambda q: q.attempt == 0 and q.batch_id == 1)
    done = evaluate.run_rounds(held, once, 2, max_concurrency=1)
    assert done.evaluations.count() == 6
    assert done.requests.groupBy("round").count().orderBy("round").collect() == [(0, 3), (1, 1)]
    never = evaluate.run_rounds(held, failing(echo_model(9), ConnectionError, lambda q: 2 in q.case_ids), 2, max_retries=1)
    assert sorted(r["case_id"] for r in never.quarantine.collect()) == [2, 3]
    assert {r["reason"] for r in never.quarantine.collect()} == {"call_failed:ConnectionError"}


def test_second_replies_are_refused(spark):
    model = echo_model(9)

    def twice(frames):
        for frame in frames:
            for _ in range(2):
                yield from model(iter([frame]))

    with pytest.raises(ValueError, match="more than one reply"):
        evaluate.run_rounds(records(spark, 2), twice, 2)


def test_calls_use_several_tasks(spark):
    many = records(spark, 200)
    sent = r.single_requests(many.withColumn("batch_id", F.col("case_id")))
    asked = r.answer_requests(sent, echo_model(9), 6)
    assert asked.rdd.getNumPartitions() == 6
    assert asked.select(F.spark_partition_id()).distinct().count() > 3


def counting(model, folder):
    """A model that leaves a file for every call."""

    def answer(frames):
        import os
        import uuid

        for frame in frames:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            yield from model(iter([frame]))

    return answer


def test_a_second_job_asks_nothing_that_is_on_record(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    held, ledger = records(spark, 10), CallLedger(str(tmp_path / "ledger"), calls_per_commit=2)
    model = counting(echo_model(3), str(calls))
    first = evaluate.run_rounds(held, model, 4, ledger=ledger)
    ends = lambda done: sorted(map(tuple, done.evaluations.select("case_id", "prediction", "raw_response").collect()))
    asked, want = len(list(calls.iterdir())), ends(first)
    assert asked == first.requests.count() == ledger.entries(spark).count()
    again = evaluate.run_rounds(held, model, 4, ledger=ledger)
    assert ends(again) == want and len(list(calls.iterdir())) == asked
    more = evaluate.run_rounds(records(spark, 12), model, 4, ledger=ledger)
    assert more.evaluations.count() == 12 and len(list(calls.iterdir())) > asked  # the last batch is another one now


def test_failed_calls_stand_or_are_asked_again(spark, tmp_path):
    held, path = records(spark, 4), str(tmp_path / "ledger")
    broken = failing(echo_model(9), ValueError, lambda q: q.batch_id == 1)
    first = evaluate.run_rounds(held, broken, 2, ledger=CallLedger(path))
    assert first.evaluations.count() == 2 and first.quarantine.count() == 2
    stands = evaluate.run_rounds(held, echo_model(9), 2, ledger=CallLedger(path))
    assert stands.evaluations.count() == 2 and stands.quarantine.count() == 2
    mended = evaluate.run_rounds(held, echo_model(9), 2, ledger=CallLedger(path, ask_failed_again=True))
    assert mended.evaluations.count() == 4 and mended.quarantine.count() == 0
    assert evaluate.run_rounds(held, broken, 2, ledger=CallLedger(path)).evaluations.count() == 4  # the last entry counts


def test_paused_rounds_say_what_is_open(spark):
    done = evaluate.run_rounds(records(spark, 6), echo_model(1), 2, pause_after=1)
    rest = evaluate.run_rounds(records(spark, 6), echo_model(1), 2)
    assert done.open.count() + done.evaluations.count() + done.quarantine.count() == 6
    assert done.open.count() > 0 and rest.open.count() == 0


def test_records_that_cannot_be_told_apart_are_refused(spark):
    held = records(spark, 6)
    case, run = F.col("case_id"), F.col("run_id")
    bad = held.withColumns({"case_id": F.when(case == 0, None).when(case == 1, 2).otherwise(case), "run_id": F.when(case != 5, run)})
    done = evaluate.run_rounds(bad, echo_model(9), 2)
    assert sorted(r["case_id"] for r in done.evaluations.collect()) == [3, 4]
    assert sorted(r["reason"] for r in done.quarantine.collect()) == ["no_case_id", "no_run_id", "repeated_case_id", "repeated_case_id"]
    none = evaluate.run_rounds(held.withColumn("run_id", F.lit(None).cast("string")), echo_model(9), 2)
    assert none.evaluations.count() == none.requests.count() == 0 and none.quarantine.count() == 6
    with pytest.raises(ValueError, match="no records"):
        evaluate.run_rounds(held.limit(0), echo_model(9), 2)


def stepping_clock(folder):
    """A clock in a file: waiting moves it, and every wait is noted."""
    import os

    place = os.path.join(folder, "now")

    def now():
        with open(place) as f:
            return float(f.read())

    def wait(seconds):
        later = now() + seconds
        with open(place, "w") as f:
            f.write(repr(later))
        with open(os.path.join(folder, "waits"), "a") as f:
            f.write(f"{seconds}\n")

    with open(place, "w") as f:
        f.write("1000.0")
    return now, wait


def test_calls_keep_to_their_times(spark, tmp_path):
    now, wait = stepping_clock(str(tmp_path))
    pacing = r.Pacing(per_second=2.0, base_delay=8.0, clock=now, wait=wait)
    once = failing(echo_model(9), ConnectionError, lambda q: q.attempt == 0 and q.batch_id == 1)
    done = evaluate.run_rounds(records(spark, 6), once, 2, max_concurrency=1, pacing=pacing)
    assert done.evaluations.count() == 6
    waits = [float(w) for w in (tmp_path / "waits").read_text().split()]
    assert waits == [0.5, 0.5, 8.0]  # three batches, two a second, and the repeat
    with pytest.raises(ValueError, match="positive"):
        r.Pacing(per_second=0)


@pytest.mark.parametrize("by_request", [True, False])
def test_replies_are_handed_on_together(by_request):
    import pandas as pd

    def reply(request):
        if request.batch_id % 7 == 0:
            raise ConnectionError("lost")
        return None if request.batch_id % 5 == 0 else {"raw_response": f"text {request.batch_id}"}

    each = r.each_request(reply)
    ids = range(2 * r.REPLIES_AT_ONCE + 500)
    frame = pd.DataFrame({"run_id": "a", "batch_id": ids, "task": "detection", "mode": "single"})
    got = list(r.guarded(each if by_request else lambda frames: each(frames))(iter([frame])))
    assert len(got) == 3
    found = {row.batch_id: row.error_name if isinstance(row.error_name, str) else row.raw_response for part in got for row in part.itertuples()}
    assert found == {i: "ConnectionError" if i % 7 == 0 else f"text {i}" for i in ids if i % 7 == 0 or i % 5}
