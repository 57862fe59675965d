"""Every operator over awkward rows and over empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import odd
from abstain_eval.llm import edit_embedding, kneser_ney, language, mixing, packing, quality, simhash, toxicity

PER_ROW = {
    "fingerprints": lambda d, l: edit_embedding.compared_with_edits(d),
    "words": lambda d, l: kneser_ney.language_model_scores(d),
    "simhash": lambda d, l: simhash.near_duplicates(d),
    "quality": lambda d, l: quality.quality_scores(d, l),
    "toxicity": lambda d, l: toxicity.toxicity_scores(d, l),
    "language": lambda d, l: language.languages(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_for_every_row(spark, name):
    found = PER_ROW[name](odd.documents(spark), odd.labels(spark)).collect()
    assert len(found) == len(odd.rows())
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in odd.rows())


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables(spark, name):
    assert PER_ROW[name](odd.documents(spark, True), odd.labels(spark, True)).collect() == []
    assert PER_ROW[name](odd.documents(spark, True), odd.labels(spark)).collect() == []


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_no_labels(spark, name):
    found = PER_ROW[name](odd.documents(spark), odd.labels(spark, True)).collect()
    assert len(found) == len(odd.rows()) and all(0 <= r["score"] <= 1 for r in found)


def test_pieces_cover_every_row(spark):
    found = packing.pack(odd.documents(spark)).collect()
    assert sum(r["piece"] == 0 for r in found) == len(odd.rows())
    assert packing.pack(odd.documents(spark, True)).collect() == []


def test_mix_of_awkward_rows(spark):
    mixed = mixing.replicated(odd.documents(spark), temperature=1.0).collect()  # every rate is 1
    assert {r["rate"] for r in mixed} == {1.0}
    assert mixing.mix(odd.documents(spark, True)).collect() == []
    nothing = odd.documents(spark).filter("source is null")
    targets = spark.createDataFrame([(None, 3.0), ("gone", 1.0), ("a", None), ("b", -1.0)], "source string, weight double")
    assert {r["rate"] for r in mixing.replicated(nothing, targets).collect()} <= {1.0}  # shares are over the sources that are there
    kept = mixing.mix(odd.documents(spark), targets).select("row.*")
    assert all(r["source"] is None for r in kept.collect()) and kept.columns == odd.documents(spark).columns


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_keep_columns(spark, tmp_path, empty):
    for name, frame in (("documents", odd.documents(spark, empty)), ("labels", odd.labels(spark, empty))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.filter("piece = 0").count() == docs.count()


def test_near_dedup_keeps_one_of_each_group(spark):
    kept = simhash.first_of_each(odd.documents(spark)).select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(1) == 1 and 2 not in ids
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id here"]
    assert 4 in ids and 5 not in ids and 6 not in ids  # empty, null and blank texts are one group


def test_language_of_nothing_is_unknown(spark):
    found = {r["doc_id"]: r for r in language.languages(odd.documents(spark)).filter(F.col("doc_id").isNotNull()).collect()}
    for i in (4, 5, 6, 10):
        assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    docs = spark.createDataFrame([(0, odd.PLAIN), (1, odd.PLAIN), (1, "Quite another text about nothing else at all."), (1, odd.PLAIN)], "doc_id long, text string")
    kept = sorted(tuple(r) for r in simhash.first_of_each(docs).collect())
    assert kept == [(0, odd.PLAIN), (1, "Quite another text about nothing else at all.")]


def test_language_stage_fills_in_what_it_finds(spark):
    texts = {"en": "the river runs to the sea and the road follows it", "de": "der Fluss fliesst zum Meer und die Strasse folgt ihm"}
    rows = [(i, texts[lang], lang if i < 40 else None) for i in range(44) for lang in texts]
    docs = spark.createDataFrame([*rows, (99, "12 34", None)], "doc_id long, text string, lang string")
    kept = language.in_known_language(docs).collect()
    assert len(kept) == 88 and all(r["text"] == texts[r["lang"]] for r in kept)
    assert {r["lang"] for r in language.in_known_language(docs, ["de"]).collect()} == {"de"}
    assert language.in_known_language(docs, least_score=1.1).collect() == []


def test_lean_workers_keep_few_words_and_give_the_same_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAN_WORDS", 5)
    texts = [" ".join(f"word{i * j % 97} Ünder ,x" for j in range(50)) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    plain, lean = (sorted(map(tuple, packing.pieces(docs, 64, lean=x).collect())) for x in (False, True))
    assert plain == lean

    def kept(batches):
        import pyarrow as pa

        held = packing.word_tokenizer(packing.tokenizer_path()).known
        yield from (pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"]) for _ in batches)

    packing.pieces(docs, 64, lean=True).write.format("noop").mode("overwrite").save()
    assert max(x.n for x in docs.select("doc_id").mapInArrow(kept, "n long").collect()) == 0
