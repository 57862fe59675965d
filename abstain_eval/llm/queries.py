"""Queries of the corpus operators over the whole given tables, and the SQL that checks some of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.llm import (
    conversations, cross_polytope, edit_embedding, hard_negatives, kneser_ney, language, mixing, packing, page_difference,
    quality, simhash, substrings, toxicity,
)
from abstain_eval.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.compared_with_edits(table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.language_model_scores(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "row.source", "row.text", "copy", "n_copies", "draw")


def op9_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_difference.main_texts(table(spark, sf_dir, "pages"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(*conversations.damage(table(spark, sf_dir, "conversations")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), moved)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_edit_embedding, op2_cross_polytope, op3_best_fit_packing, op4_kneser_ney, op5_simhash, op6_quality,
        op7_toxicity, op8_source_mix, op9_page_difference, op10_language, op11_conversations,
        op12_hard_negatives, op13_substrings,
    )
}

SOURCE_MIX = f"""
with sizes as (select source, count(*) as n, sqrt(count(*)) as weight from documents group by source),
rates as (select source, weight / (select sum(weight) from sizes) * (select sum(n) from sizes) / n as rate from sizes),
chances as (select source, i, sum(exp(-rate + i * ln(rate) - lgamma(i + 1)))
    over (partition by source order by i rows between unbounded preceding and current row) as cumulative
    from rates, range(0, 400) as r(i)),
drawn as (select doc_id, source, text,
    ('0x' || substr(md5('{mixing.SEED}|copies|' || doc_id), 1, 13))::bigint / 4503599627370496.0::double as u from documents),
counted as (select d.doc_id, d.source, any_value(d.text) as text, count(*) filter (where c.cumulative <= d.u)::int as n_copies
    from drawn d join chances c on c.source is not distinct from d.source group by d.doc_id, d.source)
select doc_id, source, text, c.copy::int as copy, n_copies,
    ('0x' || substr(md5('{mixing.SEED}|order|' || doc_id || '|' || c.copy), 1, 13))::bigint / 4503599627370496.0::double as draw
from counted, unnest(range(0, n_copies)) as c(copy)
"""

SUBSTRINGS = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
placed as (select doc_id, i, words[i] as word, case when i + 34 <= len(words) then md5(array_to_string(words[i:i + 34], ' ')) end as key
    from texts, unnest(range(1, len(words) + 1)) as r(i)),
marked as (select doc_id, i, word, key is not null and count(*) over (partition by key) > 1 as repeated from placed),
covered as (select doc_id, i, word,
    bool_or(repeated) over (partition by doc_id order by i rows between 34 preceding and current row) as gone from marked),
kept as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
    string_agg(word, ' ' order by i) filter (where not gone) as text from covered group by doc_id)
select d.doc_id, coalesce(k.n_words, 0) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from documents d left join kept k on k.doc_id = d.doc_id
"""

HARD_NEGATIVES = """
with rows as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [floor(256 * x::double) for x in embedding] as q from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
        and list_bool_and([coalesce(isfinite(x), false) for x in embedding])),
scored as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_dot_product(a.q, r.q)::bigint as score
    from rows a join rows r on a.vec_id % 50 = 0 and r.vec_id <> a.vec_id and len(a.q) = len(r.q)),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id,
    (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
    s.vec_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
    and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3
"""

ORACLES = {"op8_source_mix": SOURCE_MIX, "op12_hard_negatives": HARD_NEGATIVES, "op13_substrings": SUBSTRINGS}
