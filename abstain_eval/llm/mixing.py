"""Mixing of sources to target weights by Poisson replication.

A source's rate is its target share of the mixed rows over its share of the given rows. Every
document draws its number of copies from the Poisson distribution with that mean: a digest of
seed and document gives a uniform number, and the copies are the number of cumulative
probabilities at or below it. Documents are exploded by their copies and dealt out by another
digest, so the order is random over the whole output and the same on every run.

Sources without a target share get none (rate 0); a null source is a source of its own, and the
target table names it by null. Without a target table every source weighs as its number of
documents to the power `temperature`. A null id draws by the digest of its text; repeated rows
draw alike. Null and empty texts are rows like any other. An empty table gives an empty result.

Only DataFrame functions are used. Sources are counted with partial sums, and the table of
rates is joined as its size allows; no row of a large source waits for the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval.llm.common import written
from abstain_eval.session import cut_lineage

SEED = 42
TEMPERATURE = 0.5
TAIL = 12  # standard deviations of the distribution that the table of probabilities covers


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1 by the digest of the parts (52 bits)."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def cumulative_poisson(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2 ... copies, as far as they can matter.

    Logarithms keep the first terms of a large mean from vanishing.
    """
    last = F.ceil(rate + TAIL * F.sqrt(rate) + 24).cast("int")
    start = F.struct((-rate).alias("log"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))

    def step(state: Column, i: Column) -> Column:
        log = F.when(i == 0, -rate).otherwise(state["log"] + F.log(rate) - F.log(i.cast("double")))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    probabilities = F.aggregate(F.sequence(F.lit(0), last), start, step, lambda state: state["all"])
    return F.when(rate > 0, probabilities).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, targets: DataFrame | None = None, temperature: float = TEMPERATURE, source: str = "source") -> DataFrame:
    """source, n_source, rate and cumulative probabilities of every source in `docs`.

    `targets` has columns source and weight; weights need not sum to 1, and a weight that is
    null or not above 0 counts as none.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_source"))
    if targets is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n_source").cast("double"), F.lit(temperature)))
    else:
        wanted = targets.groupBy(F.col("source").alias("t")).agg(F.sum(F.greatest(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"))
        weighted = sizes.join(wanted, F.col("source").eqNullSafe(F.col("t")), "left").drop("t").fillna(0.0, ["weight"])
    weighted = cut_lineage(weighted)  # a row for each source
    total = weighted.agg(F.sum("n_source").alias("n_all"), F.sum("weight").alias("weights")).first()
    share = F.col("weight") / F.lit(total["weights"]) if total["weights"] else F.lit(0.0)
    rated = weighted.withColumn("rate", share * F.lit(total["n_all"]) / F.col("n_source"))
    return rated.select("source", "n_source", "rate", cumulative_poisson(F.col("rate")).alias("cumulative"))


def replicated(docs: DataFrame, targets: DataFrame | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """`row` (the whole document), copy (from 0), n_copies, rate and draw (its place in the order)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    drawn = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col("source").alias("of"))
    known = rates(docs.select("source"), targets, temperature)
    # The condition is spelled as equal keys, so that null sources meet as well.
    known = known.select(F.struct(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name")).alias("k"), "rate", "cumulative")
    known = written(known, "source-rates")
    drawn = drawn.withColumn("k", F.struct(F.col("of").isNull().alias("no"), F.coalesce("of", F.lit("")).alias("name")))
    counted = drawn.join(known, "k").withColumn(
        "n_copies", F.size(F.filter("cumulative", lambda c: c <= uniform(F.lit(str(seed)), F.lit("copies"), F.col("key"))))
    )
    copies = counted.filter("n_copies > 0").select("row", "key", "n_copies", "rate", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    draw = uniform(F.lit(str(seed)), F.lit("order"), F.col("key"), F.col("copy").cast("string"))
    return copies.select("row", "copy", "n_copies", "rate", draw.alias("draw"))


def mix(docs: DataFrame, targets: DataFrame | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """`replicated` documents in random order over all output partitions."""
    return replicated(docs, targets, seed, temperature).repartition("draw").sortWithinPartitions("draw")
