"""Seeded order, numbering and exact quotas without a single-task sort.

Rows are ordered by the digest of their key. Its first four hex digits split them into
65,536 buckets of near equal size whatever the data, so ranks need only bucket counts.
Keys must be unique; the case contract checks that. Rows are numbered in two steps: sorted parts
are written once, and a number is a row's place in its part behind the rows of the parts before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abstain_eval.functions.joins import sized_side
from abstain_eval.functions.numbers import draw_digest
from abstain_eval.session import cut_lineage

BUCKET_DIGITS = 4


def _with_digest(df: DataFrame, keys: Sequence[str], seed: int, stream: str) -> DataFrame:
    digest = df.withColumn("_digest", draw_digest(seed, stream, *keys))
    return digest.withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))


PLACE_BITS = 33  # of a row's running id, below those of its task


def seeded_shuffle(
    df: DataFrame, keys: Sequence[str], seed: int, stream: str = "shuffle", index: str = "row_idx"
) -> DataFrame:
    """Number all rows 0, 1, ... in seeded order."""
    ordered = _with_digest(df, keys, seed, stream)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("_bucket").count().select(
        "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", *keys)
    # At most 65,536 offset rows (a few MB), by construction of the bucket.
    return (
        ordered.join(F.broadcast(offsets), "_bucket")
        .withColumn(index, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_digest", "_bucket", "_offset")
    )


def numbered(df: DataFrame, by: Sequence[Column | str], index: str = "position") -> DataFrame:
    """Number all rows 0, 1, ... in the order of some columns: ranges are sorted, and counts of those before added."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    held = cut_lineage(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", PLACE_BITS)
    counts = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    shifts, so_far = [], 0
    for number, n in counts:  # one for each range
        shifts.append((number, so_far - (number << PLACE_BITS)))
        so_far += n
    small = spark.createDataFrame(shifts, "_range long, _shift long")
    return (
        held.withColumn("_range", part).join(F.broadcast(small), "_range")
        .withColumn(index, F.col("_id") + F.col("_shift")).drop("_range", "_id", "_shift")
    )


def dense_positions(
    df: DataFrame, group: str, by: str, ties: Sequence[str], width: int = 65_536, index: str = "position"
) -> DataFrame:
    """Number the rows of each group 0, 1, ... by an integer column that may have gaps.

    Rows are ranked only within ranges of ``width`` values, so a large group is many tasks;
    counts of the ranges before give the rest. Nulls come last.
    """
    ranged = df.withColumn("_range", F.floor(F.coalesce(F.col(by), F.lit(2**62)) / width))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_range").orderBy(by, *ties)
    return (
        ranged.join(offsets, [group, "_range"])
        .withColumn(index, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_range", "_offset")
    )


REST_BUCKETS = 65_536


def split_quotas(counts: DataFrame, stratum: str, test_size: float) -> DataFrame:
    """Rows to hold out per stratum: ceil(n * size) in all, train parts by largest remainder.

    The strata that get one more are found by counting buckets of remainders; only the bucket in
    which the spare rows end is ranked, over all tasks.
    """
    whole = "decimal(38,0)"
    held = cut_lineage(counts.select(stratum, F.col("n").cast("bigint").alias("n")))
    every = int(held.agg(F.sum("n")).first()[0] or 0)
    if not every:
        return held.select(stratum, "n", F.lit(0).cast("bigint").alias("quota"))
    train = every - math.ceil(every * test_size)
    share = F.col("n").cast(whole) * F.lit(train).cast(whole)
    part = F.floor(share / F.lit(every).cast(whole)).cast("bigint")
    parts = held.withColumn("_part", part).withColumn(
        "_rest", (share - F.col("_part").cast(whole) * F.lit(every).cast(whole)).cast("bigint")
    )
    bucketed = parts.withColumn("_bucket", F.floor(F.col("_rest") / F.lit(every) * REST_BUCKETS).cast("int"))
    buckets = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("_part").alias("given")).collect()
    spare = train - sum(r["given"] for r in buckets)
    last = -1
    for r in sorted(buckets, key=lambda r: -r["_bucket"]):  # at most REST_BUCKETS
        last = r["_bucket"]
        if r["n"] >= spare:
            break
        spare -= r["n"]
    edge = numbered(bucketed.filter(F.col("_bucket") == last), [F.col("_rest").desc(), F.col(stratum)], "_place")
    got = edge.withColumn("_more", (F.col("_place") < spare).cast("int")).drop("_place").unionByName(
        bucketed.filter(F.col("_bucket") != last).withColumn("_more", (F.col("_bucket") > last).cast("int"))
    )
    return got.select(stratum, "n", (F.col("n") - F.col("_part") - F.col("_more")).cast("bigint").alias("quota"))


def stratified_split(
    df: DataFrame, stratum: str, keys: Sequence[str], test_size: float, seed: int
) -> DataFrame:
    """Add ``is_test`` with exact quotas per stratum.

    Bucket counts give the bucket in which a stratum's quota ends; only that bucket's rows
    are ranked, and the row found there is the cut for all others. No full shuffle.
    """
    ordered = _with_digest(df, keys, seed, "split")
    buckets = ordered.groupBy(stratum, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    quotas = split_quotas(buckets.groupBy(stratum).agg(F.sum("n").alias("n")), stratum, test_size)
    running = Window.partitionBy(stratum).orderBy("_bucket")
    last = (
        _join_stratum(buckets, quotas.select(stratum, "quota"), stratum)
        .withColumn("_upto", F.sum("n").over(running))
        .filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("n") < F.col("quota")))
        .select(stratum, "_bucket", (F.col("quota") - F.col("_upto") + F.col("n")).alias("_need"))
    )
    inside = Window.partitionBy(stratum).orderBy("_digest", *keys)
    edge = (
        _join_stratum(ordered.select(stratum, "_bucket", "_digest", *keys), sized_side(last), stratum, ["_bucket"])
        .withColumn("_rank", F.row_number().over(inside))
        .filter(F.col("_rank") == F.col("_need"))
        .select(stratum, _position("_digest", keys).alias("_cut"))
    )
    return (
        _join_stratum(ordered, sized_side(edge), stratum, how="left")
        .withColumn("is_test", F.coalesce(_position("_digest", keys) <= F.col("_cut"), F.lit(False)))
        .drop("_digest", "_bucket", "_cut")
    )


def _join_stratum(
    left: DataFrame, right: DataFrame, stratum: str, keys: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Join on the stratum, null being a stratum of its own, and on equal keys."""
    other = right.withColumnsRenamed({c: f"_right_{c}" for c in (stratum, *keys)})
    same = F.col(stratum).eqNullSafe(F.col(f"_right_{stratum}"))
    for c in keys:
        same &= F.col(c) == F.col(f"_right_{c}")
    return left.join(other, same, how).drop(*[f"_right_{c}" for c in (stratum, *keys)])


def _position(digest: str, keys: Sequence[str]) -> Column:
    return F.struct(F.col(digest).alias("d"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])


def small_strata(counts: DataFrame, stratum: str) -> DataFrame:
    """A stratum of one row cannot be split."""
    return counts.filter(F.col("n") < 2).select(
        F.lit("stratum_too_small").alias("check"),
        F.lit(stratum).alias("column"),
        F.col(stratum).cast("string").alias("detail"),
    )


def refuse_small_strata(df: DataFrame, stratum: str) -> None:
    """Raise if a stratum has a single row, which cannot stand on both sides of a split."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    found = small_strata(counts, stratum).select("detail").take(5)
    if found:
        named = ", ".join(str(r["detail"]) for r in found)
        raise ValueError(f"too few rows to split by {stratum}: {named}")


def first_cases(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of the seeded order; the same ones on every run."""
    return df.filter(F.col("row_idx") < n)
