"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits, each set if it is set in over half of the document's hashed word
shingles. Two fingerprints within three bits of each other have a half (32 bits) within one bit
of each other, so every fingerprint looks up the 33 values around each of its halves in a table
of halves; matches are verified on the whole distance. Only distinct fingerprints are linked,
so a group of copies is one row however large it is, and a fingerprint has at most as many
partners as the ball of three bits has members. Components come from repeated minimum
exchanges over those links, and each document then takes the component of its fingerprint.

Null and empty texts, and texts of white space only, have fingerprint zero and are linked like
any other. Rows with a null id get a fingerprint and the component of its group (null if the
group has no other id). Repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abstain_eval.llm.common import words_of
from abstain_eval.session import cut_lineage

SEED = 42
SHINGLE = 3
DISTANCE = 3
HALVES = ((0, 32), (32, 32))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = words_of(text or "")
    if not words:
        return 0
    if len(words) < shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in joined], dtype="<u8")
    bits = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):  # bounds the unpacked bits of a very long text
        part = hashes[start : start + 65_536]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([simhash(t) for t in batch], dtype="int64")


def half(value: Column, start: int, length: int) -> Column:
    return F.shiftrightunsigned(value, start).bitwiseAND(F.lit((1 << length) - 1))


def close_pairs(fingerprints: DataFrame) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column `f`) at three or fewer differing bits."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    halves = F.array(*(F.struct(F.lit(s).alias("s"), half(F.col("f"), s, n).alias("v")) for s, n in HALVES))
    table = fingerprints.select(F.col("f").alias("b"), F.inline(halves))
    looked_up = (
        fingerprints.select(F.col("f").alias("a"), F.inline(halves))
        .select("a", "s", "v", F.explode(flips).alias("flip"))
        .select("a", "s", F.col("v").bitwiseXOR(F.col("flip")).alias("v"))
    )
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return looked_up.join(table, ["s", "v"]).filter(near).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected `links` (a, b): root is the least node reachable.

    Alternates two steps until nothing changes: each node hands its larger neighbours, then its
    smaller ones, to the least node it knows. Each round is written to the shared folder.
    """
    edges = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def signature(df: DataFrame):
        return df.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:  # every neighbour larger than the node
            both = df.select(F.col("a").alias("u"), F.col("b").alias("v")).union(df.select(F.col("b"), F.col("a")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            moved = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:  # the node and its smaller neighbours
            down = df.select(F.col("b").alias("u"), F.col("a").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            kept = least.select(F.col("m").alias("a"), F.col("u").alias("b"))
            moved = down.join(least, "u").filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(kept)
        return moved.filter("a <> b").distinct()

    before = signature(edges)
    while True:
        edges = cut_lineage(star(star(edges, True), False))
        after = signature(edges)
        if after == before:
            return edges.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "node").union(
                edges.select("a", "a").distinct()
            )
        before = after


def row_key(id_column: str, text_column: str) -> Column:
    """Text that names a document: its id, if it has one, and a digest of its text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return F.concat_ws(" ", F.col(id_column).cast("string"), F.lit("text"), F.xxhash64(text), F.xxhash64(F.lit(1), text))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's doc_id, key, fingerprint (long), component_id (the least id reachable) and kept_key.

    kept_key is the key of the document that stays of the component: of those with the least id,
    or of all if none has an id, the one with the least key.
    """
    marked = cut_lineage(
        docs.select(
            F.col(id_column).alias("doc_id"), row_key(id_column, text_column).alias("key"),
            simhash_column(F.col(text_column)).alias("f"),
        )
    )
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    classes = cut_lineage(marked.groupBy("f").agg(F.min(place).alias("least")))
    roots = components(close_pairs(classes.select("f")))
    rooted = classes.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    found = rooted.select("f", "root").join(least, "root").select(
        "f", F.col("least.id").alias("component_id"), F.col("least.key").alias("kept_key")
    )
    return marked.join(found, "f").select("doc_id", "key", F.col("f").alias("fingerprint"), "component_id", "kept_key")


def first_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that stay: one of each component, as `near_duplicates` chooses it.

    Rows with equal ids and different texts are different documents; rows equal in both are one,
    and one of them stays.
    """
    found = near_duplicates(docs, id_column, text_column)
    keep = found.filter(F.col("key") == F.col("kept_key")).select("key").distinct()
    named = docs.select(row_key(id_column, text_column).alias("key"), F.struct("*").alias("row"))
    text = F.col(f"row.`{text_column}`")
    one = named.join(keep, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.struct(text.isNull(), text)).alias("row"))
    return one.select("row.*")
