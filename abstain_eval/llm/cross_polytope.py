"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform and hashed
to the signed axis nearest to it. Each of `TABLES` tables has its own signs. All vectors are
indexed in every table under their nearest axis; a query looks up the `PROBES` axes nearest to
it in each. What shares a cell is compared exactly, in double precision, on original vectors.

Vectors are divided by their largest component, so that multiples of a vector are equal; equal ones
are indexed once, with the few least ids that can be among the nearest. Ties go to lesser ids,
so no other copy can matter. Products of a block only choose candidates, with a margin for their
rounding; scores are computed for each pair alike. A query that meets fewer vectors than it is
to find is compared with all blocks of the index. Cells are cut into blocks of about `BLOCK` vectors
and `BLOCK` queries by digests of the vectors, so a crowded cell is many small tasks and every
pair in it is still compared. Measured recall is in the README.

Vectors that are null, empty or zero or hold null or non-finite components, and rows with a null
id, take no part. Vectors meet only vectors of their own length. A row given twice with the
same id and vector is one row; a query never finds rows with its own id. An empty table, or a
table without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abstain_eval.llm.common import written
from abstain_eval.session import cut_lineage

TABLES = 8
PROBES = 10
NEAREST = 5
BLOCK = 8192
QUERY_STEP = 50
SEED = 5


def padded(length: int) -> int:
    return 1 << max(1, int(length - 1).bit_length())


def signs_of(table: int, width: int) -> np.ndarray:
    return np.random.default_rng((SEED, table, width)).integers(0, 2, (3, width)) * 2.0 - 1


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = rows.shape
    h = 1
    while h < width:
        pairs = rows.reshape(n, width // (2 * h), 2, h)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return rows


def axes(vectors: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The `probes` signed axes nearest to each vector, nearest first: axis, or axis + width for its opposite."""
    width = padded(vectors.shape[1])
    rows = np.zeros((len(vectors), width))
    rows[:, : vectors.shape[1]] = vectors
    for signs in signs_of(table, width):
        rows = hadamard(rows * signs)
        rows /= np.maximum(np.abs(rows).max(1, keepdims=True), 1e-300)  # keeps large and small vectors in range
    both = np.hstack([rows, -rows])
    return np.argsort(-both, axis=1, kind="stable")[:, : min(probes, 2 * width)]


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite and not zero."""
    x = F.col("x") if isinstance(vector, str) else vector
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & (F.size(x) > 0) & F.exists(x, lambda v: v != 0), F.lit(False))


def classes(vectors: DataFrame, nearest: int) -> DataFrame:
    """Distinct vectors x (array<double>) with code and ids, their least ids as far as they can matter."""
    rows = vectors.withColumn("code", F.xxhash64("x")).dropDuplicates(["code", "x", "id"])
    order = Window.partitionBy("code", "x").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= nearest + 1)
    return few.groupBy("code", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def celled(rows: DataFrame, probes: int) -> DataFrame:
    """Rows (code, x, ids) once for every cell (width, table, axis) that they are in."""

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("x")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(at))
                vectors = np.array(part.column("x").flatten()).reshape(len(at), size)
                for table in range(TABLES):
                    found = axes(vectors, table, probes)
                    take = pa.array(np.repeat(np.arange(len(at)), found.shape[1]))
                    out = part.take(take)
                    n = len(take)
                    cells = [pa.array(np.full(n, v, np.int32)) for v in (size, table)] + [pa.array(found.ravel().astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*out.columns, *cells], names=["code", "x", "ids", "width", "table", "axis"])

    schema = "code long, x array<double>, ids array<long>, width int, table int, axis int"
    return rows.select("code", "x", "ids").mapInArrow(hash_rows, schema)


CELL = ["width", "table", "axis"]


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed alike wherever a pair stands; the largest component of a row is 1 or -1."""
    out = np.empty(len(left))
    for a in range(0, len(left), 65_536):
        x, y = left[a : a + 65_536], right[a : a + 65_536]
        out[a : a + 65_536] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return np.clip(out, -1.0, 1.0)


FOUND = "id long, code long, ids array<long>, score double"
MARGIN = 1e-9  # far beyond the rounding of a product of unit vectors


def nearest_in_block(nearest: int):
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())

    def compare(queries: pa.Table, index: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in FOUND.split(", ")]
        if not queries.num_rows or not index.num_rows:
            return pa.table({n: pa.array([], k) for n, k in zip(names, kinds, strict=True)})
        q, x = (np.array(t["x"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (queries, index))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        ids = index["ids"].combine_chunks()
        least = pc.list_element(ids, 0).to_numpy()
        keep = min(nearest + 1, len(x))
        rows, best, scores = [], [], []
        for a in range(0, len(q), 512):
            part = q[a : a + 512]
            products = (part / np.linalg.norm(part, axis=1, keepdims=True)) @ unit.T
            last = np.partition(products, len(x) - keep, axis=1)[:, len(x) - keep, None]
            row, at = np.nonzero(products >= last - MARGIN)
            score = cosines(part[row], x[at])
            order = np.lexsort((least[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            first = rank < keep
            rows.append(row[first] + a)
            best.append(at[first])
            scores.append(score[first])
        row, at = np.concatenate(rows), pa.array(np.concatenate(best))
        return pa.table({"id": queries["id"].take(pa.array(row)), "code": index["code"].take(at), "ids": ids.take(at).cast(kinds[2]), "score": np.concatenate(scores)})

    return compare


def scores_by_id(found: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) without a query's own id."""
    pairs = found.groupBy("id", "code", "ids").agg(F.max("score").alias("score"))
    pairs = pairs.select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def short_queries(asked: DataFrame, once: DataFrame, distinct: DataFrame, nearest: int) -> DataFrame:
    """Queries (id, x, width) that have found fewer vectors than there are to find."""
    there = distinct.groupBy(F.size("x").alias("width")).agg(F.sum(F.size("ids")).alias("n_there"))
    found = once.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n_found"))
    sized = asked.select("id", "x", F.size("x").alias("width")).join(found, "id", "left").join(there, "width")
    few = F.coalesce("n_found", F.lit(0)) < F.least(F.lit(nearest), F.col("n_there") - 1)
    return sized.filter(few).select("id", "x", "width")


def against_all(short: DataFrame, distinct: DataFrame, nearest: int) -> DataFrame:
    """Every given query against the whole index, block by block."""
    query_blocks, blocks = (max(1, -(-df.count() // BLOCK)) for df in (short, distinct))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.select("code", "x", "ids", F.size("x").alias("width"), F.pmod(F.xxhash64("code", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    right = short.withColumn("query_block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).cast("int"))
    key = ["width", "block", "query_block"]
    left, right = left.withColumn("query_block", every(query_blocks)), right.withColumn("block", every(blocks))
    return right.groupBy(key).cogroup(left.groupBy(key)).applyInArrow(nearest_in_block(nearest), FOUND)


def nearest_neighbours(vectors: DataFrame, query_step: int = QUERY_STEP, nearest: int = NEAREST, tables_probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows found, for ids divisible by `query_step`.

    `vectors` has columns vec_id and embedding.
    """
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x")))
    largest = F.array_max(F.transform("x", F.abs))
    rows = rows.withColumn("largest", largest).select("id", F.transform("x", lambda v: v / F.col("largest") + F.lit(0.0)).alias("x"))
    distinct = cut_lineage(classes(rows, nearest))
    index = celled(distinct, 1)
    asked = rows.filter(F.col("id") % query_step == 0).select("id", "x").dropDuplicates()
    asked = asked.withColumn("code", F.xxhash64("x"))
    probes = celled(asked.select("code", "x", F.array("id").alias("ids")), tables_probes)
    # At most TABLES * 2 * width cells for each length of vectors.
    crowds = index.groupBy(CELL).agg(F.count("*").alias("n")).join(
        probes.groupBy(CELL).agg(F.count("*").alias("n_asked")), CELL
    ).select(*CELL, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_asked") / BLOCK).cast("int").alias("query_blocks"))
    crowds = written(crowds, "crowds")
    key = [*CELL, "block", "query_block"]
    own = F.pmod(F.xxhash64("code", F.lit(1)), F.col("blocks")).cast("int")
    left = (
        index.join(crowds, CELL).withColumn("block", own)
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("code", "x", "ids", *key)
    )
    own = F.pmod(F.xxhash64("ids", F.lit(2)), F.col("query_blocks")).cast("int")
    right = (
        probes.join(crowds, CELL).withColumn("query_block", own)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("ids")[0].alias("id"), "x", *key)
    )
    found = right.groupBy(key).cogroup(left.groupBy(key)).applyInArrow(nearest_in_block(nearest), FOUND)
    once = written(scores_by_id(found), "found")
    short = written(short_queries(asked, once, distinct, nearest), "short")
    if short.take(1):
        once = once.unionByName(scores_by_id(against_all(short, distinct, nearest))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
