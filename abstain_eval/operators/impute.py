"""Chained imputation.

Missing cells start at their column's mean and are then predicted from all other columns for
several rounds. Columns without missing cells get a regressor too, for new rows that have gaps
there.

``boosted_rounds`` is the default. All columns of a round are fitted side by side on all rows,
from the values of the round before: small tables in a task for each column, others in blocks of
rows, level by level out of summed histograms. The forests of all rounds are then one table of
nodes, and the whole chain runs over all rows in a single pass.
``linear_rounds`` is the cheap form: every round is fitted out of sums that one pass over the
rows gathers. ``fit_imputation`` with an MLlib regressor fits column after column, fewest
missing cells first, on all rows; the table is cut from its lineage into the shared folder
every few columns, so a lost executor costs one segment of work.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa

from pyspark import RDD, StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abstain_eval.operators import boost
from abstain_eval.session import cut_lineage


@dataclass(frozen=True)
class Boosting:
    """Boosted trees for every column, fitted on all rows or, if so asked, on ``fit_rows`` of them chosen by digest."""

    trees: int = 100
    depth: int = 3
    step: float = 0.1
    fit_rows: int | None = None
    seed: int = 42


def gbt(trees: int = 100, depth: int = 3, step: float = 0.1, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)


def linear(regularisation: float = 1e-6) -> LinearRegression:
    """Least squares from one pass over the rows."""
    return LinearRegression(solver="normal", regParam=regularisation)


NODES = "round int, column string, tree int, place int, feature int, threshold double, value double"


def _node_rows(forests: list[dict[str, boost.Forest]]) -> pa.Table:
    """Forests as one table: splits and then leaves in heap order, and a row without tree for the base."""
    parts: dict[str, list] = {c.split()[0]: [] for c in NODES.split(", ")}
    for number, forest_of in enumerate(forests):
        for column, forest in forest_of.items():
            trees, splits = forest.features.shape
            size = splits + forest.leaves.shape[1]
            none = np.full(forest.leaves.shape, np.nan)
            parts["round"].append(np.full(trees * size + 1, number))
            parts["column"].append(np.full(trees * size + 1, column, object))
            parts["tree"].append(np.append(np.repeat(np.arange(trees), size), -1))
            parts["place"].append(np.append(np.tile(np.arange(size), trees), 0))
            features = np.hstack([forest.features, np.full(forest.leaves.shape, boost.NO_SPLIT)])
            parts["feature"].append(np.append(features.ravel(), boost.NO_SPLIT))
            parts["threshold"].append(np.append(np.hstack([forest.thresholds, none]).ravel(), np.nan))
            values = np.hstack([np.full(forest.features.shape, np.nan), forest.leaves])
            parts["value"].append(np.append(values.ravel(), forest.base))
    kinds = {"round": pa.int32(), "column": pa.string(), "tree": pa.int32(), "place": pa.int32(), "feature": pa.int32()}
    arrays = {n: pa.array(np.concatenate(v), kinds.get(n, pa.float64())) for n, v in parts.items()}
    return pa.table(arrays)


def _forests_of(nodes: pa.Table) -> list[dict[str, boost.Forest]]:
    found = nodes.to_pandas().sort_values(["round", "column", "tree", "place"])
    forests: list[dict[str, boost.Forest]] = [{} for _ in range(found["round"].max() + 1)] if len(found) else []
    for (number, column), rows in found.groupby(["round", "column"], sort=True):
        base, rest = rows["value"].iloc[0], rows.iloc[1:]
        size = rest["place"].max() + 1
        splits = size // 2
        take = lambda name: rest[name].to_numpy().reshape(-1, size)  # noqa: B023,E731
        forests[number][column] = boost.Forest(
            base, take("feature")[:, :splits].astype(np.int32), take("threshold")[:, :splits], take("value")[:, splits:]
        )
    return forests


@dataclass
class FittedImputation:
    """Column means and the fitted regressors in the order they were used.

    ``forests`` has the boosted trees of each round by column, ``steps`` all other regressors.
    """

    columns: list[str]
    means: dict[str, float]
    steps: list[tuple[str, Any]] = field(default_factory=list)
    rounds: int = 0
    forests: list[dict[str, boost.Forest]] = field(default_factory=list)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """The nodes of all boosted trees; bounded by columns, rounds and trees."""
        if not self.forests:
            return spark.createDataFrame([], NODES)
        return spark.createDataFrame(_node_rows(self.forests), NODES)

    def save(self, spark: SparkSession, path: str) -> None:
        """Means and regressors, each under its place in the chain."""
        facts = [(json.dumps({"columns": self.columns, "means": self.means, "rounds": self.rounds, "steps": [
            (column, model.weights if isinstance(model, LinearRound) else type(model).__name__) for column, model in self.steps]}),)]
        spark.createDataFrame(facts, "value string").write.mode("overwrite").text(f"{path}/facts")
        self.node_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        for i, (_, model) in enumerate(self.steps):
            if not isinstance(model, LinearRound):
                model.write().overwrite().save(f"{path}/step-{i}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedImputation:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        kinds = {kind.__name__: kind for kind in (GBTRegressionModel, LinearRegressionModel)}
        steps = [
            (column, LinearRound(kind) if isinstance(kind, dict) else kinds[kind].load(f"{path}/step-{i}"))
            for i, (column, kind) in enumerate(facts["steps"])
        ]
        forests = _forests_of(spark.read.schema(NODES).parquet(f"{path}/nodes").toArrow())
        return FittedImputation(facts["columns"], facts["means"], steps, facts["rounds"], forests)

    def transform(self, df: DataFrame, cut_every: int = 8) -> DataFrame:
        """Impute new rows with the fitted chain."""
        current = _start(df, self.columns, self.means)
        if self.forests:
            current = _boosted(current, self.columns, self.forests)
        for i, (column, model) in enumerate(self.steps, 1):
            if isinstance(model, LinearRound):
                current = model.apply(current, self.columns, self.columns)
            else:
                current = _predict(current, column, model, self.columns)
            if i % cut_every == 0 and i < len(self.steps):
                current = cut_lineage(current)
        return current.drop(*[_mask(c) for c in self.columns])


def _mask(column: str) -> str:
    return f"_missing_{column}"


def _start(df: DataFrame, columns: list[str], means: dict[str, float]) -> DataFrame:
    missing = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns}
    masked = df.withColumns({_mask(c): m for c, m in missing.items()})
    return masked.withColumns(
        {c: F.when(F.col(_mask(c)), F.lit(means[c])).otherwise(F.col(c).cast("double")) for c in columns}
    )


def _assembled(df: DataFrame, column: str, columns: list[str]) -> DataFrame:
    inputs = [c for c in columns if c != column]
    return VectorAssembler(inputCols=inputs, outputCol="_inputs").transform(df)


def _predict(df: DataFrame, column: str, model: Any, columns: list[str]) -> DataFrame:
    predicted = model.transform(_assembled(df, column, columns))
    value = F.when(F.col(_mask(column)), F.col("_predicted")).otherwise(F.col(column))
    return predicted.withColumn(column, value).drop("_inputs", "_predicted")


@dataclass
class LinearRound:
    """Least squares of every column on all others: an intercept and a weight for each column."""

    weights: dict[str, list[float]]

    def apply(self, df: DataFrame, columns: list[str], gaps: list[str]) -> DataFrame:
        """New values of the missing cells of ``gaps``; all are read before any is written.

        Done on whole batches: as expressions, the sums of all columns outgrow compiled code.
        """
        weights = {c: np.array(self.weights[c]) for c in gaps}

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, columns)
                arrays = dict(zip(batch.schema.names, batch.columns, strict=True))
                for c in gaps:
                    missing = batch.column(_mask(c)).to_numpy(zero_copy_only=False).astype(bool)
                    old = batch.column(c).to_numpy(zero_copy_only=False)
                    arrays[c] = pa.array(np.where(missing, x @ weights[c], old))
                yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

        return df.mapInArrow(fill, df.schema)


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Ones and the columns of a batch."""
    return np.column_stack([np.ones(batch.num_rows), *(batch.column(c).to_numpy(zero_copy_only=False) for c in columns)])


def _gramians(df: DataFrame, columns: list[str]) -> np.ndarray:
    """For each column, the sums of products of (1, columns) over the rows that observe it.

    A task sends one row for each column; the sums hold columns ** 3 numbers whatever the table.
    """
    width = len(columns) + 1
    masks = [_mask(c) for c in columns]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(columns), width, width))
        for batch in batches:
            x = _matrix(batch, columns)
            for i, mask in enumerate(masks):
                seen = x[~batch.column(mask).to_numpy(zero_copy_only=False).astype(bool)]
                total[i] += seen.T @ seen
        place = np.arange(len(columns) * width * width)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel())], names=["place", "part"])

    parts = df.select(*columns, *masks).mapInArrow(gather, "place long, part double")
    rows = parts.groupBy("place").agg(F.sum("part").alias("total")).collect()
    out = np.zeros(len(columns) * width * width)
    for r in rows:
        out[r["place"]] = r["total"]
    return out.reshape(len(columns), width, width)


def _solved(gramians: np.ndarray, columns: list[str], regularisation: float) -> LinearRound:
    weights = {}
    for i, column in enumerate(columns):
        inputs = [0, *(j + 1 for j in range(len(columns)) if j != i)]
        a = gramians[i][np.ix_(inputs, inputs)]
        b = gramians[i][inputs, i + 1]
        scale = np.sqrt(np.maximum(np.diag(a), 1e-300))  # columns differ by orders of magnitude
        ridge = np.eye(len(inputs)) * regularisation
        ridge[0, 0] = 0
        solved = np.linalg.lstsq(a / np.outer(scale, scale) + ridge, b / scale, rcond=None)[0] / scale
        all_weights = np.zeros(len(columns) + 1)
        all_weights[inputs] = solved
        weights[column] = all_weights.tolist()
    return LinearRound(weights)


def linear_rounds(
    df: DataFrame, columns: list[str], rounds: int = 10, tolerance: float = 1e-3, regularisation: float = 1e-9
) -> tuple[FittedImputation, DataFrame]:
    """Fit linear rounds on ``df``; two passes and one write for each round.

    Stops like ``fit_imputation``. A table without gaps still gets one round, for new rows.
    """
    means, gaps, largest, _ = _facts(df, columns)
    targets = [c for c in columns if gaps[c]]
    fitted = FittedImputation(columns, means)
    current = cut_lineage(_start(df, columns, means))
    for _ in range(rounds if targets else min(rounds, 1)):
        step = _solved(_gramians(current, columns), columns, regularisation)
        fitted.steps.append(("", step))
        fitted.rounds += 1
        if not targets:
            break
        before = current.withColumns({f"_was_{c}": F.col(c) for c in targets})
        moved_to = cut_lineage(step.apply(before, columns, targets))
        moved = moved_to.agg(
            F.greatest(*[F.max(F.abs(F.col(c) - F.col(f"_was_{c}"))) for c in targets], F.lit(0.0))
        ).first()[0]
        current = moved_to.drop(*[f"_was_{c}" for c in targets])
        if moved is None or moved <= tolerance * largest:
            break
    return fitted, current.drop(*[_mask(c) for c in columns])


def _boosted(df: DataFrame, columns: list[str], forests: list[dict[str, boost.Forest]]) -> DataFrame:
    """Run all rounds over started rows; within a round all cells are read before any is written."""
    chain = df.sparkSession.sparkContext.broadcast(forests)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, columns)[:, 1:]
            gaps = {c: np.flatnonzero(batch.column(_mask(c)).to_numpy(zero_copy_only=False).astype(bool)) for c in columns}
            for forest_of in chain.value:
                filled = {c: forest_of[c].predict(x[at]) for c, at in gaps.items() if len(at)}
                for i, c in enumerate(columns):
                    if c in filled:
                        x[gaps[c], i] = filled[c]
            arrays = dict(zip(batch.schema.names, batch.columns, strict=True))
            arrays |= {c: pa.array(x[:, i]) for i, c in enumerate(columns)}
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return df.mapInArrow(fill, df.schema)


AT_ONCE = 1 << 18  # up to so many rows are fitted in a task for each column, more in blocks
BLOCK_ROWS = 1 << 17
SUMMARY = 4096  # values that stand for a column of a task when bins are cut
SAVED_EVERY = 3  # trees, after which what is left to explain is kept


def _sampled(df: DataFrame, columns: list[str], n: int, settings: Boosting) -> DataFrame:
    """The columns as doubles, of ``fit_rows`` rows (the first by digests of their atomic columns) or of all."""
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    if settings.fit_rows is None or n <= settings.fit_rows:
        return df.select(*numbers)
    atomic = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    rows = df.select(*numbers, F.xxhash64(F.lit(settings.seed), *[F.col(c) for c in atomic]).alias("_digest"))
    scale = 1 << 30
    share = (settings.fit_rows + 10 * settings.fit_rows**0.5) / n
    some = rows.filter(F.pmod("_digest", F.lit(scale)) < int(share * scale)) if share < 1 else rows
    found = cut_lineage(some.orderBy("_digest").limit(settings.fit_rows).drop("_digest"))
    if found.count() < settings.fit_rows // 2:  # most rows are equal, and the digests of the others too many
        found = rows.orderBy("_digest").limit(settings.fit_rows).drop("_digest")
    return found


def _fitting_rows(df: DataFrame, columns: list[str], n: int, settings: Boosting) -> np.ndarray:
    """The rows to fit on as a matrix, if they are few; NaN where missing."""
    found = _sampled(df, columns, n, settings).toArrow()
    return np.column_stack([found[c].to_numpy().astype(float) for c in columns])


FITTED = "place int, base double, features binary, thresholds binary, leaves binary, filled binary"


def _targets(means: np.ndarray, least: np.ndarray, largest: np.ndarray) -> list[boost.Target]:
    """Every column out of all others; a column that the rows do not know is its mean."""
    others = [[i for i in range(len(means)) if i != place] for place in range(len(means))]
    return [boost.Target.of(i, others[i], float(means[i]), float(least[i]), float(largest[i])) for i in range(len(means))]


def _fit_columns(
    spark: SparkSession, cells: np.ndarray, missing: np.ndarray, targets: list[boost.Target], settings: Boosting
) -> list[tuple[boost.Forest, np.ndarray]]:
    """A forest for each column and its values for the column's missing cells; a task for each column."""
    bins = boost.Bins([boost.Summary.of(c).bin_values() for c in cells])
    shared = spark.sparkContext.broadcast((bins, bins.codes(cells), cells, missing))  # at most AT_ONCE rows

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, codes, x, gaps = shared.value
        for batch in batches:
            for place in batch.column(0).to_pylist():
                target, seen = targets[place], ~gaps[place : place + 1]
                block = boost.Block(bins, [target], codes, target.residual(x[place], seen[0])[None], seen)
                forest = boost.grow(bins, [target], block, settings.trees, settings.depth, settings.step)[0]
                filled = forest.predict(x[:, gaps[place]].T)
                arrays = [forest.features.astype("<i4"), forest.thresholds, forest.leaves, filled]
                columns = [pa.array([place], pa.int32()), pa.array([forest.base]), *(pa.array([a.tobytes()]) for a in arrays)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FITTED.split(", ")])

    width = len(cells)
    found = spark.range(0, width, 1, width).mapInArrow(fit, FITTED).collect()  # a row for each column
    splits, out = (1 << settings.depth) - 1, {}
    for r in found:
        features = np.frombuffer(r["features"], "<i4").reshape(-1, splits)
        thresholds, leaves = (np.frombuffer(r[c]).reshape(len(features), splits + i) for i, c in enumerate(("thresholds", "leaves")))
        out[r["place"]] = boost.Forest(r["base"], features, thresholds, leaves), np.frombuffer(r["filled"])
    shared.unpersist()
    return [out[i] for i in range(width)]


def _rounds_at_once(
    spark: SparkSession, cells: np.ndarray, means: np.ndarray, settings: Boosting, rounds: int, enough: float
) -> Iterator[list[boost.Forest]]:
    """The forests of each round, out of a [column, row] matrix."""
    missing = np.isnan(cells)
    known = [c[~m] if not m.all() else means[i : i + 1] for i, (c, m) in enumerate(zip(cells, missing, strict=True))]
    targets = _targets(means, np.array([c.min() for c in known]), np.array([c.max() for c in known]))
    cells = np.where(missing, means[:, None], cells)
    for _ in range(rounds):
        found = _fit_columns(spark, cells, missing, targets, settings)
        yield [forest for forest, _ in found]
        before, cells = cells, cells.copy()
        for i, (_, filled) in enumerate(found):
            cells[i, missing[i]] = filled
        if np.abs(cells - before).max(initial=0.0) <= enough:
            break


def _total(parts: RDD, add: Callable[[Any, Any], Any]) -> Any:
    """What tasks found, added up; first among tasks, if they are many."""
    return parts.treeReduce(add, 1 if parts.getNumPartitions() <= 32 else 2)


def _packed(residual: np.ndarray) -> np.ndarray:
    """Whole residuals in 32 bits, or in 64 where they don't fit."""
    return residual.astype(np.int32 if np.abs(residual).max(initial=0.0) < 1 << 31 else np.int64)


class _Blocks:
    """Blocks of rows in tasks, as ``boost.grow`` asks for them: sums over all of them.

    A block is the bins of its cells, which targets are known, and what is left of them. The latter is
    kept every few trees; tasks take the leaves of later trees off by themselves.
    """

    def __init__(self, rows: RDD, bins: boost.Bins, targets: list[boost.Target]):
        self.shared = shared = rows.context.broadcast((bins, targets))

        def begun(held: Iterator[tuple]) -> Iterator[tuple]:
            bins, targets = shared.value
            for cells, gaps, _ in held:
                residual = np.stack([t.residual(cells[t.column], ~gaps[t.column]) for t in targets])
                yield bins.codes(cells), np.packbits(~gaps, axis=1), _packed(residual)

        self.kept = rows.mapPartitions(begun).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: list[RDD] = []
        self.trees: list[boost.Tree] = []

    def _opened(self, trees: list[boost.Tree]) -> RDD:
        shared = self.shared

        def opened(held: Iterator[tuple]) -> Iterator[boost.Block]:
            bins, targets = shared.value
            for codes, bits, packed in held:
                seen = np.unpackbits(bits, axis=1, count=codes.shape[1]).view(bool)
                block = boost.Block(bins, targets, codes, packed.astype(float), seen)
                block.subtract(*trees)
                yield block

        return self.kept.mapPartitions(opened)

    def _added(self, blocks: RDD, measured: Callable[[boost.Block], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        def add(one: tuple, two: tuple) -> tuple:
            return tuple(a + b for a, b in zip(one, two, strict=True))

        def sums(blocks: Iterator[boost.Block]) -> Iterator[tuple]:
            total = None
            for block in blocks:
                total = measured(block) if total is None else add(total, measured(block))
            return iter(() if total is None else (total,))

        found = _total(blocks.mapPartitions(sums), add)
        while self.before:  # its successor is held now
            self.before.pop().unpersist()
        return found

    def counts(self) -> np.ndarray:
        return self._added(self._opened([]), lambda block: (block.counts(),))[0]

    def root_sums(self, some: list[int]) -> np.ndarray:
        return self._added(self._opened(self.trees), lambda block: (block.root_sums(some),))[0]

    def child_sums(self, some: list[int], tree: boost.Tree, level: int, right: np.ndarray) -> tuple[np.ndarray, ...]:
        return self._added(self._opened(self.trees), lambda block: block.child_sums(some, tree, level, right))

    def child_counts(self, some: list[int], tree: boost.Tree, level: int, right: np.ndarray) -> np.ndarray:
        return self._added(self._opened([]), lambda block: (block.child_counts(some, tree, level, right),))[0]

    def subtract(self, tree: boost.Tree) -> None:
        self.trees = [*self.trees, tree]
        if len(self.trees) == SAVED_EVERY:
            def pack(block: boost.Block) -> tuple:
                return block.codes, np.packbits(block.seen, axis=1), _packed(block.residual)

            kept = self._opened(self.trees).map(pack)
            self.before.append(self.kept)
            self.kept, self.trees = kept.persist(StorageLevel.MEMORY_AND_DISK), []

    def drop(self) -> None:
        for rdd in (*self.before, self.kept):
            rdd.unpersist()
        self.shared.unpersist()


def _row_blocks(df: DataFrame, columns: list[str], means: np.ndarray) -> RDD:
    """Blocks of rows: cells as [column, row], missing ones at their means; which are missing; how far the last round moved them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]))
            n += batch.num_rows
            while n >= 2 * BLOCK_ROWS:  # the last one is no small rest
                whole = np.hstack(held)
                yield block(whole[:, :BLOCK_ROWS])
                held, n = [whole[:, BLOCK_ROWS:]], n - BLOCK_ROWS
        if n:
            yield block(np.hstack(held))

    def block(cells: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary())], names=["cells"])

    def begun(row: Any) -> tuple[np.ndarray, np.ndarray, float]:
        cells = np.frombuffer(row[0]).reshape(len(means), -1)
        gaps = np.isnan(cells)
        return np.where(gaps, means[:, None], cells), gaps, 0.0

    tasks = df.sparkSession.sparkContext.defaultParallelism
    there = df.rdd.getNumPartitions()
    blocks = (df if there >= tasks else df.repartition(tasks)).mapInArrow(gather, "cells binary").rdd.map(begun)
    return (blocks.coalesce(tasks) if there > tasks else blocks).persist(StorageLevel.MEMORY_AND_DISK)


def _surveyed(rows: RDD) -> tuple[list[boost.Summary], float, np.ndarray, np.ndarray]:
    """A summary of every column, how far cells moved, and the least and largest known cells."""

    def add(one: tuple, two: tuple) -> tuple:
        both = [a.merged(b).short(SUMMARY) for a, b in zip(one[0], two[0], strict=True)]
        return both, max(one[1], two[1]), np.minimum(one[2], two[2]), np.maximum(one[3], two[3])

    def survey(blocks: Iterator[tuple]) -> Iterator[tuple]:
        total = None
        for cells, gaps, moved in blocks:
            least, largest = (f(np.where(gaps, x, cells), axis=1) for f, x in ((np.min, np.inf), (np.max, -np.inf)))
            found = [boost.Summary.of(c).short(SUMMARY) for c in cells], moved, least, largest
            total = found if total is None else add(total, found)
        return iter(() if total is None else (total,))

    return _total(rows.mapPartitions(survey), add)


def _rounds_in_blocks(
    df: DataFrame, columns: list[str], means: np.ndarray, settings: Boosting, rounds: int, enough: float
) -> Iterator[list[boost.Forest]]:
    """The forests of each round, out of a table of any size; a job for each level of a tree."""
    rows = _row_blocks(df, columns, means)
    summaries, _, least, largest = _surveyed(rows)
    known = least <= largest
    targets = _targets(means, np.where(known, least, means), np.where(known, largest, means))
    for number in range(rounds):
        bins = boost.Bins([s.bin_values() for s in summaries])
        blocks = _Blocks(rows, bins, targets)
        forests = boost.grow(bins, targets, blocks, settings.trees, settings.depth, settings.step)
        blocks.drop()
        yield forests
        if number + 1 == rounds:
            break
        chain = df.sparkSession.sparkContext.broadcast(forests)

        def filled(held: Iterator[tuple]) -> Iterator[tuple]:
            for cells, gaps, _ in held:
                after = cells.copy()
                for i, forest in enumerate(chain.value):  # noqa: B023
                    after[i, gaps[i]] = forest.predict(cells[:, gaps[i]].T)
                yield after, gaps, float(np.abs(after - cells).max(initial=0.0))

        before, rows = rows, rows.mapPartitions(filled).persist(StorageLevel.MEMORY_AND_DISK)
        summaries, moved, _, _ = _surveyed(rows)
        before.unpersist()
        if moved <= enough:
            break
    rows.unpersist()


def boosted_rounds(
    df: DataFrame, columns: list[str], rounds: int = 10, tolerance: float = 1e-3, settings: Boosting | None = None
) -> tuple[FittedImputation, DataFrame]:
    """Fit boosted rounds on all rows of ``df`` and impute them.

    Up to ``AT_ONCE`` rows a round is one job, with a task for each column; larger tables stay in
    blocks in their tasks, which send the histograms of each level of a tree, and get its splits.
    Both find the same trees as long as a block's columns have up to ``SUMMARY`` values; beyond,
    quantiles are exact to a rank of about 1 in ``SUMMARY``. Stops like ``fit_imputation``.
    """
    settings, df = settings or Boosting(), cut_lineage(df)  # read three times
    means, gaps, largest, n = _facts(df, columns)
    fitted = FittedImputation(columns, means)
    middle, enough = np.array([means[c] for c in columns]), tolerance * largest
    rounds = rounds if any(gaps.values()) else min(rounds, 1)
    if min(n, n if settings.fit_rows is None else settings.fit_rows) <= AT_ONCE:
        found = _rounds_at_once(df.sparkSession, _fitting_rows(df, columns, n, settings).T, middle, settings, rounds, enough)
    else:
        found = _rounds_in_blocks(_sampled(df, columns, n, settings), columns, middle, settings, rounds, enough)
    for forests in found:
        fitted.forests.append(dict(zip(columns, forests, strict=True)))
        fitted.rounds += 1
    return fitted, cut_lineage(fitted.transform(df))


def _facts(df: DataFrame, columns: list[str]) -> tuple[dict[str, float], dict[str, int], float, int]:
    """Means, missing cells, the largest magnitude and the number of rows: one row, the size of the column list."""
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    facts = df.agg(
        *[F.count(number[c]).alias(f"n_{c}") for c in columns],
        *[F.avg(number[c]).alias(f"mean_{c}") for c in columns],
        F.greatest(*[F.max(F.abs(number[c])) for c in columns]).alias("largest"),
        F.count(F.lit(1)).alias("rows"),
    ).first()
    empty = [c for c in columns if facts[f"n_{c}"] == 0]
    if empty:
        raise ValueError(f"columns without a single value cannot be imputed: {empty}")
    means = {c: facts[f"mean_{c}"] for c in columns}
    return means, {c: facts["rows"] - facts[f"n_{c}"] for c in columns}, facts["largest"], facts["rows"]


def fit_imputation(
    df: DataFrame,
    columns: list[str],
    estimator: str | Boosting | Callable[[], Any] = "gbt",
    rounds: int = 10,
    tolerance: float = 1e-3,
    cut_every: int = 4,
) -> tuple[FittedImputation, DataFrame]:
    """Fit the chain on ``df`` and return it with the imputed table.

    ``estimator`` is "gbt" or a ``Boosting`` for boosted rounds, "linear" for linear ones, or a
    function that makes an MLlib regressor for a chain of single columns. Stops early when no imputed cell moves by more than ``tolerance`` times the largest
    observed magnitude.
    """
    if estimator == "linear":
        return linear_rounds(df, columns, rounds, tolerance)
    if estimator == "gbt" or isinstance(estimator, Boosting):
        return boosted_rounds(df, columns, rounds, tolerance, None if estimator == "gbt" else estimator)
    if isinstance(estimator, str):
        raise ValueError(f"unknown estimator: {estimator}")
    make = estimator
    means, gaps, largest, _ = _facts(df, columns)
    order = sorted(columns, key=lambda c: gaps[c])
    targets = [c for c in order if gaps[c] > 0]

    fitted = FittedImputation(columns, means)
    current = cut_lineage(_start(df, columns, means))
    for _ in range(rounds if targets else min(rounds, 1)):
        before = current.withColumns({f"_was_{c}": F.col(c) for c in targets})
        current = before
        for i, column in enumerate(order, 1):
            training = _assembled(current.filter(~F.col(_mask(column))), column, columns)
            regressor = make().setFeaturesCol("_inputs").setLabelCol(column).setPredictionCol("_predicted")
            model = regressor.fit(training)
            fitted.steps.append((column, model))
            if gaps[column]:
                current = _predict(current, column, model, columns)
                if i % cut_every == 0 or i == len(order):
                    current = cut_lineage(current)
        fitted.rounds += 1
        if not targets:
            break
        moved = current.agg(
            F.greatest(*[F.max(F.abs(F.col(c) - F.col(f"_was_{c}"))) for c in targets], F.lit(0.0))
        ).first()[0]
        current = current.drop(*[f"_was_{c}" for c in targets])
        if moved <= tolerance * largest:
            break
    return fitted, current.drop(*[_mask(c) for c in columns])
