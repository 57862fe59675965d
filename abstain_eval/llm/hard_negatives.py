"""Hard negatives by integer inner products, read through zone maps of Hilbert-ordered blocks.

Rows are ordered along a Hilbert curve through the `DIMS` components that vary most, cut into
blocks of up to `BLOCK` vectors and written as Parquet, one row for each block: its ids, labels
and vectors, and its zone map, which is the least and the greatest value of every component and
the labels that occur. Anchors are cut into groups along the same curve.

A search gives every anchor one or more windows of scores and wants the best rows within each.
Interval arithmetic on zone maps (positive components of the anchor times greatest values,
negative ones times least, and the reverse) bounds what a block can score. Each window first reads
the block that looks best for it, and then every other block whose bounds meet what is still
open: scores within the window that are not below the worst of the rows it has. So no row that
belongs to the result is in a block that is not read. Positives are one search with an open
window among rows of the anchor's label; negatives are one with a window for each positive among
rows of other labels.

Zone maps are read without the vectors beside them. Blocks and groups of anchors meet in pairs, one
block and one group at a time in a task, and a task keeps only the best rows of one group. How
many pairs there are hangs on the data: components that vary alike in many dimensions leave bounds
wide, and then nearly all blocks are read, which is the stated query set against all rows.

A vector is floor(256 * x) of its components. Rows with a null id or label, a null or empty
vector, or null or non-finite components take no part; nor do vectors whose inner product with
themselves is 2 ** 62 or more, since scores of the others are then sure to fit 64 bits. Vectors
meet only vectors of their own length. Rows that repeat id, label and vector are one row; an
anchor never meets rows with its own id. Empty tables and tables without anchors give empty
results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abstain_eval.llm.common import tasks, written

BLOCK = 4096
GROUP = 1024  # anchors that meet a block at a time
PAGE = 1024  # zone maps that meet a group at a time
DIMS, DIM_BITS = 8, 7
ANCHOR_STEP = 50
POSITIVES, NEGATIVES = 5, 3
SELF_LIMIT = 2.0**62
NONE = np.iinfo(np.int64).min
LEAST, MOST = NONE + 1, np.iinfo(np.int64).max


def usable_rows(vectors: DataFrame, label: Column) -> DataFrame:
    """(id, label, q, width) of the rows that take part."""
    scaled = F.transform("embedding", lambda v: F.lit(256.0) * v.cast("double"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("int").alias("label"), scaled.alias("x"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & fine)
    with_self = F.aggregate("x", F.lit(0.0), lambda total, v: total + F.pow(F.abs(v) + 1, F.lit(2.0)))
    whole = F.transform("x", lambda v: F.floor(v).cast("int"))
    return rows.filter(with_self < SELF_LIMIT).select("id", "label", whole.alias("q"), F.size("x").alias("width"))


def matrix_of(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, vectors) for every length of vectors in a batch."""
    lists = batch.column("q")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(sizes):
        at = np.flatnonzero(sizes == width)
        yield int(width), at, matrix_of(lists.take(pa.array(at)), int(width))


def spreads(rows: DataFrame) -> tuple[int, list[tuple[int, float, float]]]:
    """The number of rows, and (component, mean, deviation) of the components that vary most."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, q in by_width(batch):
                q = q.astype(np.float64)
                columns = [np.arange(width), np.full(width, float(len(at))), q.sum(0), (q * q).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["place", "n", "s", "ss"])

    parts = rows.select("q").mapInArrow(sums, "place long, n double, s double, ss double")
    whole = parts.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    variance = F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0))
    found = whole.select("place", "n", (F.col("s") / F.col("n")).alias("mean"), F.greatest(variance, F.lit(0.0)).alias("variance"))
    top = found.orderBy(F.desc("variance"), "place").limit(DIMS).collect()
    n = found.agg(F.max("n")).first()[0] or 0
    return int(n), [(r["place"], r["mean"], float(np.sqrt(r["variance"]))) for r in top]


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of points with integer coordinates below 2 ** bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns and mirrorings of every level
        bit, below = 1 << level, (1 << level) - 1
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    keys = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys << 1 | (x[i] >> level & 1)
    return keys


def on_curve(rows: DataFrame, dims: list[tuple[int, float, float]]) -> DataFrame:
    """Rows with their place on the curve; components are cut at 2.5 deviations."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.int64)
            for width, at, q in by_width(batch):
                points = np.zeros((len(at), len(dims)), np.int64)
                for i, (component, mean, deviation) in enumerate(dims):
                    if component < width and deviation > 0:
                        share = (q[:, component] - mean) / (5 * deviation) + 0.5
                        points[:, i] = np.clip(share * (1 << DIM_BITS), 0, (1 << DIM_BITS) - 1)
                keys[at] = hilbert_keys(points, DIM_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(place, "id long, label int, q array<int>, width int, place long")


CUT = "width int, block long, ids binary, labels binary, vectors binary, low binary, high binary, label_set array<int>"


def cut_blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Rows in blocks of up to `size` along the curve, ids ascending within a block."""
    parts = max(1, min(-(-n // size), tasks(rows)), -(-n // (64 * size)))
    order = ["width", "place", "id", "label"]
    ordered = rows.repartitionByRange(parts, "width", "place", "id").sortWithinPartitions(*order, "q")

    def block_of(number: int, width: int, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> dict:
        by_id = np.argsort(ids, kind="stable")
        ids, labels, q = ids[by_id], labels[by_id], np.ascontiguousarray(q[by_id], dtype="<i4")
        return {
            "width": width, "block": number, "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i4").tobytes(),
            "vectors": q.tobytes(), "low": q.min(0).tobytes(), "high": q.max(0).tobytes(), "label_set": np.unique(labels).tolist(),
        }

    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int32())]
    schema = pa.schema(list(zip([c.split()[0] for c in CUT.split(", ")], types, strict=True)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made, held_width, held, last = 0, None, None, None
        for batch in batches:
            all_ids, all_labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for width, at, q in by_width(batch):
                ids, labels = all_ids[at], all_labels[at]
                if width != held_width:
                    if held is not None and len(held[0]):
                        yield pa.RecordBatch.from_pylist([block_of(first + made, held_width, *held)], schema=schema)
                        made += 1
                    held_width, held, last = width, None, None
                fresh = np.ones(len(ids), bool)  # equal rows stand side by side
                fresh[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (q[1:] != q[:-1]).any(1)
                if last is not None:
                    fresh[0] = last[0] != ids[0] or last[1] != labels[0] or (last[2] != q[0]).any()
                last = ids[-1], labels[-1], q[-1]
                part = ids[fresh], labels[fresh], q[fresh]
                held = part if held is None else tuple(np.concatenate(p) for p in zip(held, part, strict=True))
                while len(held[0]) >= size:
                    yield pa.RecordBatch.from_pylist([block_of(first + made, width, *(h[:size] for h in held))], schema=schema)
                    made += 1
                    held = tuple(h[size:] for h in held)
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_pylist([block_of(first + made, held_width, *held)], schema=schema)

    return ordered.select("id", "label", "q").mapInArrow(cut, CUT)


def longs(data: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(shape)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that each anchor can have in each block."""
    a, low, high = anchors.astype(float), low.astype(float).T, high.astype(float).T
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)) * 1e-12
    return up @ low + down @ high - slack, up @ high + down @ low + slack


class Anchors:
    """One group of anchors with their windows: at [anchor, slot] scores from `low` to `high`."""

    def __init__(self, row: dict):
        self.ids, self.labels = longs(row["ids"], -1), np.frombuffer(row["labels"], "<i4")
        self.vectors = np.frombuffer(row["vectors"], "<i4").reshape(len(self.ids), -1)
        self.low, self.high = (longs(row[c], len(self.ids), -1) for c in ("window_low", "window_high"))

    def eligible(self, label_sets: list[list[int]], same: bool) -> np.ndarray:
        """Whether a block holds rows of an anchor's label, or of another one."""
        if same:
            return np.array([np.isin(self.labels, s) for s in label_sets]).T
        return np.array([(len(s) > 1) | (self.labels != s[0]) for s in label_sets]).T


def chosen_blocks(groups: DataFrame, zones: DataFrame, n_blocks: int, same: bool, worst: bool) -> DataFrame:
    """(group, block) pairs to read: the block that looks best for each window, or with `worst` all that bounds leave open.

    Zone maps come in pages; every group meets every page of its length of vectors.
    """
    pages, lanes = -(-n_blocks // PAGE), tasks(groups)
    zone = F.struct("block", "low", "high", "label_set")
    paged = zones.groupBy("width", F.pmod(F.xxhash64("block"), F.lit(pages)).alias("page")).agg(F.collect_list(zone).alias("zones"))
    paged = paged.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    met = groups.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long")))).withColumn(
        "lane", F.pmod(F.xxhash64("group"), F.lit(lanes)).cast("int")
    ).join(paged, ["width", "page", "lane"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                anchors, zones = Anchors(row), row["zones"]
                low, high = (np.array([np.frombuffer(z[c], "<i4") for z in zones]) for c in ("low", "high"))
                least, most = bounds(anchors.vectors, low, high)
                fits = anchors.eligible([z["label_set"] for z in zones], same)
                picked = np.zeros(len(zones), bool)
                for slot in range(anchors.low.shape[1]):
                    floor, roof = (w[:, slot].astype(float)[:, None] for w in (anchors.low, anchors.high))
                    if worst:
                        floor = np.maximum(floor, longs(row["worst"], len(anchors.ids), -1)[:, slot].astype(float)[:, None])
                    open_ = fits & (most >= floor - np.abs(floor) * 1e-12) & (least <= roof + np.abs(roof) * 1e-12)
                    if worst:
                        picked |= open_.any(0)
                    else:
                        promise = most if same else -np.abs((least + most) / 2 - roof)
                        some = open_.any(1)
                        picked[np.unique(np.where(open_, promise, -np.inf)[some].argmax(1))] = True
                blocks = np.array([z["block"] for z in zones], np.int64)[picked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(blocks), row["group"], np.int64)), pa.array(blocks)], names=["group", "block"]
                )

    return met.mapInArrow(choose, "group long, block long")


def scores_of(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products; floating point holds them where no partial sum can reach 2 ** 53."""
    a, b = anchors.astype(np.float64), vectors.astype(np.float64)
    if (np.sqrt((a * a).sum(1)).max() + 1) * (np.sqrt((b * b).sum(1)).max() + 1) < 2.0**52:
        return (a @ b.T).astype(np.int64)
    return anchors.astype(np.int64) @ vectors.astype(np.int64).T


def best_of_block(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row and their ids, best first, ties to lesser ids; `ids` ascend, and NONE marks what doesn't count."""
    n, m = scores.shape
    k_here = min(k, m)
    valid = scores != NONE
    if np.abs(np.where(valid, scores, 0)).max(initial=0) < 2**49:
        ranked = np.where(valid, scores * 8192 + (8191 - np.arange(m)), NONE)
        top = np.argpartition(ranked, m - k_here, axis=1)[:, m - k_here :]
        top = np.take_along_axis(top, np.argsort(~np.take_along_axis(ranked, top, 1), axis=1), 1)
    else:
        top = np.argsort(~scores, axis=1, kind="stable")[:, :k_here]
    found = np.take_along_axis(scores, top, 1)
    pad = ((0, 0), (0, k - k_here))
    return np.pad(found, pad, constant_values=NONE), np.pad(np.where(found != NONE, ids[top], 0), pad)


def best_of_both(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists of [anchor, slot, k] scores and ids, best first."""
    k = left[0].shape[-1]
    scores, ids = (np.concatenate(p, axis=-1) for p in zip(left, right, strict=True))
    order = np.lexsort((ids, ~scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


STATE = "group long, scores binary, found binary"
HELD_GROUPS = 16


def state_rows(states: dict[int, tuple]) -> pa.RecordBatch:
    columns = [pa.array(list(states), pa.int64())]
    columns += [pa.array([s[i].astype("<i8").tobytes() for s in states.values()], pa.binary()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["group", "scores", "found"])


def read_blocks(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """Best rows of every group in the blocks that it reads; a row for a group in each task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                anchors = Anchors(row)
                ids, labels = longs(row["b_ids"], -1), np.frombuffer(row["b_labels"], "<i4")
                scores = scores_of(anchors.vectors, np.frombuffer(row["b_vectors"], "<i4").reshape(len(ids), -1))
                fits = (anchors.labels[:, None] == labels) == same
                fits &= anchors.ids[:, None] != ids
                slots = []
                for slot in range(anchors.low.shape[1]):
                    inside = fits & (scores >= anchors.low[:, slot, None]) & (scores <= anchors.high[:, slot, None])
                    slots.append(best_of_block(np.where(inside, scores, NONE), ids, k))
                found = tuple(np.stack(part, axis=1) for part in zip(*slots, strict=True))
                group = row["group"]
                states[group] = best_of_both(states.pop(group), found) if group in states else found
                if len(states) > HELD_GROUPS:  # the group that was met longest ago
                    yield state_rows({(oldest := next(iter(states))): states.pop(oldest)})
        if states:
            yield state_rows(states)

    parts = tasks(pairs)
    asked = pairs.join(groups, "group").repartition(parts, "block")
    payload = blocks.select("block", *(F.col(c).alias(f"b_{c}") for c in ("ids", "labels", "vectors")))
    return asked.join(payload.repartition(parts, "block"), "block").mapInArrow(read, STATE)


def combined(states: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """One state for each group."""
    shaped = states.join(anchors.select("group", F.expr("length(ids) div 8").alias("n")), "group")

    def merge(table: pa.Table) -> pa.Table:
        state = None
        for row in table.to_pylist():
            part = tuple(longs(row[c], row["n"], -1, k) for c in ("scores", "found"))
            state = part if state is None else best_of_both(state, part)
        return pa.Table.from_batches([state_rows({table["group"][0].as_py(): state})])

    return shaped.groupBy("group").applyInArrow(merge, STATE)


def search(groups: DataFrame, blocks: DataFrame, n_blocks: int, same: bool, k: int) -> DataFrame:
    """(group, scores, found) of the k best rows in every window; groups that meet nothing have none."""
    zones = blocks.select("width", "block", "low", "high", "label_set")
    first = written(chosen_blocks(groups, zones, n_blocks, same, False), "first-blocks")
    state = written(combined(read_blocks(first, groups, blocks, same, k), groups, k), "first-found")

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            worst = [longs(s, -1, k).min(1).astype("<i8").tobytes() for s in batch.column("scores").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(worst, pa.binary())], names=["group", "worst"])

    # A window without any block to begin with has none to go on with.
    going = groups.join(state.select("group", "scores").mapInArrow(lowest, "group long, worst binary"), "group")
    rest = chosen_blocks(going, zones, n_blocks, same, True).join(first, ["group", "block"], "left_anti")
    more = read_blocks(written(rest, "rest-blocks"), groups, blocks, same, k)
    return written(combined(state.unionByName(more), groups, k), "found")


WINDOWED = "width int, group long, ids binary, labels binary, vectors binary, window_low binary, window_high binary, positive_scores binary, positives binary"


def windows_of(groups: DataFrame, share_low: int, share_high: int, positives: int) -> DataFrame:
    """Groups with a window for each positive: from `share_low` to `share_high` percent of its score."""

    def ceiling(scores: np.ndarray, percent: int) -> np.ndarray:  # of scores * percent / 100, without overflow
        return scores // 100 * percent + -(-(scores % 100 * percent) // 100)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for scores in batch.column("positive_scores").to_pylist():
                scores = longs(scores, -1, positives)
                there = scores != NONE
                low = ceiling(scores, share_low)
                high = scores // 100 * share_high + scores % 100 * share_high // 100
                lows.append(np.where(there, low, 1).astype("<i8").tobytes())
                highs.append(np.where(there, high, 0).astype("<i8").tobytes())  # an empty window
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {"window_low": pa.array(lows, pa.binary()), "window_high": pa.array(highs, pa.binary())}
            names = [c.split()[0] for c in WINDOWED.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return groups.mapInArrow(add, WINDOWED)


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined_rows(groups: DataFrame, positives: int, negatives: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = longs(row["ids"], -1)
                positive, positive_score = (longs(row[c], len(ids), positives) for c in ("positives", "positive_scores"))
                negative, score = (longs(row[c], len(ids), positives, negatives) for c in ("found", "scores"))
                anchor, slot, rank = np.nonzero(score != NONE)
                columns = [
                    pa.array(ids[anchor]), pa.array(positive[anchor, slot]), pa.array((rank + 1).astype(np.int32)),
                    pa.array(negative[anchor, slot, rank]), pa.array(positive_score[anchor, slot]), pa.array(score[anchor, slot, rank]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MINED.split(", ")])

    return groups.mapInArrow(rows, MINED)


def hard_negatives(
    vectors: DataFrame, label: Column | None = None, anchor_step: int = ANCHOR_STEP, positives: int = POSITIVES,
    negatives: int = NEGATIVES, share_low: int = 50, share_high: int = 95,
) -> DataFrame:
    """For each anchor and each of its best positives, the best rows of other labels within a share of the positive's score.

    `vectors` has vec_id, embedding and the columns that `label` needs (by default: label).
    Anchors are the ids divisible by `anchor_step`.
    """
    rows = usable_rows(vectors, F.col("label") if label is None else label)
    n, dims = spreads(rows)
    if not n:
        return vectors.sparkSession.createDataFrame([], MINED)
    placed = on_curve(rows, dims)
    blocks = written(cut_blocks(placed, BLOCK, n), "blocks")
    counted = blocks.agg(F.count("*")).first()[0]
    asked = cut_blocks(placed.filter(F.col("id") % anchor_step == 0), GROUP, -(-n // anchor_step))
    anchors = written(asked.select("width", F.col("block").alias("group"), "ids", "labels", "vectors"), "anchors")
    n_of = F.expr("cast(length(ids) div 8 as int)")

    def filled(value: int) -> Column:
        """One window for each anchor, open on this side."""
        return F.unhex(F.repeat(F.lit(np.int64(value).astype("<i8").tobytes().hex()), n_of))

    whole = anchors.withColumns({"window_low": filled(LEAST), "window_high": filled(MOST)})
    near = search(whole, blocks, counted, True, positives).withColumnsRenamed({"scores": "positive_scores", "found": "positives"})
    windowed = written(windows_of(anchors.join(near, "group"), share_low, share_high, positives), "windows")
    far = search(windowed, blocks, counted, False, negatives)
    return mined_rows(windowed.select("group", "ids", "positives", "positive_scores").join(far, "group"), positives, negatives)
