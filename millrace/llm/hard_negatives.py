"""Operator 13: hard negatives by a vector-approximation file.

Components become integers, floor(scale * x); a score is the inner product of two rows. The file keeps, for each row, the
cell of each of its components: a byte each, beside the integers. Cells are bounded by quantiles of a bounded sample and
by each dimension's extremes over all rows; any bounds would give the same results.

For a block of anchors the score of a row lies between two sums that tables of cells give: each cell's middle times the
anchor's component, and each cell's half width times its absolute value; middle plus half is the upper bound, less the
lower. A row is scored exactly only where its bounds still leave it a place: among an anchor's best `positives` rows of
its label, or among the first `negatives` rows of another label in the window that a positive opens. The k-th best lower
bound, and the k-th best score so far, set the bar. Each task of a pass keeps the k best of its rows for each anchor (and
window); what tasks keep is merged by anchor.

Anchors are a stated query set. They are stored in blocks of about `BLOCK` rows, by a hash of the row; the driver sends one
block at a time to all tasks, and a pass over the file serves a block twice: for its positives, then for its windows. The
results of a block are appended to a table in the shared folder. No pairs are shuffled but those that a task keeps.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows whose
vector is not as long as that of the smallest id; rows with a null id are no anchors and rank last among equal scores.
Rows of equal id and label are rows of their own: an anchor's other rows are all but one of those with its id and vector.
Scores are exact below 2**53. Anchors without positives, and windows without rows, give none. An empty table gives no
rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._text import row_type
from millrace.llm._vectors import blobs, matrix, unblob, usable, width_of
from millrace.session import in_batches, shared_dir

#: Cells of a dimension; rows whose components set their bounds.
CELLS, SAMPLED = 64, 1024
#: Anchors that are sent to all tasks at once; of these and of rows, how many are compared at a time.
BLOCK, ANCHORS, ROWS = 8192, 256, 4096
LAST = (1 << 63) - 1

_FILE = "row long, id long, label long, cells binary, x binary"
_EXTREMES = "dim int, low double, high double"
_BEST = "anchor long, slot int, row long, id long, score double"


class Grid:
    """Cell bounds of each dimension, and tables of each cell's middle and half width."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int = CELLS):
        inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0) if len(sample) else np.zeros((cells - 1, len(low)))
        self.bounds = np.ceil(np.clip(inner, low, high)).T.copy()  # (dims, cells - 1), of integers: a cell holds [bound, next bound)
        edge_low, edge_high = np.column_stack([low, self.bounds]), np.column_stack([self.bounds - 1, high])
        edge_high = np.maximum(edge_low, edge_high)  # empty cells
        self.middle, self.half = (edge_low + edge_high) / 2, (edge_high - edge_low) / 2

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(b, x[:, d], "right") for d, b in enumerate(self.bounds)]).astype(np.uint8) if x.shape[1] else np.zeros((len(x), 0), np.uint8)

    def tables(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles and half widths of rows of cells."""
        dims = np.arange(cells.shape[1])
        return self.middle[dims, cells], self.half[dims, cells]


def _scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * vectors)


def _extremes(width: int, scale: int, kind: pa.Schema):
    """The least and the greatest component of each dimension, once a task."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = _scaled(matrix(batch.column("vector"), width), scale)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        if np.isfinite(low).all():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(low), pa.array(high)], schema=kind)

    return find


def _filed(grid: Grid, width: int, scale: int, kind: pa.Schema):
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _scaled(matrix(batch.column("vector"), width), scale)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("label"), blobs(grid.cells(x)), blobs(x)], schema=kind)

    return file


class Anchors:
    """A block of anchors: place in the block, row, label, components, and the windows that are open for each."""

    def __init__(self, rows: list, width: int):
        self.row = np.array([r.row for r in rows], np.int64)
        self.label = np.array([r.label for r in rows], np.int64)
        self.x = np.array([np.frombuffer(r.x, np.float64) for r in rows]).reshape(len(rows), width)


class Best:
    """The k best (score, then id, then row) for each key of a task, over its batches."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def bar(self, key: tuple[int, int]) -> float:
        """A score that a row must reach to have a place."""
        held = self.held.get(key)
        return held[-1][0] if held and len(held) == self.k else -np.inf

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((rows, ids, -scores))[: self.k]
        new = [(float(scores[i]), int(ids[i]), int(rows[i])) for i in order]
        self.held[key] = sorted(self.held.get(key, []) + new, key=lambda r: (-r[0], r[1], r[2]))[: self.k]

    def batch(self, kind: pa.Schema) -> pa.RecordBatch:
        rows = [(a, s, r, i, v) for (a, s), held in self.held.items() for v, i, r in held]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kind, strict=True)], schema=kind)


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _bounded(batches: Iterator[pa.RecordBatch], anchors: Anchors, grid: Grid, width: int):
    """For each piece of rows and anchors: first anchor, row numbers, ids, labels, components, bounds of all their scores."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows, ids, labels = (part.column(c).to_numpy() for c in ("row", "id", "label"))
            x = unblob(part.column("x"), np.float64, (width,))
            middle, half = grid.tables(unblob(part.column("cells"), np.uint8, (width,)))
            for first in range(0, len(anchors.row), ANCHORS):
                a = anchors.x[first : first + ANCHORS]
                centre, slack = a @ middle.T, np.abs(a) @ half.T
                slack += 1e-9 * (np.abs(centre) + slack)  # sums of rounded terms
                yield first, rows, ids, labels, x, centre - slack, centre + slack


def _positives(anchors: Anchors, grid: Grid, width: int, k: int, kind: pa.Schema):
    """The k best other rows of each anchor's label, in slot 0."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for first, rows, ids, labels, x, low, high in _bounded(batches, anchors, grid, width):
            for j in range(len(low)):
                a = first + j
                same = np.flatnonzero((labels == anchors.label[a]) & (rows != anchors.row[a]))
                if len(same):
                    bar = max(best.bar((a, 0)), _kth(low[j, same], k))
                    maybe = same[high[j, same] >= bar]
                    if len(maybe):
                        best.add((a, 0), x[maybe] @ anchors.x[a], ids[maybe], rows[maybe])
        yield best.batch(kind)

    return search


def _negatives(anchors: Anchors, windows: dict[int, list[tuple[int, float, float]]], grid: Grid, width: int, k: int, kind: pa.Schema):
    """The k best rows of other labels in each window of each anchor: windows has slot, lowest and highest score."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for first, rows, ids, labels, x, low, high in _bounded(batches, anchors, grid, width):
            for j in range(len(low)):
                a = first + j
                mine = windows.get(a)
                if not mine:
                    continue
                least, most = min(w[1] for w in mine), max(w[2] for w in mine)
                near = np.flatnonzero((high[j] >= least) & (low[j] <= most) & (labels != anchors.label[a]))
                if not len(near):
                    continue
                lows, highs, exact = low[j, near], high[j, near], {}
                for slot, least, most in mine:
                    surely = lows[(lows >= least) & (highs <= most)]
                    bar = max(best.bar((a, slot)), _kth(surely, k), least)
                    maybe = near[(highs >= bar) & (lows <= most)]
                    new = [i for i in maybe.tolist() if i not in exact]
                    exact.update(zip(new, (x[new] @ anchors.x[a]).tolist(), strict=True))
                    scores = np.array([exact[i] for i in maybe.tolist()])
                    inside = (scores >= least) & (scores <= most) if len(maybe) else np.zeros(0, bool)
                    if inside.any():
                        best.add((a, slot), scores[inside], ids[maybe[inside]], rows[maybe[inside]])
        yield best.batch(kind)

    return search


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of what the tasks kept, with their rank from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def window_of(score: float, low: int, high: int) -> tuple[float, float]:
    """The scores s with low * score <= 100 * s <= high * score, as the least and the greatest integer."""
    return float(-(-low * int(score) // 100)), float(high * int(score) // 100)


def mine(rows: DataFrame, anchor: Column, *, vector: str = "embedding", label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, folder: str | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of which `anchor` holds.

    rows: vec_id, label (or what the column `label` gives) and the vector. folder: a new folder, shared by all executors, that
    the result reads and the caller may remove after use.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    held = rows.select(F.col("vec_id").cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    held = held.where(F.col("label").isNotNull() & usable(F.col("vector")))
    width = width_of(held.withColumn("at", F.struct(F.col("id").isNull().alias("none"), "id")), "at", "vector")
    held = held.where(F.size("vector") == width).withColumn("is_anchor", F.col("is_anchor") & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.coalesce("id", F.lit(LAST)))
    held.write.parquet(f"{folder}/rows")  # from here on a row's number is the same for all readers
    held = spark.read.parquet(f"{folder}/rows")

    kind, arrow = row_type(_EXTREMES)
    extremes = in_batches(held.select("vector"), _extremes(width, scale, arrow), kind).groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    asked = held.where("is_anchor").select("row")
    n_anchors = asked.count()
    out, file_kind, best_kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long", row_type(_FILE), row_type(_BEST)
    if not n_anchors:
        return spark.createDataFrame([], out)
    sample = held.select("vector").orderBy(F.xxhash64("row"), "row").limit(SAMPLED).collect()
    grid = Grid(_scaled(np.array([r[0] for r in sample], np.float64).reshape(len(sample), width), scale), np.array([r.low for r in extremes]), np.array([r.high for r in extremes]))
    in_batches(held.select("row", "id", "label", "vector"), _filed(grid, width, scale, file_kind[1]), file_kind[0]).write.parquet(f"{folder}/file")
    file = spark.read.schema(file_kind[0]).parquet(f"{folder}/file")

    blocks = -(-n_anchors // BLOCK)
    (file.join(asked, "row", "left_semi").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).write.partitionBy("block").parquet(f"{folder}/anchors"))
    anchors = spark.read.parquet(f"{folder}/anchors")
    for b in range(blocks):
        rows_of = anchors.where(F.col("block") == b).select("row", "id", "label", "x").collect()
        if not rows_of:
            continue
        block = Anchors(rows_of, width)
        best = _merged(in_batches(file, _positives(block, grid, width, positives, best_kind[1]), best_kind[0]), positives).collect()  # as many as `positives` an anchor
        windows: dict[int, list[tuple[int, float, float]]] = {}
        for r in best:
            windows.setdefault(r.anchor, []).append((r.rank, *window_of(r.score, low, high)))
        windows = {a: kept for a, all_ in windows.items() if (kept := [w for w in all_ if w[1] <= w[2]])}
        known = spark.createDataFrame([(r.anchor, r.rank, rows_of[r.anchor].id, r.id, r.score) for r in best], "anchor long, slot int, anchor_id long, positive_id long, positive_score double")
        found = _merged(in_batches(file, _negatives(block, windows, grid, width, negatives, best_kind[1]), best_kind[0]), negatives)
        found = found.join(F.broadcast(known), ["anchor", "slot"])
        unknown = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
        found = found.select("anchor_id", unknown("positive_id"), "rank", F.when(F.col("id") != LAST, F.col("id")).alias("negative_id"), F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))
        found.write.mode("append").parquet(f"{folder}/found")
    return spark.read.schema(out).parquet(f"{folder}/found")
