"""Transforms between two images from matched points, by a robust fit for each pair of images.

A model is found on a bounded sample of a pair's matches, as many as `SAMPLE` by a hash: minimal sets are drawn with a seed,
and the model with most matches within `NEAR` pixels wins. It is then fitted by least squares to all matches that it
holds for: these are found by a join and summed up into normal equations before anything is shuffled, so a pair with very
many matches is many tasks' work, and what a task holds of a pair is its sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Models by what is asked for, in the order in which they are tried; matches that each needs, and that a draw takes.
CANDIDATES = {"auto": ("affine_partial", "affine", "homography"), "affine": ("affine_partial", "affine"), "homography": ("homography",), "none": ()}
NEEDS, DRAWN = {"affine_partial": 3, "affine": 3, "homography": 4}, {"affine_partial": 2, "affine": 3, "homography": 4}
NEAR, SAMPLE, DRAWS, ROUNDS = 10.0, 1024, 400, 2
_SIZE = {"affine_partial": 4, "affine": 6, "homography": 8}


def _equations(kind: str, x, y, u, v) -> tuple[np.ndarray, np.ndarray]:
    """Linear equations of a model's parameters, two for each match: (..., 2, size) and (..., 2)."""
    zero, one = np.zeros_like(x), np.ones_like(x)
    if kind == "affine_partial":
        rows = [[x, -y, one, zero], [y, x, zero, one]]
    elif kind == "affine":
        rows = [[x, y, one, zero, zero, zero], [zero, zero, zero, x, y, one]]
    else:
        rows = [[x, y, one, zero, zero, zero, -u * x, -u * y], [zero, zero, zero, x, y, one, -v * x, -v * y]]
    return np.stack([np.stack(r, -1) for r in rows], -2), np.stack([u, v], -1)


def _matrices(kind: str, p: np.ndarray) -> np.ndarray:
    """(..., 3, 3) of parameters (..., size)."""
    zero, one = np.zeros_like(p[..., 0]), np.ones_like(p[..., 0])
    if kind == "affine_partial":
        a, b, s, t = (p[..., i] for i in range(4))
        rows = [a, -b, s, b, a, t, zero, zero, one]
    elif kind == "affine":
        rows = [*(p[..., i] for i in range(6)), zero, zero, one]
    else:
        rows = [*(p[..., i] for i in range(8)), one]
    return np.stack(rows, -1).reshape(*p.shape[:-1], 3, 3)


def _distances(m: np.ndarray, x, y, u, v) -> np.ndarray:
    """How far each match lies from where each model puts it: (models, matches)."""
    to = m @ np.stack([x, y, np.ones_like(x)])
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.hypot(to[..., 0, :] / to[..., 2, :] - u, to[..., 1, :] / to[..., 2, :] - v)
    return np.where(np.isfinite(far), far, np.inf)


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of square systems, and which of them have one."""
    good = np.abs(np.linalg.det(a)) > 1e-9
    out = np.zeros(b.shape)
    if good.any():
        out[good] = np.linalg.solve(a[good], b[good][..., None])[..., 0]
    return out, good & np.isfinite(out).all(-1)


def robust_model(kind: str, points: np.ndarray, seed: int) -> np.ndarray | None:
    """The 3 by 3 matrix that most of (x, y, u, v) agree with, fitted to those; None where matches are too few or lie badly."""
    if len(points) < NEEDS[kind]:
        return None
    middle = points.mean(0)
    scale = max(np.abs(points - middle).max(), 1e-12)
    x, y, u, v = ((points - middle) / scale).T  # fits in numbers around 1
    rng = np.random.default_rng(seed)
    drawn = np.argsort(rng.random((DRAWS, len(points))), 1)[:, : DRAWN[kind]] if len(points) <= 64 else rng.integers(0, len(points), (DRAWS, DRAWN[kind]))
    a, b = _equations(kind, x[drawn], y[drawn], u[drawn], v[drawn])
    size = _SIZE[kind]
    found, good = _solved(a.reshape(DRAWS, size, size), b.reshape(DRAWS, size))
    if not good.any():
        return None
    m = _matrices(kind, found[good])
    held = _distances(m, x, y, u, v) <= NEAR / scale
    best = held[held.sum(1).argmax()]
    for _ in range(ROUNDS):
        if best.sum() < DRAWN[kind]:
            return None
        a, b = _equations(kind, x[best], y[best], u[best], v[best])
        p, *_ = np.linalg.lstsq(a.reshape(-1, size), b.reshape(-1), rcond=None)
        one = _matrices(kind, p)
        best = _distances(one[None], x, y, u, v)[0] <= NEAR / scale
    there = np.array([[1 / scale, 0, -middle[0] / scale], [0, 1 / scale, -middle[1] / scale], [0, 0, 1]])
    back = np.array([[scale, 0, middle[2]], [0, scale, middle[3]], [0, 0, 1]])
    whole = back @ one @ there
    return whole / whole[2, 2] if abs(whole[2, 2]) > 1e-12 else None


_FIT = "model string, m array<double>, frame array<double>"


def _first_fits(by: str, asked: str):
    """A sample of each pair's matches to the first model that can be fitted, and the numbers that bring matches around 1."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, matrices, frames = [], [], []
            for key, rows in zip(batch.column(by).to_pylist(), batch.column("sample"), strict=True):
                points = np.column_stack([rows.values.field(i).to_numpy(zero_copy_only=False) for i in range(4)])
                points = points[np.lexsort(points.T)]
                found = next(((k, m) for k in CANDIDATES[asked] if (m := robust_model(k, points, zlib.crc32(repr(key).encode()))) is not None), None)
                models.append(found[0] if found else None)
                matrices.append(found[1].ravel().tolist() if found else None)
                frames.append([*points.mean(0).tolist(), max(float(np.abs(points - points.mean(0)).max()), 1e-12)])
            yield pa.RecordBatch.from_arrays([batch.column(by), pa.array(models, pa.string()), pa.array(matrices, pa.list_(pa.float64())), pa.array(frames, pa.list_(pa.float64()))], [by, "model", "m", "frame"])

    return fit


def _summed(by: str):
    """Matches beside their pair's model to sums of normal equations over those it holds for, a row a pair and batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sums, held = [], [], []
            groups: dict = {}
            for i, key in enumerate(batch.column(by).to_pylist()):
                groups.setdefault(key, []).append(i)
            at = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xyuv"])
            for key, own in groups.items():
                kind, m, frame = (batch.column(c)[own[0]].as_py() for c in ("model", "m", "frame"))
                points = at[own]
                near = points[_distances(np.array(m).reshape(1, 3, 3), *points.T)[0] <= NEAR]
                a, b = _equations(kind, *((near - np.array(frame[:4])) / frame[4]).T)
                a, b = a.reshape(-1, _SIZE[kind]), b.reshape(-1)
                both = np.zeros((8, 9))
                both[: _SIZE[kind], : _SIZE[kind]], both[: _SIZE[kind], 8] = a.T @ a, a.T @ b
                keys.append(own[0])
                sums.append(both.ravel().tolist())
                held.append(len(near))
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(keys, pa.int64())), pa.array(held, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], [by, "inliers", "sums"])

    return add


def _refitted(by: str):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for kind, m, frame, sums in zip(*(batch.column(c).to_pylist() for c in ("model", "m", "frame", "sums")), strict=True):
                if kind is not None and sums is not None:
                    both = np.array(sums).reshape(8, 9)
                    p, good = _solved(both[None, : _SIZE[kind], : _SIZE[kind]], both[None, : _SIZE[kind], 8])
                    if good[0]:
                        scale, middle = frame[4], frame[:4]
                        there = np.array([[1 / scale, 0, -middle[0] / scale], [0, 1 / scale, -middle[1] / scale], [0, 0, 1]])
                        back = np.array([[scale, 0, middle[2]], [0, scale, middle[3]], [0, 0, 1]])
                        whole = back @ _matrices(kind, p[0]) @ there
                        m = (whole / whole[2, 2]).ravel().tolist()
                out.append(m)
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("model"), pa.array(out, pa.list_(pa.float64())), batch.column("inliers"), batch.column("points")], [by, "model", "matrix", "inliers", "points"])

    return fit


def aligned(matches: DataFrame, by: str, transform: str = "auto") -> DataFrame:
    """(by, model, matrix, inliers, points) of each pair: a 3 by 3 matrix by rows that takes (x, y) to (u, v).

    matches: by, x, y, u, v; those with a null or non-finite number count for nothing. `transform` is auto (a similarity, else
    an affine transform, else a homography), affine, homography or none. model and matrix are null where none can be fitted.
    """
    own = matches.schema[by].dataType.simpleString()
    rows = matches.select(by, *(F.col(c).cast("double").alias(c) for c in "xyuv"))
    rows = rows.where(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xyuv"))
    of = lambda frame, name: frame.withColumnRenamed(by, name)
    counts = of(rows.groupBy(by).agg(F.count(F.lit(1)).alias("points")), "__counted")
    place = F.pmod(F.xxhash64("x", "y", "u", "v"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(counts, F.col(by).eqNullSafe(F.col("__counted"))).where(place * F.col("points") < SAMPLE).select(by, *"xyuv")
    fits = of(drawn.groupBy(by).agg(F.collect_list(F.struct(*"xyuv")).alias("sample")).mapInArrow(_first_fits(by, transform), f"{by} {own}, {_FIT}"), "__fitted")
    held = rows.join(fits.where("model is not null"), F.col(by).eqNullSafe(F.col("__fitted"))).select(by, *"xyuv", "model", "m", "frame")
    sums = held.mapInArrow(_summed(by), f"{by} {own}, inliers long, sums array<double>").groupBy(by).agg(F.sum("inliers").alias("inliers"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(72))).alias("sums"))
    both = counts.join(fits, F.col("__counted").eqNullSafe(F.col("__fitted")), "left").join(of(sums, "__summed"), F.col("__counted").eqNullSafe(F.col("__summed")), "left")
    both = both.select(F.col("__counted").alias(by), "model", "m", "frame", "sums", F.coalesce("inliers", F.lit(0).cast("long")).alias("inliers"), "points")
    return both.mapInArrow(_refitted(by), f"{by} {own}, model string, matrix array<double>, inliers long, points long")
