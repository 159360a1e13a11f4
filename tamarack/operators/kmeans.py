"""Lloyd's k-means over DataFrames.

Centroids (k rows) are the only thing on the driver.  Each round assigns in a
NumPy kernel, which also sums what it assigned, in fixed point, so partial sums
add up exactly in any order.  A centroid without points stays where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import delete, work_path
from .kernels import CELLS, distances, matrix

FIXED = 1e9


@dataclass
class KMeans:
    centroids: np.ndarray
    #: The centroids that the stored assignments refer to: those before the last update.
    assigned_by: np.ndarray
    movements: list[float]
    #: Points that ``assigned_by`` gives to each centroid.
    sizes: np.ndarray


def initial(points: DataFrame, k: int, seed: int | None = None) -> np.ndarray:
    """k distinct points: the lowest ids or, with a seed, the lowest id hashes."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = [F.col("ref_id")] if seed is None else [F.xxhash64(F.lit(seed), "ref_id"), F.col("ref_id")]
    rows = points.select("ref_id", "v").orderBy(*order).limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"k = {k}, but there are {len(rows)} points")
    return np.array([r.v for r in rows], dtype=np.float64)


def closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // len(centroids))
    return np.concatenate([distances(x[at : at + step], centroids, False).argmin(1) for at in range(0, len(x), step)])


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``points`` with cid, the nearest centroid's number; ties: the lowest."""
    fields = points.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid = closest(matrix(b.column("v")), centroids) if b.num_rows else np.zeros(0)
            yield b.append_column("cid", pa.array(cid.astype(np.int32)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", cid int"
    return points.mapInArrow(run, schema)


def _sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                cid = closest(x, centroids)
                fixed = (np.sign(x) * np.floor(np.abs(x * FIXED) + 0.5)).astype(np.int64)
                np.add.at(total, cid, fixed)
                n += np.bincount(cid, minlength=k)
        some = np.flatnonzero(n)
        sums = pa.array([row.tolist() for row in total[some]], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), sums, pa.array(n[some])], ["cid", "total", "n"])

    part = points.select("v").mapInArrow(run, "cid int, total array<long>, n long")
    each = part.select("cid", "n", F.posexplode("total").alias("i", "x"))
    return each.groupBy("cid", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))


def _round(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and numbers of the points assigned to each centroid: k * dim numbers."""
    new, sizes = centroids.copy(), np.zeros(len(centroids), dtype=np.int64)
    for r in _sums(points, centroids).collect():
        new[r.cid, r.i] = float(r.x) / float(r.n) / FIXED
        sizes[r.cid] = r.n
    return new, sizes


def update(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The means of the points assigned to each centroid; one without any stays."""
    return _round(points, centroids)[0]


def movement(old: np.ndarray, new: np.ndarray) -> float:
    return float(np.sqrt(((new - old) ** 2).sum(1)).sum())


def train(points: DataFrame, k: int, rounds: int = 20, tolerance: float = 1e-4, seed: int | None = None, copy: bool = True) -> KMeans:
    """At most ``rounds`` rounds over ``points`` (ref_id, v, ...), fewer once the
    centroids' total movement falls below ``tolerance``.

    Every round reads the points again, so ``copy`` writes the two columns once to
    the shared folder; without it the input must be cheap to read, as a table is.
    """
    spark, path = points.sparkSession, None
    if copy:
        path = work_path(spark, "kmeans-points")
        points.select("ref_id", "v").write.parquet(path)
        points = spark.read.parquet(path)
    now, moves = initial(points, k, seed), []
    before, sizes = now, None
    for _ in range(rounds):
        before = now
        now, sizes = _round(points, now)
        moves.append(movement(before, now))
        if moves[-1] < tolerance:
            break
    sizes = _round(points, before)[1] if sizes is None else sizes
    if path:
        delete(spark, path)
    return KMeans(now, before, moves, sizes)
