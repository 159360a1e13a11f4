"""Inverted-file index: clustered, quantised reference vectors.

Stored as Parquet: ``lists`` partitioned by cluster (cid, ref_id, v, label),
``centroids`` (cid, v, size) and one row of ``meta``.  Assignments are those made
before the last update of the centroids, as the training loop leaves them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import CAP, abs_max, fit_scale, quantize
from .kmeans import KMeans, assign, train

VERSION, FILE_ROWS = 2, 1_000_000
LISTS = "ref_id long, label int, v array<smallint>, cid int"


def quantize_matrix(x: np.ndarray, scale: float) -> np.ndarray:
    y = x * scale
    return np.clip(np.sign(y) * np.floor(np.abs(y) + 0.5), -CAP, CAP).astype(np.int64)


@dataclass
class IvfIndex:
    lists: DataFrame  # ref_id, label, v (quantised), cid
    centroids: np.ndarray  # quantised, a row for each cid
    scale: float
    counts: np.ndarray | None = None  # vectors of each list

    @property
    def k(self) -> int:
        return len(self.centroids)

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def build(cls, points: DataFrame, k: int, rounds: int = 20, seed: int | None = None, model: KMeans | None = None, copy: bool = True) -> IvfIndex:
        """Train on ``points`` (ref_id, v, label), quantise and cluster them.

        The lists are computed anew by each search until the index is saved.  A
        ``model`` must have been trained on these points.  ``copy``: see ``train``.
        """
        model = model or train(points, k, rounds, seed=seed, copy=copy)
        scale = fit_scale(max(abs_max(points, "v"), float(np.abs(model.centroids).max())))
        lists = assign(points.select("ref_id", "label", "v"), model.assigned_by).withColumn("v", quantize(F.col("v"), scale))
        return cls(lists, quantize_matrix(model.centroids, scale), scale, model.sizes)

    def list_sizes(self) -> np.ndarray:
        """Vectors of each list: k numbers, counted once where they are not known."""
        if self.counts is None:
            self.counts = np.zeros(self.k, dtype=np.int64)
            for r in self.lists.groupBy("cid").agg(F.count("*").alias("n")).collect():
                self.counts[r.cid] = r.n
        return self.counts

    def sizes(self) -> DataFrame:
        """(cid, size, start): list sizes and their exclusive running sum, k rows."""
        counts = self.lists.groupBy("cid").count()
        every = self.lists.sparkSession.range(self.k).select(F.col("id").cast("int").alias("cid"))
        size = every.join(counts, "cid", "left").select("cid", F.coalesce("count", F.lit(0)).cast("long").alias("size"))
        before = Window.orderBy("cid").rowsBetween(Window.unboundedPreceding, -1)
        return size.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))

    def save(self, path: str) -> None:
        spark = self.lists.sparkSession
        # A long list goes to several tasks, and so to several files.
        size = self.list_sizes()
        parts = [(c, max(1, -(-int(n) // FILE_ROWS))) for c, n in enumerate(size)]
        dealt = self.lists.join(F.broadcast(spark.createDataFrame(parts, "cid int, parts int")), "cid")
        dealt = dealt.repartition("cid", F.pmod(F.xxhash64("ref_id"), "parts")).sortWithinPartitions("cid", "ref_id").drop("parts")
        dealt.write.mode("overwrite").partitionBy("cid").parquet(f"{path}/lists")
        rows = [(i, [int(x) for x in c], int(size[i])) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(rows, "cid int, v array<int>, size long").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        n = int(size.sum())
        spark.createDataFrame([(VERSION, self.k, self.dim, n, self.scale)], "version int, k int, d int, n long, scale double").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dim: int | None = None) -> IvfIndex:
        """The index at ``path``; raises if its parts or ``dim`` do not agree."""
        meta = spark.read.parquet(f"{path}/meta").first()
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cid").collect()
        centroids = np.array([r.v for r in rows], dtype=np.int64)
        if meta is None or meta.version != VERSION or sum(r["size"] for r in rows) != meta.n or centroids.shape != (meta.k, meta.d):
            raise ValueError(f"{path}: meta and centroids do not agree")
        if dim is not None and dim != meta.d:
            raise ValueError(f"{path}: vectors of {meta.d} values; {dim} expected")
        lists = spark.read.schema(LISTS).parquet(f"{path}/lists")
        return cls(lists, centroids, meta.scale, np.array([r["size"] for r in rows], dtype=np.int64))

    def persist(self) -> IvfIndex:
        """Keep the lists in memory and touch them, before requests come."""
        self.lists.persist()
        self.lists.count()
        return self

    def unpersist(self) -> None:
        self.lists.unpersist()
