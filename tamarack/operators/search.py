"""Exact nearest neighbours, votes and decisions.

A query set of at most ``block`` rows, which is counted first, is sent to every
task, and references are read in place.  Beyond that, queries and references are
cut into blocks and slices, and every block meets every slice in a task of its
own.  Both ways keep the k best of each slice or Arrow batch, so the last shuffle
carries k rows a slice and query, not pairs; nothing on the driver or in a task
grows with either side.

Every query gets an answer: ``vote`` with the queries gives those without a
neighbour a count of 0.  ``qid`` is a key.  Null vectors, null values and vectors
of different lengths are errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import TOP_K, approved, l2_float, l2_int
from .kernels import matrix, nearest

#: Queries that are sent to every task at most, and rows of a slice of references.
BLOCK, SLICE = 2048, 100_000


def at_most(df: DataFrame, n: int) -> bool:
    return df.select(F.lit(1)).limit(n + 1).count() <= n


def dealt(key: str, n: int) -> Column:
    """Number of one of ``n`` parts for each row."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def parts_of(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _ranked(found: DataFrame, order: list[str], k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*order)
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def exact_knn(
    queries: DataFrame, refs: DataFrame, k: int = TOP_K, integer: bool = True, skip_self: bool = True, strategy: str = "arrow", block: int = BLOCK, rows: int = SLICE
) -> DataFrame:
    """(qid, ref_id, label, d, rn): the k nearest of ``refs`` (ref_id, v, label) to
    each of ``queries`` (qid, v) by (distance, ref_id).

    strategy: "arrow" computes in NumPy, "native" in higher-order functions.
    ``skip_self`` leaves out the reference whose id is the query's.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if strategy == "native":
        metric = l2_int if integer else l2_float
        q = queries.select("qid", F.col("v").alias("qv"))
        pairs = refs.join(F.broadcast(q) if at_most(queries, block) else q, (F.col("qid") != F.col("ref_id")) if skip_self else F.lit(True))
        return _ranked(pairs.select("qid", "ref_id", "label", metric(F.col("qv"), F.col("v")).alias("d")), ["d", "ref_id"], k)
    if strategy != "arrow":
        raise ValueError(f"no strategy {strategy!r}")
    kind, dtype = ("long", np.int64) if integer else ("double", np.float64)
    schema = f"qid long, ref_id long, label int, d {kind}"

    def best(rows: pa.RecordBatch | pa.Table, q: np.ndarray, qids: np.ndarray) -> list[pa.Array]:
        ref, label = rows.column("ref_id").to_numpy(), rows.column("label").to_numpy()
        j, i, d = nearest(matrix(rows.column("v")), ref, q, qids, k, integer, skip_self)
        return [pa.array(qids[j]), pa.array(ref[i]), pa.array(label[i].astype(np.int32)), pa.array(d.astype(dtype))]

    names = ["qid", "ref_id", "label", "d"]
    refs = refs.select("ref_id", "v", F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"))
    if at_most(queries, block):
        few = queries.select("qid", "v").toArrow()  # ``block`` rows at most
        ids, q = few.column("qid").to_numpy(), matrix(few.column("v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and len(ids):
                    as_arrays = pa.Table.from_batches([b])
                    yield pa.RecordBatch.from_arrays(best(as_arrays, q, ids), names)

        return _ranked(refs.mapInArrow(run, schema), ["d", "ref_id"], k)

    n_blocks, n_slices = parts_of(queries, 8 * block), parts_of(refs, rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = refs.select("*", dealt("ref_id", n_slices).alias("s"), each(n_blocks).alias("b"))
    # Renamed: both sides may come from one table, and a cogroup needs distinct columns.
    right = queries.select(F.col("qid").alias("q"), F.col("v").alias("qv"), dealt("qid", n_blocks).alias("b"), each(n_slices).alias("s"))

    def meet(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return pa.Table.from_pylist([], pa.schema([("qid", pa.int64()), ("ref_id", pa.int64()), ("label", pa.int32()), ("d", pa.from_numpy_dtype(dtype))]))
        return pa.table(best(some, matrix(asked.column("qv")), asked.column("q").to_numpy()), names)

    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(meet, schema)
    return _ranked(found, ["d", "ref_id"], k)


def vote(neighbours: DataFrame, k: int = TOP_K, queries: DataFrame | None = None) -> DataFrame:
    """(qid, n_fraud, n_neighbours, fraud_score, approved): labels among the k nearest.

    Fewer than k neighbours count as they are; the divisor stays k.  With
    ``queries``, each of them has a row, also without a neighbour.
    """
    counted = neighbours.groupBy("qid").agg(F.sum("label").cast("int").alias("n_fraud"), F.count("*").cast("int").alias("n_neighbours"))
    counted = answered(counted, queries, ["n_fraud", "n_neighbours"])
    return counted.withColumn("fraud_score", F.col("n_fraud") / F.lit(float(k))).withColumn("approved", approved(F.col("n_fraud")))


def answered(counted: DataFrame, queries: DataFrame | None, counts: list[str], *more: str) -> DataFrame:
    """``counted`` with a row for each of ``queries`` (qid, ``more``); counts without one are 0."""
    if queries is None:
        return counted
    every = queries.select("qid", *more).distinct()
    joined = every.join(counted, ["qid", *more], "left")
    return joined.select("qid", *more, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
