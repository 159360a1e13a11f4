"""Approximate search over an inverted-file index, plain and adaptive.

``probe`` gives each query the numbers of its nearest clusters; probes and lists
meet by cluster.  A long list is cut into slices of ``rows`` vectors and the
queries of a cluster into blocks of ``block``; every pair of slice and block is a
group of its own, so neither a hot list nor a hot cluster grows a task.  A group
keeps the k best of each query, so the last shuffle carries k rows a query and
probed slice.  Lists are read once, those that no query probes not at all (by
partition where the index is stored).  The driver sees one count a cluster.

Where only the decision of the adaptive vote is asked for, there are two scans: that
of the fast probe gives each query the distance of its k-th neighbour, and the
queries whose fast count is in the band look for closer ones in the other lists.

Every query is answered: one whose probed lists are empty has a count of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import TOP_K, approved
from ..storage import work_path
from . import cells
from .cells import ranks, vector_array
from .index import IvfIndex, quantize_matrix
from .kernels import matrix, nearest_in_boxes
from .search import answered, at_most, vote

FAST_NPROBE, NPROBE, BAND = 5, 70, (2, 3)
BLOCK, SLICE = 16_384, 65_536
_FOUND = "qid long, ref_id long, label int, d long, crank int"
_FOUND_ARROW = pa.schema([("qid", pa.int64()), ("ref_id", pa.int64()), ("label", pa.int32()), ("d", pa.int64()), ("crank", pa.int32())])


def check_nprobe(nprobe: int, k: int) -> int:
    """At least 1; more than there are clusters means all of them."""
    if nprobe < 1:
        raise ValueError("nprobe must be at least 1")
    return min(nprobe, k)


def probe(queries: DataFrame, index: IvfIndex, nprobe: int, with_vector: bool = False, above: int = 0) -> DataFrame:
    """(qid, crank, cid): the clusters to look into, crank 1 the nearest, those with
    a crank over ``above``; and ``with_vector`` v, the quantised query, and most, if
    the queries have it.  A query of another length than the index's vectors is an
    error."""
    last, centroids, scale, dim = check_nprobe(nprobe, index.k), index.centroids, index.scale, index.dim
    n, limited = last - above, with_vector and "most" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            if x.shape[1] != dim:
                raise ValueError(f"queries of {x.shape[1]} values; the index has {dim}")
            q = quantize_matrix(x, scale)
            qid, rank = np.repeat(b.column("qid").to_numpy(), n), np.tile(np.arange(above + 1, last + 1, dtype=np.int32), b.num_rows)
            columns = {"qid": pa.array(qid), "crank": pa.array(rank), "cid": pa.array(ranks(q, centroids, last)[:, above:].reshape(-1).astype(np.int32))}
            if with_vector:
                columns["v"] = vector_array(np.repeat(q, n, axis=0))
            if limited:
                columns["most"] = b.column("most").take(pa.array(np.repeat(np.arange(b.num_rows), n)))
            yield pa.RecordBatch.from_pydict(columns)

    return queries.select("qid", "v", *["most"] * limited).mapInArrow(run, "qid long, crank int, cid int" + ", v array<smallint>" * with_vector + ", most long" * limited)


def candidates(queries: DataFrame, index: IvfIndex, nprobe: int, k: int = TOP_K, skip_self: bool = False, block: int = BLOCK, rows: int = SLICE, above: int = 0) -> DataFrame:
    """(qid, ref_id, label, d, crank): the k best of each query in each slice of a
    probed list, so the k best for ``nprobe`` and for any smaller probe count are
    among them (``crank`` is the list's place among the query's probes).

    ``above``: lists with a crank over it alone.  ``queries`` may have a column
    ``most``: only neighbours at that distance or closer (null: at any)."""
    spark = queries.sparkSession
    if "most" not in queries.columns:
        queries = queries.withColumn("most", F.lit(None).cast("long"))
    probed = probe(queries, index, check_nprobe(nprobe, index.k), above=above)
    asked = {r.cid: r.n for r in probed.groupBy("cid").agg(F.count("*").alias("n")).collect()}  # one a cluster
    size = index.list_sizes()
    plan = [(c, max(1, -(-int(size[c]) // rows)), max(1, -(-n // block))) for c, n in sorted(asked.items()) if size[c]]
    layout = F.broadcast(spark.createDataFrame(plan, "cid int, slices int, blocks int"))  # one row a cluster
    lists = index.lists if len(plan) == index.k else index.lists.where(F.col("cid").isin([c for c, *_ in plan]))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lists = lists.join(layout, "cid").select("cid", F.pmod(F.xxhash64("ref_id"), "slices").cast("int").alias("s"), upto("blocks").alias("b"), "ref_id", F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"), "v")
    probes = probe(queries, index, check_nprobe(nprobe, index.k), True, above).join(layout, "cid")
    probes = probes.select("cid", upto("slices").alias("s"), F.pmod(F.xxhash64("qid"), "blocks").cast("int").alias("b"), "qid", "crank", "v", "most")

    def meet(some: pa.Table, who: pa.Table) -> pa.Table:
        if not some.num_rows or not who.num_rows:
            return _FOUND_ARROW.empty_table()
        ref, label, qid, rank = (t.column(c).to_numpy() for t, c in ((some, "ref_id"), (some, "label"), (who, "qid"), (who, "crank")))
        most = who.column("most").cast(pa.float64()).fill_null(np.inf).to_numpy()
        j, i, d = nearest_in_boxes(matrix(some.column("v")), ref, matrix(who.column("v")), qid, k, skip_self, most)
        return pa.table([qid[j], ref[i], label[i], d.astype(np.int64), rank[j]], schema=_FOUND_ARROW)

    by = ["cid", "s", "b"]
    return lists.groupBy(by).cogroup(probes.groupBy(by)).applyInArrow(meet, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy("d", "crank", "ref_id")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def ivf_search(queries: DataFrame, index: IvfIndex, nprobe: int = 1, k: int = TOP_K, **options) -> DataFrame:
    """(qid, ref_id, label, d, crank, rn) by (distance, cluster rank, id)."""
    return _top(candidates(queries, index, nprobe, k, **options), k)


def knn_score(queries: DataFrame, index: IvfIndex, nprobe: int = 1, k: int = TOP_K, **options) -> DataFrame:
    """A vote for each query, from its ``nprobe`` nearest lists."""
    return vote(ivf_search(queries, index, nprobe, k, **options), k, queries)


def adaptive_vote(queries: DataFrame, index: IvfIndex, fast: int = FAST_NPROBE, full: int = NPROBE, band: tuple[int, ...] = BAND, k: int = TOP_K, **options) -> DataFrame:
    """(qid, fast_count, full_count, n_fraud, approved): the full probe's count where
    the fast one's lies in ``band``, else the fast one's.  One scan serves both."""
    fast, full = check_nprobe(fast, index.k), check_nprobe(full, index.k)
    if fast >= full:
        band, fast = (), full
    found = candidates(queries, index, full, k, **options)
    w = Window.partitionBy("qid").orderBy("d", "crank", "ref_id")
    in_fast = F.col("crank") <= fast
    ranked = found.withColumn("full_rn", F.row_number().over(w)).withColumn("fast_rn", F.when(in_fast, F.sum(in_fast.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    counted = ranked.groupBy("qid").agg(
        F.coalesce(F.sum(F.when(F.col("fast_rn") <= k, F.col("label"))), F.lit(0)).cast("int").alias("fast_count"),
        F.coalesce(F.sum(F.when(F.col("full_rn") <= k, F.col("label"))), F.lit(0)).cast("int").alias("full_count"),
    )
    counted = answered(counted, queries, ["fast_count", "full_count"])
    counted = counted.withColumn("n_fraud", F.when(F.col("fast_count").isin(*band), F.col("full_count")).otherwise(F.col("fast_count")) if band else F.col("fast_count"))
    return counted.withColumn("approved", approved(F.col("n_fraud")))


def adaptive_decision(queries: DataFrame, index: IvfIndex, fast: int = FAST_NPROBE, full: int = NPROBE, band: tuple[int, ...] = BAND, k: int = TOP_K, work: str | None = None, many: int = BLOCK, **options) -> DataFrame:
    """(qid, fast_count, n_fraud, approved) as ``adaptive_vote`` has them, by two
    scans: only queries whose fast count lies in ``band`` look into the other lists,
    and there only for neighbours closer than their k-th so far.

    ``work`` names the path for the neighbours of the fast probe, k rows a query,
    which the result reads; without it they are in the work folder.  More than
    ``many`` queries go by cells, see there."""
    spark, fast, full = queries.sparkSession, check_nprobe(fast, index.k), check_nprobe(full, index.k)
    if fast >= full:
        band, fast = (), full
    # By cells a query without a vector in its fast lists has no row before the end.
    if not options.get("skip_self") and 0 not in band and not at_most(queries, many):
        options.pop("skip_self", None)
        return cells.decide(queries, index, fast, full, band, k, work or work_path(spark, "decisions"), **options)
    count = lambda df, name: df.groupBy("qid").agg(F.sum("label").cast("int").alias(name), F.count("*").alias("n"), F.max("d").alias("far"))
    near = _top(candidates(queries, index, fast, k, **options), k)
    if not band:
        counted = answered(count(near, "fast_count"), queries, ["fast_count"]).withColumn("n_fraud", F.col("fast_count"))
        return counted.withColumn("approved", approved(F.col("n_fraud")))
    path = work or work_path(spark, "fast-neighbours")
    near.drop("rn").write.mode("overwrite").parquet(path)
    near = spark.read.schema(_FOUND).parquet(path)
    votes = answered(count(near, "fast_count"), queries, ["fast_count"])
    # Of equal distances the lower crank is nearer, so others must be closer than the k-th.
    most = F.when(F.col("n") >= k, F.col("far") - 1).alias("most")
    unsure = count(near, "votes").select("qid", "votes", most)
    asked = queries.select("qid", "v").join(unsure, "qid", "left").where(F.coalesce("votes", F.lit(0)).isin(*band) & (F.col("most").isNull() | (F.col("most") >= 0)))
    more = candidates(asked.select("qid", "v", "most"), index, full, k, above=fast, **options)
    deep = count(_top(near.unionByName(more), k), "full_count").select("qid", "full_count")
    decided = F.when(F.col("fast_count").isin(*band), F.coalesce("full_count", F.lit(0))).otherwise(F.col("fast_count"))
    counted = votes.join(deep, "qid", "left").select("qid", "fast_count", decided.alias("n_fraud"))
    return counted.withColumn("approved", approved(F.col("n_fraud")))


def sweep(queries: DataFrame, index: IvfIndex, nprobes: list[int], k: int = TOP_K, **options) -> DataFrame:
    """(nprobe, qid, n_fraud): votes for each probe count, from one scan."""
    wanted = sorted({check_nprobe(n, index.k) for n in nprobes})
    every = F.explode(F.array(*(F.lit(n) for n in wanted))).alias("nprobe")
    found = candidates(queries, index, wanted[-1], k, **options)
    each = found.select("*", every).where(F.col("crank") <= F.col("nprobe"))
    w = Window.partitionBy("nprobe", "qid").orderBy("d", "crank", "ref_id")
    counted = each.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).groupBy("nprobe", "qid").agg(F.sum("label").cast("int").alias("n_fraud"))
    return answered(counted, queries.select("qid", every), ["n_fraud"], "nprobe").select("nprobe", "qid", "n_fraud")
