"""Every query is answered, bad vectors are refused, and nothing grows on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack.operators import evaluate, ivf, kmeans
from tamarack.operators.index import IvfIndex
from tamarack.operators.search import exact_knn, vote
from tamarack.plans.adapters import query_set, references

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def refs(spark):
    return references(spark, SMALL).cache()


@pytest.fixture(scope="module")
def stored(spark, refs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    IvfIndex.build(refs, 8, 3).save(path)
    return IvfIndex.load(spark, path)


def vectors(spark, rows, name="qid"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, v array<float>")


@pytest.fixture(scope="module")
def gap(spark):
    """Three clusters of which the middle one has no vector."""
    lists = spark.createDataFrame([(k, int(k < 3), [v, 0], c) for k, (v, c) in enumerate([(-100, 0), (-101, 0), (-99, 0), (100, 2), (101, 2)])], "ref_id long, label int, v array<smallint>, cid int")
    return IvfIndex(lists, np.array([[-100, 0], [0, 0], [100, 0]]), 1.0)


def test_queries_whose_lists_are_empty_are_answered(spark, gap):
    q = vectors(spark, [(1, [-100, 0]), (2, [1, 0])])
    assert {r.qid: (r.n_fraud, r.n_neighbours, r.approved) for r in ivf.knn_score(q, gap, 1).collect()} == {1: (3, 3, False), 2: (0, 0, True)}
    assert {r.qid: (r.fast_count, r.full_count, r.n_fraud) for r in ivf.adaptive_vote(q, gap, 1, 2).collect()} == {1: (3, 3, 3), 2: (0, 0, 0)}
    assert {(r.nprobe, r.qid): r.n_fraud for r in ivf.sweep(q, gap, [1, 3]).collect()} == {(1, 1): 3, (1, 2): 0, (3, 1): 3, (3, 2): 3}
    none = IvfIndex(gap.lists.limit(0), gap.centroids, 1.0)
    assert {r.qid: r.n_neighbours for r in ivf.knn_score(q, none, 3).collect()} == {1: 0, 2: 0}
    assert ivf.knn_score(q.limit(0), gap, 1).collect() == []
    refs = spark.createDataFrame([(1, [0.0, 0.0], 1)], "ref_id long, v array<float>, label int")
    assert {r.qid: r.n_fraud for r in vote(exact_knn(q, refs, integer=False), queries=q).collect()} == {1: 0, 2: 1}


@pytest.mark.parametrize("bad", [None, [1.0, None], [1.0], [1.0, 2.0, 3.0]])
def test_bad_vectors_are_errors(spark, gap, bad):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, bad, 1)], "ref_id long, v array<float>, label int")
    good = vectors(spark, [(1, [1, 2])])
    runs = [
        lambda: exact_knn(good, rows, integer=False).collect(),
        lambda: exact_knn(rows.select(F.col("ref_id").alias("qid"), "v"), rows.limit(1), integer=False).collect(),
        lambda: ivf.knn_score(rows.select(F.col("ref_id").alias("qid"), "v"), gap, 2).collect(),
        lambda: kmeans.assign(rows.coalesce(1), np.zeros((1, 2))).collect(),
    ]
    for run in runs:
        with pytest.raises(Exception, match="vector|values|null"):
            run()


def test_queries_of_another_length_are_errors(spark, gap):
    with pytest.raises(Exception, match="queries of 3 values; the index has 2"):
        ivf.knn_score(vectors(spark, [(1, [1, 2, 3])]), gap, 1).collect()


def rows_of(df):
    return sorted(r[:] for r in df.select("qid", "ref_id", "d", "rn").collect())


def test_blocks_and_slices_change_nothing(refs, stored):
    q = query_set(refs)
    exact = rows_of(exact_knn(q, refs, integer=False))
    assert exact == rows_of(exact_knn(q, refs, integer=False, block=1, rows=60))
    assert rows_of(exact_knn(q, refs, integer=False, skip_self=False)) == rows_of(exact_knn(q, refs, integer=False, skip_self=False, block=1, rows=7))
    for nprobe in (1, 3, 8):
        assert rows_of(ivf.ivf_search(q, stored, nprobe)) == rows_of(ivf.ivf_search(q, stored, nprobe, block=1, rows=11))


def test_one_scan_whatever_the_query_set(spark, refs, stored):
    for q in (query_set(refs), refs.select(F.col("ref_id").alias("qid"), "v")):
        plan = ivf.ivf_search(q, stored, 3, block=100, rows=50)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("/lists") == 1 or plan.count("FileScan parquet [ref_id") == 1
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # else filters are cut
    few = ivf.ivf_search(query_set(refs).limit(1), stored, 2)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = few[few.index("PartitionFilters: [") :].split("]")[0]
    assert "cid" in filters and " IN (" in filters


def test_all_vectors_as_queries(refs, stored):
    q = refs.select(F.col("ref_id").alias("qid"), "v")
    got = ivf.knn_score(q, stored, 2, block=40, rows=40)
    assert got.count() == refs.count() and got.where("n_neighbours > 0").count() == refs.count()


def test_sizes_of_lists_come_with_the_index(spark, refs, stored):
    counted = {r.cid: r["count"] for r in stored.lists.groupBy("cid").count().collect()}
    assert stored.list_sizes().tolist() == [counted.get(c, 0) for c in range(8)]
    built = IvfIndex.build(refs, 8, 3)
    assert built.counts.tolist() == stored.counts.tolist() == IvfIndex(built.lists, built.centroids, built.scale).list_sizes().tolist()


def test_long_lists_are_saved_in_several_files(spark, refs, tmp_path, monkeypatch):
    from tamarack.operators import index as module

    monkeypatch.setattr(module, "FILE_ROWS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else all is small enough for one task
    IvfIndex.build(refs, 4, 2).save(str(tmp_path / "i"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    again = IvfIndex.load(spark, str(tmp_path / "i"))
    assert again.lists.count() == refs.count() == again.list_sizes().sum()
    assert max(len([*p.glob("*.parquet")]) for p in (tmp_path / "i/lists").iterdir() if p.is_dir()) > 1


def test_training_on_a_copy_is_the_same(spark, refs):
    a, b = kmeans.train(refs, 5, 3), kmeans.train(refs.repartition(3), 5, 3, copy=False)
    assert a.centroids.tolist() == b.centroids.tolist() and a.sizes.tolist() == b.sizes.tolist()


def test_percentiles_by_sketch_are_within_their_ranks(spark):
    rows = spark.range(20_000).select((F.pmod(F.xxhash64("id"), F.lit(20_000))).cast("double").alias("ms"))
    exact, near = evaluate.latency_score(rows, "ms").first(), evaluate.latency_score(rows, "ms", 1000).first()
    ranks = sorted(r.ms for r in rows.collect())
    for name, at in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        low, high = (np.searchsorted(ranks, near[name], side) for side in ("left", "right"))  # equal values share ranks
        assert low - 21 <= at * 20_000 <= high + 21
    assert near.max_ms == exact.max_ms
