"""Decisions by two scans, and neighbours by boxes, against comparing all."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarack import storage
from tamarack.operators import ivf, kernels
from tamarack.operators.index import IvfIndex
from tamarack.streaming import scorer


@pytest.fixture(scope="module")
def mixed(spark):
    """6,000 vectors, each third one a copy, with labels that have no part in where they lie."""
    r = np.random.default_rng(3)
    made = r.integers(0, 9, (6000, 5)) / 8
    made[::3] = made[r.integers(0, 300, 2000)]
    return spark.createDataFrame([(i, [float(x) for x in v], int(r.integers(0, 2))) for i, v in enumerate(made)], "ref_id long, v array<float>, label int").cache()


@pytest.fixture(scope="module")
def stored(spark, mixed, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("decisions") / "index")
    IvfIndex.build(mixed, 8, 3, copy=False).save(path)
    return IvfIndex.load(spark, path)


@pytest.mark.parametrize("top", [2, 6, 50, 16383])
def test_boxes_find_what_comparing_all_finds(top):
    r = np.random.default_rng(top)
    for n, m, dim, k in [(1, 70, 3, 5), (600, 64, 1, 1), (2000, 300, 4, 5), (3000, 200, 14, 6)]:
        refs, ids = r.integers(-top, top + 1, (n, dim)).astype(float), r.permutation(n).astype(np.int64)
        asked = np.concatenate([refs[r.integers(0, n, m // 2)], r.integers(-top, top + 1, (m - m // 2, dim))])
        qids, most = r.choice(n + m, m, replace=False), r.integers(0, dim * top * top, m).astype(float)
        for skip in (False, True):
            j, i, d = kernels.nearest(refs, ids, asked, qids, k, True, skip)
            got = kernels.nearest_in_boxes(refs, ids, asked, qids, k, skip)
            assert all(np.array_equal(a, b) for a, b in zip(got, (j, i, d), strict=True))
            got, near = kernels.nearest_in_boxes(refs, ids, asked, qids, k, skip, most), d <= most[j]
            assert all(np.array_equal(a, b) for a, b in zip(got, (j[near], i[near], d[near]), strict=True))


def test_boxes_leave_out_most_distances(monkeypatch):
    r, cells, real = np.random.default_rng(5), [], kernels.distances
    monkeypatch.setattr(kernels, "distances", lambda a, b, exact: cells.append(len(a) * len(b)) or real(a, b, exact))
    refs = np.repeat(r.integers(0, 16383, (20_000, 3)).astype(float), 3, axis=0)
    kernels.nearest_in_boxes(refs, np.arange(60_000), refs[::60], np.arange(0, 60_000, 60), 5, False)
    assert sum(cells) < 60_000 * 1000 / 20


def test_boxes_hold_on_equal_vectors():
    j, i, d = kernels.nearest_in_boxes(np.ones((5000, 4)), np.arange(5000)[::-1], np.ones((100, 4)), np.arange(100), 5, True)
    first = [[x for x in range(6) if x != q][:5] for q in range(100)]
    assert (4999 - i).reshape(100, 5).tolist() == first and not d.any()


@pytest.mark.parametrize("fast,full", [(1, 2), (2, 6), (3, 8), (8, 8), (9, 4)])
def test_decisions_are_those_of_one_scan(mixed, stored, fast, full):
    q = mixed.where("ref_id % 10 = 0").select(F.col("ref_id").alias("qid"), "v")
    columns = ["qid", "fast_count", "n_fraud", "approved"]
    one = sorted(r[:] for r in ivf.adaptive_vote(q, stored, fast, full).select(columns).collect())
    two = sorted(r[:] for r in ivf.adaptive_decision(q, stored, fast, full, block=50, rows=700).select(columns).collect())
    assert one == two and len(two) == 600
    assert any(r[1] != r[2] for r in two) == (fast < full)


def test_only_unsure_queries_look_further(spark, mixed, stored, monkeypatch):
    asked, real = [], ivf.candidates
    monkeypatch.setattr(ivf, "candidates", lambda q, *a, **b: asked.append(q.count()) or real(q, *a, **b))
    q = mixed.where("ref_id % 10 = 0").select(F.col("ref_id").alias("qid"), "v")
    monkeypatch.setattr(scorer, "vectorize", lambda df, _: df)
    got = scorer.score_payloads(q, stored, 2, 6).count()
    unsure = ivf.adaptive_vote(q, stored, 2, 6).where("fast_count in (2, 3)").count()
    assert got == 600 and asked[0] == 600 and 0 < asked[1] <= unsure < 500


def test_no_query_has_a_neighbour(spark, stored):
    none = spark.createDataFrame([], "qid long, v array<float>")
    assert ivf.adaptive_decision(none, stored, 2, 6).count() == 0
    empty = IvfIndex(stored.lists.where("cid < 0"), stored.centroids, stored.scale, np.zeros(stored.k, dtype=np.int64))
    q = spark.createDataFrame([(7, [0.5] * 5)], "qid long, v array<float>")
    assert [r[:] for r in ivf.adaptive_decision(q, empty, 2, 6).collect()] == [(7, 0, 0, True)]


def test_a_batch_of_a_stream_looks_further_for_unsure_queries_and_leaves_no_table(spark, stored, mixed, monkeypatch):
    asked, real = [], ivf.candidates
    monkeypatch.setattr(ivf, "candidates", lambda q, *a, **b: asked.append(q.count()) or real(q, *a, **b))
    monkeypatch.setattr(scorer, "vectorize", lambda df, _: df)
    monkeypatch.setattr(scorer, "parse_payloads", lambda df: df)
    monkeypatch.setattr(scorer, "split_rejects", lambda df: (df, df.limit(0)))
    before = storage._inside(spark)
    q, got = mixed.where("ref_id < 50").select(F.col("ref_id").alias("qid"), "v"), []
    scorer.Scorer(stored, 6, 2).answer(q, lambda df: got.append(df.count()), lambda df: None)
    assert got == [50] and storage._inside(spark) == before
    assert len(asked) == 2 and asked[0] == 50 and 0 < asked[1] < 50
