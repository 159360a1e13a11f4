"""Every payload is answered, and many queries have by cells the decisions of comparing all."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tamarack.operators import cells, ivf
from tamarack.operators.index import IvfIndex

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["qid", "fast_count", "n_fraud", "approved"]


@pytest.fixture(scope="module")
def mixed(spark):
    """6,000 vectors, each third one a copy, with labels that have no part in where they lie."""
    r = np.random.default_rng(4)
    made = r.integers(0, 9, (6000, 5)) / 8
    made[::3] = made[r.integers(0, 300, 2000)]
    return spark.createDataFrame([(i, [float(x) for x in v], int(r.integers(0, 2))) for i, v in enumerate(made)], "ref_id long, v array<float>, label int").cache()


@pytest.fixture(scope="module")
def stored(spark, mixed, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells") / "index")
    IvfIndex.build(mixed, 8, 3, copy=False).save(path)
    return IvfIndex.load(spark, path)


@pytest.mark.parametrize("name", ["score_payloads", "stream_decisions"])
def test_every_payload_is_answered(spark, name):
    got = [r.qid for r in entry.queries()[name](spark, SMALL).collect()]
    every = [r.event_id for r in spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").collect()]
    assert sorted(got) == sorted(every)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    assert sorted(r[0] for r in con.sql(entry.oracle_sql()[name]).project("qid").fetchall()) == sorted(every)


@pytest.mark.parametrize("fast,full,band,rows", [(1, 2, (2, 3), 64), (2, 6, (2, 3), 64), (2, 6, (2, 3), 100_000), (3, 8, (1, 2, 3, 4), 700), (9, 4, (2, 3), 700)])
def test_decisions_by_cells_are_those_of_one_scan(spark, mixed, stored, fast, full, band, rows):
    asked = mixed.select(F.col("ref_id").alias("qid"), "v")
    off = asked.where("qid % 4 = 0").select(F.col("qid") + 10_000, F.transform("v", lambda x: (x * 1.7 - F.lit(0.3)).cast("float")))
    asked = asked.union(off)
    one = sorted(r[:] for r in ivf.adaptive_vote(asked, stored, fast, full, band).select(COLUMNS).collect())
    got = sorted(r[:] for r in ivf.adaptive_decision(asked, stored, fast, full, band, many=100, block=300, rows=rows).select(COLUMNS).collect())
    assert got == one and len(got) == 7500
    assert any(r[1] != r[2] for r in got) == (fast < full)


def test_equal_queries_are_asked_once(spark, mixed, stored, monkeypatch):
    asked, real = [], cells.Cells.pairs
    monkeypatch.setattr(cells.Cells, "pairs", lambda self, q, *a: asked.append(q.count()) or real(self, q, *a))
    q = mixed.where("ref_id < 300").crossJoin(spark.range(10)).select((F.col("ref_id") + 300 * F.col("id")).alias("qid"), "v")
    got = ivf.adaptive_decision(q, stored, 2, 6, many=100).collect()
    assert len(got) == len({r.qid for r in got}) == 3000
    assert asked[0] == mixed.where("ref_id < 300").select("v").distinct().count() <= 300


def test_cells_far_away_are_left_out(spark, mixed, stored, monkeypatch, tmp_path):
    met, real = [], cells.Cells.met
    monkeypatch.setattr(cells.Cells, "met", lambda self, pairs, *a: met.append(pairs.count()) or real(self, pairs, *a))
    index = cells.Cells(spark, stored, 5, str(tmp_path / "index"), 64)
    n = int((index.cid >= 0).sum())
    q = mixed.select(F.col("ref_id").alias("qid"), "v").where("qid < 3000")
    ivf.adaptive_decision(q, stored, 8, 8, many=100, rows=64).count()
    queries = q.select("v").distinct().count()
    assert n > 40 and met[0] == queries and met[1] < queries * n / 2


def test_lists_without_vectors(spark):
    lists = spark.createDataFrame([(k, int(k < 3), [v, 0], c) for k, (v, c) in enumerate([(-100, 0), (-101, 0), (-99, 0), (100, 2), (101, 2)])], "ref_id long, label int, v array<smallint>, cid int")
    gap = IvfIndex(lists, np.array([[-100, 0], [0, 0], [100, 0]]), 1.0)
    q = spark.createDataFrame([(1, [-100.0, 0.0]), (2, [1.0, 0.0]), (3, [90.0, 0.0])], "qid long, v array<float>")
    want = [(1, 3, 3, False), (2, 0, 0, True), (3, 0, 0, True)]
    for index, rows in ((gap, want), (IvfIndex(gap.lists.limit(0), gap.centroids, 1.0), [(i, 0, 0, True) for i in (1, 2, 3)])):
        assert sorted(r[:] for r in ivf.adaptive_decision(q, index, 1, 2, many=1).select(COLUMNS).collect()) == rows


@pytest.mark.parametrize("bad", [None, [1.0, None], [1.0], [1.0, 2.0, 3.0]])
def test_bad_vectors_are_errors_by_cells(spark, stored, bad):
    q = spark.createDataFrame([(1, [1.0] * 5), (2, bad), (3, [2.0] * 5)], "qid long, v array<float>")
    with pytest.raises(Exception, match=r"null|vectors of|queries of"):
        ivf.adaptive_decision(q, stored, 1, 2, many=1).collect()
