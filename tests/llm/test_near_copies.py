"""Near copies at a five-word Jaccard similarity of 0.8 and more."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tamarack.llm import near_copies


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def jaccard(a, b):
    x, y = ({*near_copies.shingle_set(t).tolist()} for t in (a, b))
    return len(x & y) / len(x | y)


def copy_near(rng, text, low, high):
    """``text`` with words replaced until its similarity lies in [low, high)."""
    w = text.split()
    while (now := jaccard(text, " ".join(w))) >= high:
        w[rng.randrange(len(w))] = words(rng, 1)[0]
    assert now >= low
    return " ".join(w)


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 3])
def test_planted_near_copies_go(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rng, rows, wanted = random.Random(4), [], set()
    for k in range(30):
        base = " ".join(words(rng, 600))
        low = 0.8 + 0.005 * k
        rows += [(10 * k, base), (10 * k + 1, copy_near(rng, base, low, low + 0.03))]
        rows.append((10 * k + 2, copy_near(rng, base, 0.7, 0.75)))
        wanted |= {10 * k, 10 * k + 2}
    base = " ".join(words(rng, 600))
    rows += [(1000 + k, copy_near(rng, base, 0.8, 0.95)) for k in range(20)] + [(999, base), (2000, ""), (2001, None)]
    wanted |= {999, 2000}
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in got} == wanted


def test_similar_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 30))).astype(np.uint64) for _ in range(60)]
    for least in (0.3, 0.6, 0.8):
        joined = []
        for pairs in (near_copies.similar(sets, least), [(a, b) for a in range(60) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= least * len(np.union1d(sets[a], sets[b])) - 1e-9]):
            root = list(range(60))
            for a, b in pairs:
                root = [root[a] if r == root[b] else r for r in root]
            joined.append([[r == q for q in root] for r in root])
        assert joined[0] == joined[1]


def test_stage_keeps_what_comparing_all_pairs_keeps(spark):
    """The stage links by fingerprints and by shingles; documents of the test tables, each with an id."""
    import brute

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    assert got == brute.one_of_each_group(rows)
    assert len(got) < len({t for _, t in rows})
