"""The pipeline's stages, each over what the last one kept, against plain Python."""

import zlib

import brute
import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from test_contracts import folder, rows  # noqa: F401
from tokenizers import Tokenizer

from tamarack.llm.queries import TOKENIZER

NAMES = ["quality_rules", "simhash_near_dedup", "decontamination", "secret_scan", "packing"]


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):  # noqa: F811
    at, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        made = f(spark, docs, folder)
        made.write.parquet(str(at / str(k)))
        out.append((docs, docs := spark.read.parquet(str(at / str(k)))))
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    for before, after in stages[:-1]:
        assert before.columns == after.columns


def test_quality(spark, stages):
    before, after = stages[0]
    kept = pairs(after)
    assert not any(brute.quality_base(t)[5] for _, t in kept)
    good = [x for x in pairs(before) if not brute.quality_base(x[1])[5]]
    label = pd.read_parquet("/root/testdata/sf0.001/labels.parquet").set_index("doc_id")["quality"]
    clean = [x for x in good if label.get(x[0]) == 1]
    assert len([x for x in clean if x in kept]) >= 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    had = pairs(before)
    of = brute.near_duplicates(had)
    assert pairs(after) == sorted((x for x in had if x[0] == of[x][1]), key=str)
    assert len(pairs(after)) < len(had)


def test_contaminated_go(stages, folder):  # noqa: F811
    before, after = stages[2]
    b = pd.read_parquet(f"{folder}/benchmark.parquet")
    items = [(i, t) for i, t in zip(b["item_id"], b["text"], strict=True)]
    assert pairs(after) == [x for x in pairs(before) if not brute.decontamination(x[1], items)[4]]


def test_secrets_are_masked(stages):
    before, after = stages[3]
    old = dict(pairs(before))
    assert sorted(old, key=str) == [i for i, _ in pairs(after)]
    for r in after.collect():
        counts, found = brute.spans(old[r.doc_id], brute.SECRETS, True)
        if found:
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
            assert brute.spans(r.text, brute.SECRETS, True)[0] == (0, 0, 0)
        else:
            assert "[SECRET]" not in (r.text or "") or r.text == old[r.doc_id]


def test_packing(stages):
    before, after = stages[4]
    t, got = Tokenizer.from_file(TOKENIZER), {}
    for r in after.orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in pairs(before):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for r in got[i] for x in r.ids] == ids
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got[i])


def test_run_is_the_stages(spark, folder, stages):  # noqa: F811
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    a = sorted(r[:] for r in corpus_pipeline.run(spark, folder).select(*columns).collect())
    assert [x[:5] for x in a] == [x[:5] for x in sorted(r[:] for r in stages[-1][1].select(*columns).collect())]


def test_empty(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
