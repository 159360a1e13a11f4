import json

from pyspark.sql import functions as F
from test_features import payload

from tamarack.functions.features import vectorize
from tamarack.operators.index import IvfIndex
from tamarack.sources.payloads import parse_payloads, split_rejects
from tamarack.streaming.scorer import score_raw, stream_decisions


def test_stream_equals_batch(spark, tmp_path):
    made = [(i, json.dumps(payload(transaction__amount=float(37 * i), customer__tx_count_24h=i % 20, merchant__mcc=["5411", "7995", "0"][i % 3]))) for i in range(60)]
    raw = spark.createDataFrame([*made, (90, "{broken")], "qid long, body string")
    good, _ = split_rejects(parse_payloads(raw))
    points = vectorize(good, "v").select(F.col("qid").alias("ref_id"), "v", (F.col("qid") % 3).cast("int").alias("m"))
    points = points.select("ref_id", "v", (F.col("m") == 0).cast("int").alias("label"))
    index = IvfIndex.build(points, 6, 4)
    batch, rejected = score_raw(raw, index, 2, 4)
    wanted = sorted(r[:] for r in batch.collect())
    assert len(wanted) == 60 and [r.body for r in rejected.collect()] == ["{broken"]

    source, paths = tmp_path / "in", [str(tmp_path / x) for x in ("out", "rejects", "cp")]
    raw.where("qid % 2 = 0").write.json(str(source))
    for rest in (None, raw.where("qid % 2 = 1")):
        if rest is not None:
            rest.write.mode("append").json(str(source))
        q = stream_decisions(spark, str(source), index, *paths, fast=2, full=4, once=True)
        q.awaitTermination(120)
        assert q.exception() is None
    got = spark.read.parquet(paths[0])
    assert sorted(r[:] for r in got.select("qid", "n_fraud", "approved", "response").collect()) == wanted
    assert [r.body for r in spark.read.parquet(paths[1]).collect()] == ["{broken"]
    assert all(json.loads(r[3]) == {"approved": r[2], "fraud_score": r[1] / 5} for r in wanted)
