"""Settings, warm-up, statistics, statuses, commands, and the work folder."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_features import payload
from test_oracles import ORACLES, SMALL, near

import __spark_entry__ as entry
from tamarack import __main__ as command
from tamarack import storage
from tamarack.functions.features import vectorize
from tamarack.operators.index import IvfIndex
from tamarack.sources.payloads import parse_payloads, read_references, split_rejects
from tamarack.streaming.scorer import Scorer, requests, respond, score_raw, stream_decisions
from tamarack.streaming.stats import ProgressStats, Stats


def bodies(n=40):
    return [(i, json.dumps(payload(transaction__amount=float(37 * i), customer__tx_count_24h=i % 20, merchant__mcc=["5411", "7995", "0"][i % 3]))) for i in range(n)]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(bodies(), "qid long, body string")


@pytest.fixture(scope="module")
def path(spark, raw, tmp_path_factory):
    at = tmp_path_factory.mktemp("service")
    good, _ = split_rejects(parse_payloads(raw))
    points = vectorize(good).select(F.col("qid").alias("ref_id"), "vector", F.when(F.col("qid") % 3 == 0, "fraud").otherwise("legit").alias("label"))
    points.write.json(str(at / "references"))
    out = command.main(["train", str(at / "references"), str(at / "index"), "--k", "5", "--rounds", "4", "--lines"], spark)
    assert out[0].startswith("40 vectors of 14 values in 5 lists")
    return str(at / "index")


def test_query_command(spark, raw, path, tmp_path, monkeypatch):
    file = tmp_path / "payloads.txt"
    file.write_text("\n".join([*(b for _, b in bodies(5)), "{broken"]) + "\n")
    monkeypatch.setenv("IVF_PATH", path)
    monkeypatch.setenv("NPROBE", "5")
    monkeypatch.setenv("FAST_NPROBE", "2")
    got = command.main(["query", str(file)], spark)
    index = IvfIndex.load(spark, path, 14)
    wanted = {r.qid: r.response for r in score_raw(raw.where("qid < 5"), index, 2, 5)[0].collect()}
    assert got == [wanted[k] for k in range(5)] + ["bad request"]
    scorer = Scorer.load(spark)
    assert (scorer.nprobe, scorer.fast_nprobe, scorer.ready) == (5, 2, False)
    with pytest.raises(ValueError, match="at least 1"):
        Scorer(index, 0)


def test_serve_command_and_warm_up(spark, raw, path, tmp_path, monkeypatch):
    monkeypatch.setenv("WARMUP", "1")
    raw.write.json(str(tmp_path / "in"))
    (tmp_path / "warm.txt").write_text("\n".join(b for _, b in bodies(3)))
    out = command.main(["serve", *(str(tmp_path / x) for x in ("in", "out", "bad", "cp")), "--index", path, "--nprobe", "4", "--fast", "2", "--once", "--warm-up", str(tmp_path / "warm.txt")], spark)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40 and "'score'" in out[0]
    scorer = Scorer(IvfIndex.load(spark, path), 4, 2).warm_up(raw, rounds=0)
    assert scorer.ready and scorer.index.lists.is_cached
    q = vectorize(split_rejects(parse_payloads(raw))[0], "v").select("qid", "v")
    assert scorer.score(q).count() == scorer.fraud_count(q).count() == 40
    scorer.index.unpersist()


def test_statistics_of_a_stream(spark, raw, path, tmp_path):
    scorer, seen = Scorer(IvfIndex.load(spark, path), 4, 2), Stats()
    listener = ProgressStats(seen)
    spark.streams.addListener(listener)
    try:
        raw.union(spark.createDataFrame([(99, "no json")], raw.schema)).write.json(str(tmp_path / "in"))
        stream = requests(spark, str(tmp_path / "in"))
        stream_decisions(spark, stream, scorer, *(str(tmp_path / x) for x in ("out", "bad", "cp")), once=True).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    made = scorer.stats.snapshot()
    assert {*made} == {"score", "reject"} and sum(s["share"] for s in made.values()) == pytest.approx(100)
    assert all(s["calls"] == scorer.stats.counts["calls"] == 1 and 0 < s["max_ms"] == s["total_ms"] == s["average_ms"] for s in made.values())
    assert scorer.stats.frame(spark).count() == 2
    assert seen.counts.get("input_rows") == 41 and "addBatch" in seen.snapshot()
    scorer.stats.reset()
    assert scorer.stats.snapshot() == {} == scorer.stats.counts


def test_statuses(spark, path):
    body = bodies(1)[0][1]
    asked = [(1, "POST", "/fraud-score", body), (2, "POST", "/fraud-score", "{"), (3, "GET", "/ready", None), (4, "GET", "/fraud-score", body), (5, "POST", "/x", body), (6, "POST", "/fraud-score", None), (7, None, None, None)]
    got = respond(spark.createDataFrame(asked, "qid long, method string, path string, body string"), IvfIndex.load(spark, path), 2, 5).collect()
    assert {r.qid: r.status for r in got} == {1: 200, 2: 400, 3: 200, 4: 404, 5: 404, 6: 400, 7: 404}
    assert {r.qid: r.response for r in got if r.status != 200} == {2: "bad request", 6: "bad request", 4: "not found", 5: "not found", 7: "not found"}
    assert json.loads(next(r.response for r in got if r.qid == 1)).keys() == {"approved", "fraud_score"}


def test_references_have_a_stated_order(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"ref_id": 10 * k + i, "vector": [0.5] * 14, "label": "fraud"}) for i in range(3)))
    assert sorted(r.ref_id for r in read_references(spark, str(tmp_path), lines=True).collect()) == [0, 1, 2, 10, 11, 12]
    with pytest.raises(ValueError, match="no order"):
        read_references(spark, str(tmp_path))
    (tmp_path / "2.json").write_text(json.dumps({"vector": [0.5] * 14, "label": "fraud"}))
    with pytest.raises(Exception, match="without ref_id"):
        read_references(spark, str(tmp_path), lines=True).collect()


@pytest.mark.parametrize("name", ["feature_calendar", "feature_last_tx", "payload_json_roundtrip"])
@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_features_do_not_depend_on_the_sessions_time_zone(spark, name, zone):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = entry.queries()[name](spark, SMALL)
        columns = sorted(df.columns)
        a = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
        dst = [payload(transaction__requested_at=f"2026-03-08T{h:02}:30:00Z", last_transaction={"timestamp": "2026-03-08T00:30:00Z", "km_from_current": 1.0}) for h in range(24)]
        made = vectorize(split_rejects(parse_payloads(spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(dst)], "k long, body string")))[0]).orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    b = sorted(con.sql(ORACLES[name]).project(",".join(f'"{c}"' for c in columns)).fetchall(), key=repr)
    assert len(a) == len(b) and all(near(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))
    assert [round(r.vector[3] * 23) for r in made] == [*range(24)]
    assert [r.vector[5] for r in made] == pytest.approx([h / 24 for h in range(24)], abs=1e-6)


def test_work_folder(spark, monkeypatch):
    class Elsewhere:
        conf = {}  # noqa: RUF012

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    assert os.path.isdir(storage.shared_dir(spark))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere())
    kept = storage.work_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with storage.scratch(spark):
        gone = storage.work_path(spark, "gone")
        assert storage.written(spark.range(5), "inside").count() == 5
        spark.range(3).write.parquet(gone)
    assert storage.path_exists(spark, kept) and not storage.path_exists(spark, gone)
    storage.delete(spark, kept)


def test_recall_of_the_stored_search(spark):
    """0.9 or more at each size, as the registered query has it."""
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        got = entry.queries()["ivf_stored_recall"](spark, f"/root/testdata/{sf}").agg(F.avg("recall")).first()[0]
        print("recall", sf, got)
        assert got >= 0.9
