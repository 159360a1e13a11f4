"""The engine's registered queries; ``oracles`` has their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import vectors as vx
from ..operators import evaluate, ivf, kmeans, search
from ..operators.index import IvfIndex
from ..sources.payloads import parse_payloads, read_lookup, read_references, split_rejects
from ..storage import work_path, written
from ..streaming import scorer
from .adapters import payloads, quantized, query_set, references, table
from .oracles import DEEP, FAST, FULL, K, NPROBES, ORACLES, ROUNDS

__all__ = ["ORACLES", "QUERIES"]


def _features(spark: SparkSession, sf_dir: str, dims: list[int]) -> DataFrame:
    made = ft.feature_columns()
    return payloads(spark, sf_dir).select("event_id", *(made[d].cast("double").alias(f"f{d}") for d in dims))


def feature_scalars(spark, sf_dir):
    return _features(spark, sf_dir, [0, 1, 2, 7, 8, 13])


def feature_calendar(spark, sf_dir):
    return _features(spark, sf_dir, [3, 4])


def feature_last_tx(spark, sf_dir):
    return _features(spark, sf_dir, [5, 6])


def feature_flags(spark, sf_dir):
    return _features(spark, sf_dir, [9, 10, 11])


def feature_mcc_risk(spark, sf_dir):
    return _features(spark, sf_dir, [12])


def feature_vector(spark, sf_dir):
    # Cast inside the array: the vector is then one expression, computed once a row.
    wide = F.transform("vector", lambda x: x.cast("double"))
    return ft.vectorize(payloads(spark, sf_dir)).select("event_id", F.posexplode(wide).alias("dim", "value"))


def payload_json_roundtrip(spark, sf_dir):
    """Payloads written as JSON, parsed again and vectorised; malformed texts are rejected."""
    p = payloads(spark, sf_dir)
    raw = p.select("event_id", F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction")).alias("body"))
    good, _ = split_rejects(parse_payloads(raw))
    made = ft.vectorize(good)
    return made.select("event_id", *(F.col("vector")[d].cast("double").alias(f"f{d}") for d in (0, 2, 3, 4, 5, 6, 8)))


def quantize_scale(spark, sf_dir):
    largest = vx.abs_max(references(spark, sf_dir), "v")
    return spark.range(1).select(F.lit(largest).alias("largest"), F.lit(vx.fit_scale(largest)).alias("scale"))


def quantize_vectors(spark, sf_dir):
    made, _ = quantized(references(spark, sf_dir))
    return made.select(F.col("ref_id").alias("vec_id"), F.posexplode("v").alias("dim", "x")).select("vec_id", "dim", F.col("x").cast("int").alias("q"))


def _pairs(refs: DataFrame) -> DataFrame:
    """All pairs are the result.  A small query set, which is counted, is broadcast."""
    q = query_set(refs).select("qid", F.col("v").alias("qv"))
    return refs.crossJoin(F.broadcast(q) if search.at_most(q, search.BLOCK) else q)


def l2_float_pairs(spark, sf_dir):
    pairs = _pairs(references(spark, sf_dir))
    return pairs.select("qid", F.col("ref_id").alias("vec_id"), F.round(vx.l2_float(F.col("qv"), F.col("v")), 6).alias("d"))


def l2_int_pairs(spark, sf_dir):
    pairs = _pairs(quantized(references(spark, sf_dir))[0])
    return pairs.select("qid", F.col("ref_id").alias("vec_id"), vx.l2_int(F.col("qv"), F.col("v")).alias("d"))


def _exact(spark, sf_dir, integer: bool) -> DataFrame:
    refs = references(spark, sf_dir)
    refs = quantized(refs)[0] if integer else refs
    return search.exact_knn(query_set(refs), refs, integer=integer)


def knn_exact_int(spark, sf_dir):
    return _exact(spark, sf_dir, True).select("qid", F.col("ref_id").alias("vec_id"), "d", "rn")


def knn_exact_float(spark, sf_dir):
    return _exact(spark, sf_dir, False).select("qid", F.col("ref_id").alias("vec_id"), "rn")


def knn_vote(spark, sf_dir):
    return search.vote(_exact(spark, sf_dir, True), queries=query_set(references(spark, sf_dir))).select("qid", "n_fraud", "n_neighbours", "approved")


def _named(refs: DataFrame) -> DataFrame:
    return refs.withColumnRenamed("ref_id", "vec_id")


def kmeans_init(spark, sf_dir):
    c = kmeans.initial(references(spark, sf_dir), K)
    rows = [(i, d, float(x)) for i, v in enumerate(c) for d, x in enumerate(v)]
    return spark.createDataFrame(rows, "cid int, dim int, x double")


def kmeans_assign(spark, sf_dir):
    refs = references(spark, sf_dir)
    return _named(kmeans.assign(refs.select("ref_id", "v"), kmeans.initial(refs, K)).select("ref_id", "cid"))


def kmeans_update(spark, sf_dir):
    refs = references(spark, sf_dir)
    c = kmeans.update(refs, kmeans.initial(refs, K))
    rows = [(i, d, float(x)) for i, v in enumerate(c) for d, x in enumerate(v)]
    return spark.createDataFrame(rows, "cid int, dim int, x double")


def kmeans_movement(spark, sf_dir):
    model = kmeans.train(references(spark, sf_dir), K, ROUNDS, copy=False)
    return spark.createDataFrame([(t + 1, round(m, 6)) for t, m in enumerate(model.movements)], "round int, movement double")


def kmeans_t3(spark, sf_dir):
    refs = references(spark, sf_dir)
    model = kmeans.train(refs, K, ROUNDS, copy=False)
    return _named(kmeans.assign(refs.select("ref_id", "v"), model.assigned_by).select("ref_id", "cid"))


def _index(spark, sf_dir) -> tuple[DataFrame, IvfIndex]:
    refs = references(spark, sf_dir)
    return refs, IvfIndex.build(refs, K, ROUNDS, copy=False)  # refs is a table


def ivf_list_sizes(spark, sf_dir):
    return _index(spark, sf_dir)[1].sizes()


def ivf_probe(spark, sf_dir):
    refs, index = _index(spark, sf_dir)
    return ivf.probe(query_set(refs), index, FULL)


def ivf_search(spark, sf_dir):
    refs, index = _index(spark, sf_dir)
    return ivf.ivf_search(query_set(refs), index, FULL).select("qid", F.col("ref_id").alias("vec_id"), "d", "rn")


def ivf_adaptive(spark, sf_dir):
    refs, index = _index(spark, sf_dir)
    return ivf.adaptive_vote(query_set(refs), index, FAST, FULL)


def nprobe_sweep(spark, sf_dir):
    """Wrong decisions and recall of the exact answer, for each probe count."""
    refs, index = _index(spark, sf_dir)
    q = query_set(refs)
    counts = ivf.sweep(q, index, NPROBES, skip_self=True).join(q.select("qid", "actual"), "qid")
    wrong = (F.col("actual") == 1) != (F.col("n_fraud") >= 3)
    return counts.groupBy("nprobe").agg(F.count("*").alias("n"), F.sum("n_fraud").alias("votes"), F.sum(wrong.cast("int")).alias("wrong"))


def ivf_recall(spark, sf_dir):
    refs, index = _index(spark, sf_dir)
    q = query_set(refs)
    return evaluate.recall(ivf.ivf_search(q, index, FULL, skip_self=True), search.exact_knn(q, refs, integer=False), vx.TOP_K)


def confusion_score(spark, sf_dir):
    refs = quantized(references(spark, sf_dir))[0]
    q = query_set(refs)
    rows = search.vote(search.exact_knn(q, refs)).join(q.select("qid", "actual"), "qid")
    rows = rows.withColumn("predicted", (~F.col("approved")).cast("int"))
    made = evaluate.detection_score(evaluate.confusion(rows))
    return made.select("n", "tp", "fp", "fn", "tn", "errors", "weighted_errors", F.round("detection_score", 6).alias("detection_score"))


def latency_score(spark, sf_dir):
    made = evaluate.latency_score(table(spark, sf_dir, "events"), "value")
    return made.select(*(F.round(c, 6).alias(c) for c in made.columns))


def latency_histogram(spark, sf_dir):
    return evaluate.latency_histogram(table(spark, sf_dir, "events"), "value", [1.0, 5.0, 10.0, 50.0, 100.0])


def stage_stats(spark, sf_dir):
    made = evaluate.stage_stats(table(spark, sf_dir, "events"), "event_type", "value")
    return made.withColumn("average", F.round("average", 6)).withColumn("share", F.round("share", 6))


def decision_json(spark, sf_dir):
    votes = search.vote(_exact(spark, sf_dir, True))
    return votes.select("qid", vx.decision_json(F.col("n_fraud")).alias("response"))


def _stored(spark, sf_dir) -> tuple[DataFrame, IvfIndex]:
    """The index as it is read back from where it was saved."""
    refs, index = _index(spark, sf_dir)
    path = work_path(spark, "index")
    index.save(path)
    return refs, IvfIndex.load(spark, path)


def ivf_stored_search(spark, sf_dir):
    refs, index = _stored(spark, sf_dir)
    return ivf.ivf_search(query_set(refs), index, DEEP, skip_self=True).select("qid", F.col("ref_id").alias("vec_id"), "d", "rn")


def ivf_stored_recall(spark, sf_dir):
    refs, index = _stored(spark, sf_dir)
    q = query_set(refs)
    return evaluate.recall(ivf.ivf_search(q, index, DEEP, skip_self=True), search.exact_knn(q, refs, integer=False), vx.TOP_K)


def knn_score(spark, sf_dir):
    refs, index = _stored(spark, sf_dir)
    return ivf.knn_score(query_set(refs), index, DEEP).select("qid", "n_fraud", "fraud_score", "approved")


def _bodies(spark, sf_dir) -> tuple[DataFrame, IvfIndex]:
    """Payloads as JSON (event_id, event_type, body), and a stored index over all of their vectors."""
    p = payloads(spark, sf_dir)
    raw = p.select("event_id", F.col("merchant.id").alias("event_type"), F.to_json(F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction")).alias("body"))
    raw = written(raw, "bodies")
    points = ft.vectorize(split_rejects(parse_payloads(raw))[0], "v").select(F.col("event_id").alias("ref_id"), "v", F.coalesce((F.col("event_type") == "error").cast("int"), F.lit(0)).alias("label"))
    points = written(points, "points")  # training, scale and lists read them five times
    path = work_path(spark, "index")
    IvfIndex.build(points, K, ROUNDS, copy=False).save(path)
    return raw, IvfIndex.load(spark, path, ft.DIM)


def _asked(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("event_id").alias("qid"), "body")


def score_payloads(spark, sf_dir):
    """All payload texts to answers, over a stored index of payload vectors."""
    raw, index = _bodies(spark, sf_dir)
    return scorer.score_raw(_asked(raw), index, FAST, DEEP)[0].select("qid", "response")


def stream_decisions(spark, sf_dir):
    """The same by a stream over JSON files, stopped when all are scored."""
    raw, index = _bodies(spark, sf_dir)
    source, sink, rejects, checkpoint = (work_path(spark, name) for name in ("requests", "decisions", "rejects", "stream"))
    _asked(raw).write.json(source)
    scorer.stream_decisions(spark, source, index, sink, rejects, checkpoint, FAST, DEEP, once=True).awaitTermination()
    return spark.read.schema("qid long, n_fraud int, approved boolean, response string").parquet(sink).select("qid", "response")


def respond(spark, sf_dir):
    """Statuses: a third asks whether the service is ready, a third has no route, a third no payload."""
    e, kind = table(spark, sf_dir, "events").select(F.col("event_id").alias("qid")), F.col("qid") % 3
    asked = e.select("qid", F.when(kind == 0, "GET").otherwise("POST").alias("method"), F.when(kind == 0, "/ready").when(kind == 2, "/fraud-score").otherwise("/other").alias("path"), F.lit("{broken").alias("body"))
    refs, index = _index(spark, sf_dir)
    return scorer.respond(asked, index, FAST, DEEP)


def references_json(spark, sf_dir):
    """References written as JSON lines and read again."""
    refs, path = references(spark, sf_dir), work_path(spark, "references")
    refs.select("ref_id", F.col("v").alias("vector"), F.when(F.col("label") == 1, "fraud").otherwise("legit").alias("label")).write.json(path)
    read = read_references(spark, path, dim=64, lines=True)
    return read.select("ref_id", "label", F.posexplode("vector").alias("dim", "y")).select("ref_id", "label", "dim", F.col("y").cast("double").alias("x"))


def lookup_risk(spark, sf_dir):
    """Risks of categories as a lookup file has them."""
    path = work_path(spark, "risks")
    spark.createDataFrame([(json.dumps(ft.RISK),)], "value string").coalesce(1).write.text(path)
    made = ft.vectorize(payloads(spark, sf_dir), risk=read_lookup(spark, path))
    return made.select("event_id", F.col("vector")[12].cast("double").alias("f12"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_scalars, feature_calendar, feature_last_tx, feature_flags, feature_mcc_risk, feature_vector, payload_json_roundtrip,
        quantize_scale, quantize_vectors, l2_float_pairs, l2_int_pairs, knn_exact_int, knn_exact_float, knn_vote,
        kmeans_init, kmeans_assign, kmeans_update, kmeans_movement, kmeans_t3,
        ivf_list_sizes, ivf_probe, ivf_search, ivf_adaptive, nprobe_sweep, ivf_recall,
        confusion_score, latency_score, latency_histogram, stage_stats, decision_json,
        ivf_stored_search, ivf_stored_recall, knn_score, score_payloads, stream_decisions, respond, references_json, lookup_risk,
    )
}
