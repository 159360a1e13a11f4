"""Scoring of payloads, in batches and in streams.

Ranked windows are not allowed on streams, so each micro-batch runs the batch
functions; the index is static and shared by all of them.  Every request has an
answer: a decision, or the status that says why there is none.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.features import vectorize
from ..functions.vectors import decision_json
from ..operators.index import IvfIndex
from ..operators.ivf import FAST_NPROBE, NPROBE, adaptive_decision, adaptive_vote, knn_score
from ..sources.payloads import parse_payloads, split_rejects
from ..storage import delete, work_path
from .stats import Stats

# Routes of the service.
SCORE, READY = ("POST", "/fraud-score"), ("GET", "/ready")
OK, BAD_REQUEST, NOT_FOUND = 200, 400, 404


def route(method: Column, path: Column) -> Column:
    """'score', 'ready' or null for a request line that has no route."""
    is_route = lambda r: (method == r[0]) & (path == r[1])
    return F.when(is_route(SCORE), "score").when(is_route(READY), "ready")


def score_payloads(payloads: DataFrame, index: IvfIndex, fast: int = FAST_NPROBE, full: int = NPROBE, key: str = "qid", work: str | None = None) -> DataFrame:
    """(qid, n_fraud, approved, response) of parsed payloads with a long ``key``;
    ``work``: see ``adaptive_decision``."""
    queries = vectorize(payloads, "v").select(F.col(key).alias("qid"), "v")
    return adaptive_decision(queries, index, fast, full, work=work).select("qid", "n_fraud", "approved", decision_json(F.col("n_fraud")).alias("response"))


def score_raw(raw: DataFrame, index: IvfIndex, fast: int = FAST_NPROBE, full: int = NPROBE, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(decisions, rejected texts) of raw rows (qid, body)."""
    good, bad = split_rejects(parse_payloads(raw))
    return score_payloads(good, index, fast, full, work=work), bad


def respond(requests: DataFrame, index: IvfIndex, fast: int = FAST_NPROBE, full: int = NPROBE) -> DataFrame:
    """(qid, status, response) of requests (qid, method, path, body): 200 with a
    decision or 'ok', 400 for a body that is no payload, 404 without a route."""
    routed = requests.withColumn("route", route(F.col("method"), F.col("path")))
    decided, _ = score_raw(routed.where("route = 'score'").select("qid", "body"), index, fast, full)
    decided = decided.select(F.col("qid").alias("_q"), F.col("response").alias("_r"))
    joined = routed.join(decided, F.col("qid") == F.col("_q"), "left")
    status = F.when(F.col("route").isNull(), NOT_FOUND).when((F.col("route") == "score") & F.col("_r").isNull(), BAD_REQUEST).otherwise(OK)
    text = F.when(status == NOT_FOUND, "not found").when(status == BAD_REQUEST, "bad request").otherwise(F.coalesce("_r", F.lit("ok")))
    return joined.select("qid", status.alias("status"), text.alias("response"))


@dataclass
class Scorer:
    """An index with its settings, warm-up, readiness and statistics."""

    index: IvfIndex
    nprobe: int = NPROBE
    fast_nprobe: int = FAST_NPROBE
    stats: Stats = field(default_factory=Stats)
    ready: bool = False

    def __post_init__(self) -> None:
        if self.nprobe < 1 or self.fast_nprobe < 1:
            raise ValueError("nprobe and fast_nprobe must be at least 1")

    @classmethod
    def load(cls, spark: SparkSession, path: str | None = None, **settings) -> Scorer:
        """From ``path`` or IVF_PATH; NPROBE and FAST_NPROBE where not given."""
        path = path or os.environ["IVF_PATH"]
        known = {"nprobe": int(os.environ.get("NPROBE", NPROBE)), "fast_nprobe": int(os.environ.get("FAST_NPROBE", FAST_NPROBE))}
        return cls(IvfIndex.load(spark, path), **(known | settings))

    def warm_up(self, raw: DataFrame | None = None, rounds: int | None = None) -> Scorer:
        """Keep the lists in memory and replay payloads (qid, body) ``rounds`` times
        (WARMUP, else 10; 0: none); only then is the scorer ``ready``."""
        self.index.persist()
        for _ in range(int(os.environ.get("WARMUP", 10)) if rounds is None else rounds):
            if raw is not None:
                score_raw(raw, self.index, self.fast_nprobe, self.nprobe)[0].write.format("noop").mode("overwrite").save()
        self.ready = True
        return self

    def score(self, queries: DataFrame) -> DataFrame:
        """Plain votes of vectors (qid, v), from ``nprobe`` lists."""
        return knn_score(queries, self.index, self.nprobe)

    def fraud_count(self, queries: DataFrame) -> DataFrame:
        """Adaptive votes of vectors (qid, v)."""
        return adaptive_vote(queries, self.index, self.fast_nprobe, self.nprobe)

    def answer(self, raw: DataFrame, write: Callable[[DataFrame], None], reject: Callable[[DataFrame], None]) -> None:
        """Score raw rows (qid, body) and hand decisions and rejects on, timed by stage.

        The rows are those of a micro-batch: kept while they are worked on, so that
        the source is read once."""
        raw, work = raw.persist(), work_path(raw.sparkSession, "fast-neighbours")
        try:
            with self.stats.timed("score"):
                good, bad = score_raw(raw, self.index, self.fast_nprobe, self.nprobe, work)
                write(good)
            with self.stats.timed("reject"):
                reject(bad)
        finally:
            raw.unpersist()
            delete(raw.sparkSession, work)
        self.stats.count(calls=1)


def requests(spark: SparkSession, source: str, fmt: str = "json", **options: str) -> DataFrame:
    """A stream of (qid, body).

    json: files with these two columns that arrive in the folder ``source``.
    kafka: topic ``source`` (options: ``kafka.bootstrap.servers`` ...); qid is the
    record's partition and offset, so it is the same if a batch is run again.
    Needs Spark's Kafka package on the class path.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        at = F.shiftleft(F.col("partition").cast("long"), 48) + F.col("offset")
        return reader.option("subscribe", source).load().select(at.alias("qid"), F.col("value").cast("string").alias("body"))
    return reader.schema("qid long, body string").load(source)


def stream_decisions(
    spark: SparkSession,
    source: str | DataFrame,
    index: IvfIndex | Scorer,
    sink: str,
    rejects: str,
    checkpoint: str,
    fast: int = FAST_NPROBE,
    full: int = NPROBE,
    once: bool = False,
) -> StreamingQuery:
    """Score requests (a stream of (qid, body), or JSON files that arrive in a
    folder); decisions go to ``sink``, texts that are no payload to ``rejects``, as
    Parquet by batch.

    A batch's folder is overwritten if the batch is run again, so each payload is
    answered once even if the driver is lost between the two writes.
    """
    scorer = index if isinstance(index, Scorer) else Scorer(index, full, fast)

    def run(batch: DataFrame, number: int) -> None:
        write = lambda path: lambda df: df.write.mode("overwrite").parquet(f"{path}/batch={number}")
        scorer.answer(batch, write(sink), write(rejects))

    stream = requests(spark, source) if isinstance(source, str) else source
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
