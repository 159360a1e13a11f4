"""Evaluation: confusion counts, detection and latency scores, recall, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, actual: str = "actual", predicted: str = "predicted", error: str | None = None) -> DataFrame:
    """(n, tp, fp, fn, tn, errors) of 0/1 columns; rows in error count only there."""
    failed = F.coalesce(F.col(error), F.lit(False)) if error else F.lit(False)
    case = lambda a, p: F.sum(F.when(~failed & (F.col(actual) == a) & (F.col(predicted) == p), 1).otherwise(0)).cast("long")
    return rows.agg(F.count("*").alias("n"), case(1, 1).alias("tp"), case(0, 1).alias("fp"), case(1, 0).alias("fn"), case(0, 0).alias("tn"), F.sum(failed.cast("int")).cast("long").alias("errors"))


def detection_score(counts: DataFrame) -> DataFrame:
    """``confusion`` with weighted errors E = fp + 3 fn + 5 errors, rate, penalty, score."""
    e = F.col("fp") + 3 * F.col("fn") + 5 * F.col("errors")
    share = F.greatest(F.try_divide(e, F.col("n")).cast("double"), F.lit(0.001))
    rate, penalty = 1000 * F.log10(1 / share), -300 * F.log10(1.0 + e)
    return counts.select("*", e.alias("weighted_errors"), rate.alias("rate"), penalty.alias("penalty"), (rate + penalty).alias("detection_score"))


def latency_points(p99: Column) -> Column:
    return 1000 * F.log10(1000 / F.greatest(p99, F.lit(1.0)))


def latency_score(rows: DataFrame, ms: str, accuracy: int | None = None) -> DataFrame:
    """(p50, p95, p99, max_ms, p99_score).

    Exact percentiles gather the distinct values in one buffer.  With ``accuracy``
    they are values whose ranks are within 1 / ``accuracy`` of the rows, from
    sketches of bounded size: the form for very many rows.
    """
    at = F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))
    p = F.percentile_approx(F.col(ms).cast("double"), at, accuracy) if accuracy else F.percentile(ms, at)
    got = rows.agg(p.alias("p"), F.max(ms).alias("max_ms"))
    return got.select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "max_ms", latency_points(F.col("p")[2]).alias("p99_score"))


def latency_histogram(rows: DataFrame, ms: str, edges: list[float]) -> DataFrame:
    """(bucket, n): bucket k holds values from edge k - 1 up to below edge k."""
    bucket = F.lit(0)
    for k, edge in enumerate(edges, start=1):
        bucket = F.when(F.col(ms) >= edge, k).otherwise(bucket)
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def stage_stats(rows: DataFrame, stage: str, amount: str) -> DataFrame:
    """(stage, calls, total, largest, average, share) with exact sums of hundredths."""
    cents = F.round(F.col(amount) * 100).cast("long")
    each = rows.groupBy(stage).agg(F.count("*").alias("calls"), F.sum(cents).alias("total"), F.max(cents).alias("largest"))
    whole = F.broadcast(rows.agg(F.sum(cents).alias("_whole")))
    return each.crossJoin(whole).select(stage, "calls", "total", "largest", (F.col("total") / F.col("calls")).alias("average"), (100.0 * F.col("total") / F.col("_whole")).alias("share"))


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(qid, n_common, recall): how many of the exact k a search found."""
    common = exact.select("qid", "ref_id").join(found.select("qid", "ref_id"), ["qid", "ref_id"]).groupBy("qid").count()
    every = exact.select("qid").distinct()
    n = F.coalesce(F.col("count"), F.lit(0)).cast("long")
    return every.join(common, "qid", "left").select("qid", n.alias("n_common"), (n / F.lit(float(k))).alias("recall"))
