"""The driver's tables as this engine's inputs.

References and queries are ``embeddings`` with label 1 where its label is under
3; every vector whose id is divisible by 100 is a query against all vectors.
Payloads are made of ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.features import seconds_of
from ..functions.vectors import abs_max, fit_scale, quantize
from ..operators.search import at_most

DAY = 86_400
KNOWN = ["click", "view", "signup"]
# A category by event type: two known, one unknown, one of the wrong length, none.
MCC = {"click": "5411", "view": "5812", "purchase": "7995", "signup": "59", "error": "0000"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, v, label) of all vectors; rows without a vector are no references."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull())
    return rows.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("v"), (F.col("label") < 3).cast("int").alias("label"))


def query_set(refs: DataFrame) -> DataFrame:
    """(qid, v, actual): the stated query set."""
    return refs.where(F.col("ref_id") % 100 == 0).select(F.col("ref_id").alias("qid"), "v", F.col("label").alias("actual"))


def quantized(refs: DataFrame) -> tuple[DataFrame, float]:
    scale = fit_scale(abs_max(refs, "v"))
    return refs.withColumn("v", quantize(F.col("v"), scale)), scale


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id and the columns of a payload, for all events."""
    e = table(spark, sf_dir, "events")
    by_user = Window.partitionBy("user_id")
    in_order = by_user.orderBy("sec", "event_id")
    e = e.select(
        "event_id", "user_id", "event_type", "value",
        seconds_of(F.col("ts")).alias("sec"),
        # The digits of a timestamp_ntz, so the session's time zone has no part in them.
        F.concat(F.translate(F.substring(F.col("ts").cast("string"), 1, 19), " ", "T"), F.lit("Z")).alias("iso"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    cents = F.round(F.col("value") * 100).cast("long")
    # Averages and counts are aggregates joined back, or running windows: no user's rows are collected.
    users = e.groupBy("user_id").agg((F.sum(cents) / F.count("*") / 100.0).alias("user_avg"))
    kinds = e.groupBy("event_type").agg((F.sum(cents) / F.count("*") / 100.0).alias("kind_avg"))
    few = at_most(e.select("event_type").distinct(), 10_000)  # types, one row each
    e = e.withColumn("n_day", F.count("*").over(by_user.orderBy("sec").rangeBetween(-DAY, 0)).cast("int")).withColumn("last_iso", F.lag("iso").over(in_order))
    # Null-safe: events without a user or a type are a group of their own, as in the windows.
    users, kinds = users.withColumnRenamed("user_id", "_user"), kinds.withColumnRenamed("event_type", "_kind")
    e = e.join(users, F.col("user_id").eqNullSafe(F.col("_user"))).join(F.broadcast(kinds) if few else kinds, F.col("event_type").eqNullSafe(F.col("_kind")))
    mcc = F.create_map(*(F.lit(x) for kv in MCC.items() for x in kv))
    last = F.struct(F.col("last_iso").alias("timestamp"), (F.col("k") * 11.5).alias("km_from_current"))
    return e.select(
        "event_id",
        F.col("event_id").cast("string").alias("id"),
        F.struct(F.col("value").alias("amount"), (F.col("k") % 15).alias("installments"), F.col("iso").alias("requested_at")).alias("transaction"),
        F.struct(F.col("user_avg").alias("avg_amount"), F.col("n_day").alias("tx_count_24h"), F.array(*(F.lit(x) for x in KNOWN)).alias("known_merchants")).alias("customer"),
        F.struct(F.col("event_type").alias("id"), F.try_element_at(mcc, F.col("event_type")).alias("mcc"), F.col("kind_avg").alias("avg_amount")).alias("merchant"),
        F.struct((F.col("k") % 2 == 0).alias("is_online"), (F.col("k") % 3 == 0).alias("card_present"), (F.col("k") * 12.5).alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_iso").isNotNull(), last).alias("last_transaction"),
    )
