"""Content-addressed ledgers: do the work once per distinct (content, version).

A ledger is a Parquet table keyed by (version, digest), in a folder for each
version.  A run

1. digests every row's content (SHA-256 of the text, null as empty),
2. anti-joins the distinct digests to the ledger's entries of this version,
3. takes one text for each unseen digest and works on that alone, and
4. appends the results to the ledger in one committed write.

Texts of known digests are filtered out where they are read: the unseen digests
are broadcast if there are at most ``BROADCAST`` of them (32 bytes each, counted
first), and without any no text is read.  With more, all texts take part in the
aggregation that the join then cuts down.  Copies of one text, repeated rows and
rows without an id have one digest; each task keeps one text of a digest before the
shuffle, so a group of copies that holds a third of all rows costs one text a task.
A run that dies before its append has committed leaves the ledger as it was and is
simply run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import path_exists, written

BROADCAST = 50_000
KEY_FIELDS = [T.StructField("version", T.StringType()), T.StructField("digest", T.BinaryType())]


def digest_of(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str, schema: T.StructType, version: str) -> DataFrame:
    """The entries of ``version``; an absent ledger is an empty one."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema).drop("version")
    return spark.read.schema(schema).parquet(path).where(F.col("version") == version).drop("version")


def through_ledger(
    docs: DataFrame,
    path: str,
    version: str,
    work: Callable[[DataFrame], DataFrame],
    payload: list[T.StructField],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Bring the ledger at ``path`` up to date for ``docs``.

    ``work`` maps (digest, text), one row a digest, to (digest, payload...), one row each.  Returns
    (rows, entries): rows has id, digest and n_bytes of every row of ``docs``;
    entries has one row for each distinct digest among them.
    """
    spark = docs.sparkSession
    schema = T.StructType([*KEY_FIELDS, *payload])
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), digest_of(F.col(text_col)).alias("digest"))
    rows = written(base.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes")), "ledger-rows")

    known = read_ledger(spark, path, schema, version)
    seen = rows.select("digest").distinct()
    unseen = written(seen.join(known.select("digest"), "digest", "left_anti"), "ledger-unseen")
    n = unseen.limit(BROADCAST + 1).count()

    # A hint on the many: their hashes are built of digests, not of texts.
    wanted = F.broadcast(unseen) if n <= BROADCAST else unseen.hint("shuffle_hash")
    texts = base.select("digest", F.col("_text").alias("text"))
    one = lambda df: df.groupBy("digest").agg(F.first("text").alias("text"))
    chosen = one(texts.join(wanted, "digest", "left_semi")) if n <= BROADCAST else one(texts).join(wanted, "digest", "left_semi")
    names = [f.name for f in payload]
    if n:
        done = work(chosen).select("digest", *names, F.lit(version).alias("version"))
        done.write.mode("append").partitionBy("version").option("compression", "zstd").parquet(path)

    now = read_ledger(spark, path, schema, version).join(seen, "digest", "left_semi")
    entries = now.groupBy("digest").agg(*(F.first(n).alias(n) for n in names))
    return rows, written(entries, "ledger-entries")
