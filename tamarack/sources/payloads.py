"""Readers: event payloads and labelled reference vectors, both JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = (
    "id string, "
    "transaction struct<amount:double,installments:int,requested_at:string>, "
    "customer struct<avg_amount:double,tx_count_24h:int,known_merchants:array<string>>, "
    "merchant struct<id:string,mcc:string,avg_amount:double>, "
    "terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>, "
    "last_transaction struct<timestamp:string,km_from_current:double>"
)
CORRUPT = "_corrupt_record"
REFERENCE = "vector array<float>, label string"


def read_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Payload rows; text that is no payload has nulls and its text in CORRUPT."""
    return spark.read.schema(f"{PAYLOAD}, {CORRUPT} string").option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def parse_payloads(raw: DataFrame, body: str = "body") -> DataFrame:
    """``raw`` with the JSON column ``body`` parsed beside its other columns."""
    parsed = F.from_json(F.col(body), f"{PAYLOAD}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    keep = [c for c in raw.columns if c != body]
    # A generator of one row: the optimiser would parse anew for each field that is used.
    return raw.select(*keep, F.col(body).alias("_body"), F.inline(F.array(parsed)))


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected raw texts): malformed text is never scored."""
    bad = F.col(CORRUPT).isNotNull() | F.col("_body").isNull()
    return parsed.where(~bad).drop(CORRUPT, "_body"), parsed.where(bad).select(F.col("_body").alias("body"))


def read_references(spark: SparkSession, path: str, dim: int = 14, lines: bool = False) -> DataFrame:
    """(ref_id, vector, label); ``fraud`` is 1, any other label 0.

    One JSON array in one file: ref_id follows the file's order, which breaks ties
    of distance; Spark reads it in one task.  ``lines``: JSON lines in any number of
    files, read in parallel; each row states its ref_id, as files have no order.
    """
    rows = spark.read.schema(f"ref_id long, {REFERENCE}").option("multiLine", not lines).json(path)
    if lines:
        number = F.when(F.col("ref_id").isNull(), F.raise_error("a line without ref_id").cast("long")).otherwise(F.col("ref_id"))
    elif len(rows.inputFiles()) > 1:
        raise ValueError(f"{path}: several arrays have no order; write JSON lines with ref_id")
    else:
        number = F.monotonically_increasing_id()
    return rows.select(number.alias("ref_id"), _sized("vector", dim), fraud_flag(F.col("label")).alias("label"))


def fraud_flag(label: Column) -> Column:
    return F.when(label == "fraud", 1).otherwise(0)


def _sized(name: str, dim: int) -> Column:
    wrong = F.raise_error(F.format_string(f"vector of %d values; {dim} expected", F.size(name)))
    return F.when(F.size(name) == dim, F.col(name)).otherwise(wrong.cast("array<float>")).alias(name)


def read_lookup(spark: SparkSession, path: str) -> dict[str, float]:
    """A small JSON object of numbers, for example risks by category or limits."""
    row = spark.read.option("multiLine", True).json(path).first()
    return {k: float(v) for k, v in row.asDict().items()}
