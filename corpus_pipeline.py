"""From raw documents to packed sequences: five stages, each over what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next one's docs.  Columns beyond those of documents are
carried through all stages but the last, whatever their names.

Edge cases by stage.  Null, empty and blank texts fail the quality base, so none goes
on from the first stage; given to a later one alone, they are one group of copies for
near-dedup (the smallest id stays; without ids all of them), have no benchmark window
and no secret, and pack as their end id.  Null ids: kept by every stage; near-dedup
keeps a row without an id only where no row of its group has one.  Repeated rows: all
stay or go together, and packing gives pieces for each.  Ties: near-dedup keeps the
smallest id; packing orders equal points by row.  Very long texts are read whole by
every stage.  Empty tables: no rows, and without benchmark items no document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import decontaminate, packing, quality_rules, secrets, simhash
from tamarack.llm._common import table, work_path, written
from tamarack.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base or whose posterior is under a half go."""
    return quality_rules.judge(docs).where("_kept").select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies: of documents linked by fingerprints (two bits) or by five-word
    shingles (Jaccard similarity of 0.8) the one with the smallest id stays."""
    return simhash.keep_one(docs, least=0.8)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with a window of a benchmark item go."""
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.col("_n_hit") == 0).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: findings are masked in the text, and n_chars follows."""
    return secrets.mask_secrets(docs, work_path(spark, "secret-ledger"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of sequences along the Hilbert curve, with their token ids."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_each),
    ("decontamination", keep_clean),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Expectation-maximisation, fingerprints and tokenisers are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
